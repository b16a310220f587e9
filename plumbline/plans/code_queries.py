"""Detectors and analyzers over stand-ins for source files."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators import code as C
from plumbline.operators import scoring as S
from plumbline.operators import vote as V
from plumbline.plans import standin
from plumbline.plans.registry import query

LINES, FILES = f"with {standin.LINES}", f"with {standin.FILES}"
KEYS = ["file_id", "dir", "path"]


def _files(t):
    return C.text_files(standin.lines(t), KEYS)


def _vote(rows, group="dir", threshold=0.7):
    return V.vote(rows, group, "style", "file_id", threshold=threshold)


def _vote_sql(styles: str, group: str = "dir", threshold: float = 0.7) -> str:
    """A directory vote over a CTE ``styles`` (file_id, dir, style)."""
    return f"""{styles}, d as (select {group}, style p, count(*) c, min(file_id) f from styles group by 1, 2),
v as (select *, row_number() over (partition by {group} order by c desc, f) r, sum(c) over (partition by {group}) t from d)
select {group}, p as dominant, c as dominant_count, t::bigint as total, floor(c::double / t * 100 + 0.5)::bigint as consistency, (t >= 3 and c::double / t >= {threshold} and c < t) as flagged from v where r = 1"""


# Fixed value: the share from which a project's way of logging is a convention.
LOGGING_SHARE = 0.6


def _family_case(families: dict[str, str]) -> str:
    return "case " + " ".join(f"when regexp_matches(content, '{p}') then '{n}'" for n, p in families.items()) + " end"


EXT = "case regexp_extract(path, '([.][^./]*)$', 1) " + " ".join(f"when '{e}' then '{n}'" for e, n in C.LANGUAGES.items()) + " end"


@query(f"{FILES}, g as (select {EXT} as language, count(*) n, sum(line_count)::bigint total, min(file_id) f from files group by 1) select language, n as files, total as total_lines, row_number() over (order by total desc, f) = 1 as dominant from g")
def language_breakdown(t):
    g = _files(t).groupBy(C.language(F.col("path")).alias("language")).agg(F.count("*").alias("files"), F.sum("line_count").alias("total_lines"), F.min("file_id").alias("f"))
    top = g.agg(F.max_by("language", F.struct("total_lines", -F.col("f"))).alias("top"))
    return g.join(F.broadcast(top)).select("language", "files", "total_lines", F.coalesce(F.col("language") == F.col("top"), F.lit(False)).alias("dominant"))


NOT_SHIPPED = " or ".join(f"regexp_matches(path, '{p}')" for p in (C.GENERATED, C.FIXTURE, C.TEST, C.EXAMPLE))


@query(f"""{FILES} select file_id, ({NOT_SHIPPED}) as non_shippable, not regexp_matches(path, '(?i)test|spec|mock|fixture') as analyzable,
case when regexp_matches(path, '{C.GENERATED}') or regexp_matches(path, '{C.FIXTURE}') then 0.05 when regexp_matches(path, '{C.TEST}') or regexp_matches(path, '{C.EXAMPLE}') then 0.35 when regexp_matches(path, '(^|/)(index|main|app|server)\\.[A-Za-z0-9]+$') then 1.5 else 1.0 end::double as importance from files""")
def path_predicates(t):
    p = F.col("path")
    return _files(t).select("file_id", C.non_shippable(p).alias("non_shippable"), (~p.rlike("(?i)test|spec|mock|fixture")).alias("analyzable"), C.importance(p).alias("importance"))


@query(f"""{FILES} select file_id, path from files where (path like '%.ts' or regexp_matches(path, '^src/m1[0-9]/[^/]*[.]js$')) and not regexp_matches(path, '[.]test[.][^/]*$') and path not like 'src/m3/%'""")
def glob_filter(t):
    return C.include_exclude(_files(t), ["**/*.ts", "src/m1[0-9]/*.js"], ["**/*.test.*", "src/m3/**"]).select("file_id", "path")


@query(f"""{FILES}, s as (select distinct file_id, unnest(string_split(path, '/')) seg from files) select seg, count(*) as files, '**/' || seg || '/**' as glob from s where seg in ('generated', 'examples', 'tests', 'vendor') group by 1""")
def exclusion_suggestion(t):
    segments = _files(t).select("file_id", F.explode(F.array_distinct(F.split("path", "/"))).alias("seg"))
    return segments.where(F.col("seg").isin("generated", "examples", "tests", "vendor")).groupBy("seg").agg(F.count("*").alias("files")).withColumn("glob", F.concat(F.lit("**/"), "seg", F.lit("/**")))


@query(f"""{LINES}, m as (select *, row_number() over (partition by path order by line, text) n from (select distinct path, line, text from lines) where regexp_matches(text, '\\bconst\\b')) select path, line, substr(trim(text), 1, 120) as code, n from m where n <= 3""")
def evidence_extraction(t):
    found = standin.lines(t).select("path", "line", "text").distinct().where(F.col("text").rlike(r"\bconst\b"))
    w = Window.partitionBy("path").orderBy("line", "text")
    return found.withColumn("n", F.row_number().over(w).cast("long")).where("n <= 3").select("path", "line", F.substring(F.trim("text"), 1, 120).alias("code"), "n")


ASYNC = f"""{LINES}, a as (select file_id, dir, count(*) filter (regexp_matches(text, '\\bawait\\s+') and not starts_with(trim(text), '//') and not starts_with(trim(text), '*')) awaits,
count(*) filter (regexp_matches(text, '\\.\\s*then\\s*\\(') and not starts_with(trim(text), '//') and not regexp_matches(text, 'type\\s|interface\\s')) thens from lines group by 1, 2),
styles as (select *, case when awaits::double / (awaits + thens) > 0.7 then 'async_await' when awaits::double / (awaits + thens) < 0.3 then 'then_chains' else 'mixed' end style from a where awaits + thens >= 2)"""


@query(f"{ASYNC} select file_id, awaits, thens, style from styles")
def async_styles(t):
    return C.async_style(standin.lines(t), KEYS).select("file_id", "awaits", "thens", "style")


@query(_vote_sql(ASYNC))
def async_consistency(t):
    return _vote(C.async_style(standin.lines(t), KEYS))


@query(_vote_sql(f"""{LINES}, e as (select file_id, dir, bool_or(regexp_matches(trim(text), '^export\\s+default\\b') or regexp_matches(text, '\\bmodule\\.exports\\s*=')) d, bool_or(regexp_matches(trim(text), '^export\\s+(?:function|class|const|let|var|interface|type|enum|abstract)\\b')) n from lines group by 1, 2),
styles as (select file_id, dir, case when d then 'default_export' else 'named_only' end style from e where d or n)"""))
def export_consistency(t):
    return _vote(C.export_style(standin.lines(t), KEYS))


@query(_vote_sql(f"""{FILES}, styles as (select file_id, 'project' as project, {_family_case(C.LOGGING)} style from files where {_family_case(C.LOGGING)} is not null)""", "project", LOGGING_SHARE))
def logging_consistency(t):
    """One vote of the whole project; six of ten files are a convention here."""
    rows = _files(t).select("file_id", F.lit("project").alias("project"), C.first_family(F.col("content"), C.LOGGING).alias("style")).where("style is not null")
    return _vote(rows, "project", LOGGING_SHARE)


@query(_vote_sql(f"""{FILES}, styles as (select file_id, dir, {_family_case(C.STATE)} style from files where {_family_case(C.STATE)} is not null)"""))
def state_management_consistency(t):
    return _vote(_files(t).select("file_id", "dir", C.first_family(F.col("content"), C.STATE).alias("style")).where("style is not null"))


@query(f"""{LINES}, c as (select file_id, count(*) filter (starts_with(trim(text), '/**')) * 3 d, count(*) filter (starts_with(trim(text), '//')) l, count(*) filter (starts_with(trim(text), '#')) h from lines group by 1)
select case when greatest(d, l, h) = 0 then 'none' when d = greatest(d, l, h) then 'jsdoc' when l = greatest(d, l, h) then 'line_comment' else 'hash_comment' end as style, count(*) as files, min(file_id) as first_file from c group by 1""")
def comment_style_consistency(t):
    return C.comment_style(standin.lines(t), ["file_id"]).groupBy("style").agg(F.count("*").alias("files"), F.min("file_id").alias("first_file"))


@query(f"""{FILES}, p as (select file_id, case when regexp_matches(content, '\\bdescribe\\s*\\(\\s*["'']') and regexp_matches(content, '\\bit\\s*\\(\\s*["'']') then 'bdd_nested' when regexp_matches(content, '(?m)^test\\s*\\(\\s*["'']') then 'flat_test' end framework,
case when regexp_matches(content, '\\b(?:jest|vi)\\.(?:fn|mock|spyOn)\\(') then 'framework_mocks' when regexp_matches(content, '\\bsinon\\.(?:stub|spy|mock|fake)\\(') then 'sinon' end mocks from files where regexp_matches(path, '(?i)(\\.test\\.|\\.spec\\.|__tests__/|__test__/)'))
select framework, mocks, count(*) as files from p group by 1, 2""")
def test_structure(t):
    tests = _files(t).where(F.col("path").rlike(r"(?i)(\.test\.|\.spec\.|__tests__/|__test__/)"))
    return tests.groupBy(C.test_framework(F.col("content")).alias("framework"), C.mock_style(F.col("content")).alias("mocks")).agg(F.count("*").alias("files"))


NAMED = r"(?:const|let|var|function|def|func|fn)\s+(\w+)"
CONVENTION = "case when regexp_matches(name, '^[A-Z][A-Z0-9_]+$') then 'SCREAMING_SNAKE' when regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') then 'PascalCase' when regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') then 'camelCase' when regexp_matches(name, '^[a-z][a-z0-9_]*$') then 'snake_case' when regexp_matches(name, '^[a-z][a-z0-9-]*$') then 'kebab-case' end"


@query(f"""{LINES}, i as (select file_id, unnest(regexp_extract_all(text, '{NAMED}', 1)) name from lines), c as (select {CONVENTION} convention, count(*) n, count(distinct file_id) files from i group by 1)
select convention, n, files, n >= 3 and n::double / sum(n) over () >= 0.1 and files >= 2 and n < max(n) over () as deviates from c""")
def naming_oscillation(t):
    c = C.identifiers(standin.lines(t), ["file_id"]).groupBy(C.naming(F.col("name")).alias("convention")).agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("files"))
    total = F.broadcast(c.agg(F.sum("n").alias("s"), F.max("n").alias("m")))
    return c.join(total).select("convention", "n", "files", ((F.col("n") >= 3) & (F.col("n") / F.col("s") >= 0.1) & (F.col("files") >= 2) & (F.col("n") < F.col("m"))).alias("deviates"))


@query(f"""{LINES}, i as (select dir, unnest(regexp_extract_all(text, '{NAMED}', 1)) name from lines), c as (select dir, {CONVENTION} p, count(*) c from i group by 1, 2), q as (select *, c::double / sum(c) over (partition by dir) p2 from c),
a as (select dir, sum(c)::bigint total, count(*) k, sum(-p2 * log2(p2)) entropy, max(p2) top from q group by 1), r as (select *, case when k < 2 then 0 else entropy / log2(k) end ratio from a)
select dir, total, k, round(entropy, 6) as entropy, (k >= 2 and ratio > 0.8) as no_convention, round(case when k < 2 then 0.9 when ratio > 0.8 then 0.75 else least(0.9, greatest(0.3, 1 - ratio)) end, 6) as confidence, floor(top * 100 + 0.5)::bigint as score from r""")
def naming_entropy(t):
    return V.entropy_gate(C.identifiers(standin.lines(t), ["dir"]).withColumn("c", C.naming(F.col("name"))), "dir", "c")


@query(f"""{FILES}, s as (select dir, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^[0-9]+-|[.].*$', '', 'g') name, file_id from files), styles as (select file_id, dir, {CONVENTION} style from s where {CONVENTION} is not null)""" + _vote_sql(""))
def file_name_convention(t):
    name = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), "^[0-9]+-|[.].*$", "")
    return _vote(_files(t).select("file_id", "dir", C.naming(name).alias("style")).where("style is not null"))


@query(f"""{LINES}, f as (select file_id, bool_or(regexp_matches(text, '\\b(?:import\\s+|export\\s+(?:default\\s+)?(?:function|class|const|let|var))')) esm, bool_or(regexp_matches(text, '\\bmodule\\.exports\\s*=') or (regexp_matches(text, '(?:const|let|var)\\s+\\w+\\s*=\\s*require\\(') and regexp_extract(text, 'require\\("([^"/]+)', 1) not in ('fs', 'path', 'os', 'http', 'util'))) cjs from lines group by 1)
select count(*) filter (esm) as esm, count(*) filter (cjs) as cjs, count(*) filter (esm and cjs) as mixed, count(*) as files from f""")
def import_mixing(t):
    text = F.col("text")
    esm = text.rlike(r"\b(?:import\s+|export\s+(?:default\s+)?(?:function|class|const|let|var))")
    foreign = text.rlike(r"(?:const|let|var)\s+\w+\s*=\s*require\(") & ~F.regexp_extract("text", r'require\("([^"/]+)', 1).isin("fs", "path", "os", "http", "util")
    f = standin.lines(t).groupBy("file_id").agg(F.bool_or(esm).alias("esm"), F.bool_or(text.rlike(r"\bmodule\.exports\s*=") | foreign).alias("cjs"))
    return f.agg(F.count_if("esm").alias("esm"), F.count_if("cjs").alias("cjs"), F.count_if(F.col("esm") & F.col("cjs")).alias("mixed"), F.count("*").alias("files"))


@query(f"""{FILES} select dir, sum(len(regexp_extract_all(content, 'catch\\s*(?:\\([^)]*\\))?\\s*\\{{\\s*\\}}')))::bigint as empty_catches, count(*) filter (regexp_matches(content, '\\basync\\s+function') and not regexp_matches(content, '\\btry\\s*\\{{|\\.catch\\s*\\(')) as unguarded from files group by 1""")
def error_handling(t):
    content = F.col("content")
    empty = F.regexp_count("content", F.lit(r"catch\s*(?:\([^)]*\))?\s*\{\s*\}")).cast("long")
    return _files(t).groupBy("dir").agg(F.sum(empty).alias("empty_catches"), F.count_if(content.rlike(r"\basync\s+function") & ~content.rlike(r"\btry\s*\{|\.catch\s*\(")).alias("unguarded"))


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


STUB = f"(regexp_matches(text, '{_quoted(C.PLACEHOLDER)}') or regexp_matches(text, '{_quoted(C.NOT_IMPLEMENTED)}'))"


@query(f"""{LINES}, d as (select distinct path, line, text from lines), w as (select *, max({STUB}::int) over (partition by path order by line range between 5 preceding and 5 following) near from d)
select path, line, text, near = 1 as adjacent from w where regexp_matches(text, '{C.TODO}')""")
def todo_adjacent_stub(t):
    stub = F.col("text").rlike(C.PLACEHOLDER) | F.col("text").rlike(C.NOT_IMPLEMENTED)
    rows = standin.lines(t).select("path", "line", "text").distinct()
    return C.near_lines(rows, ["path"], F.col("text").rlike(C.TODO), stub).select("path", "line", "text", "adjacent")


@query(f"""{LINES}, f as (select file_id, count(*) n, count(*) filter (regexp_matches(text, '{C.TODO}')) k from lines group by 1), r as (select sum(k)::double / sum(n) rate from f),
p as (select file_id, n, k, n * rate lam from f, r where k > 0) select file_id, n, k, round(1000.0 * k / n, 6) as density, round(greatest(0, 1 - list_sum(list_transform(range(0, k), lambda i: exp(-lam) * power(lam, i) / factorial(i::int)))), 6) as tail from p""")
def todo_density(t):
    f = standin.lines(t).groupBy("file_id").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(C.TODO)).alias("k"))
    rate = F.broadcast(f.agg((F.sum("k") / F.sum("n")).alias("rate")))
    return f.where("k > 0").join(rate).select("file_id", "n", "k", F.round(1000.0 * F.col("k") / F.col("n"), 6).alias("density"), F.round(S.poisson_tail(F.col("k"), F.col("n") * F.col("rate")), 6).alias("tail"))


ENV = r"process\.env\.([A-Z_]+)"


@query(f"""{LINES}, u as (select unnest(regexp_extract_all(text, '{ENV}', 1)) name, file_id from lines), g as (select name, count(distinct file_id) files from u group by 1), d as (select * from (values ('API_URL'), ('LOG_LEVEL')) v(name))
select coalesce(g.name, d.name) as name, coalesce(files, 0) as files, case when d.name is null then 'undeclared' when g.name is null then 'unused' else 'ok' end as state from g full outer join d on g.name = d.name""")
def config_drift(t):
    lines = standin.lines(t)
    used = lines.select("file_id", F.explode(F.regexp_extract_all("text", F.lit(ENV), F.lit(1))).alias("name")).groupBy("name").agg(F.count_distinct("file_id").alias("files"))
    declared = lines.sparkSession.createDataFrame([("API_URL", True), ("LOG_LEVEL", True)], "name string, declared boolean")
    state = F.when(F.col("declared").isNull(), "undeclared").when(F.col("files").isNull(), "unused").otherwise("ok")
    return used.join(declared, "name", "full_outer").select("name", F.coalesce("files", F.lit(0)).alias("files"), state.alias("state"))


# Rule, pattern and confidence of line rules.
RULES = [("eval", r"\beval\s*\(", 0.9), ("inner-html", r"\.innerHTML\s*=", 0.8), ("hard-coded-secret", r"(?i)(?:password|secret|token)\s*[:=]\s*\S{8,}", 0.7), ("sql-string", r"(?i)\bquery\(.*SELECT", 0.6), ("placeholder", C.PLACEHOLDER, 0.85)]


@query(f"{LINES}, " + "h as (" + " union all ".join(f"select path, line, '{r}' rule, {c} c from lines where regexp_matches(text, '{_quoted(p)}')" for r, p, c in RULES) + ") select path, line, count(*) as n, round(least(0.999, 1 / (1 + exp(-sum(ln(c / (1 - c)))))), 6) as stacked from h group by 1, 2")
def security_rules(t):
    lines = standin.lines(t)
    hits = F.filter(F.array(*(F.when(F.col("text").rlike(p), F.lit(c)) for _, p, c in RULES)), lambda x: x.isNotNull())
    any_rule = "|".join(f"(?:{p})" for _, p, _ in RULES)
    rows = lines.where(F.col("text").rlike(any_rule)).select("path", "line", F.explode(hits).alias("c"))
    return S.stack_evidence(rows, ["path", "line"], "c").select("path", "line", "n", F.round("stacked", 6).alias("stacked"))


@query(f"""{LINES}, h as (select distinct path, line, text from lines where {STUB}), n as (select *, row_number() over (partition by path order by line, text) n from h) select path, line, text from n where n <= 3""")
def implementation_gap(t):
    stub = F.col("text").rlike(C.PLACEHOLDER) | F.col("text").rlike(C.NOT_IMPLEMENTED)
    w = Window.partitionBy("path").orderBy("line", "text")
    return standin.lines(t).where(stub).select("path", "line", "text").distinct().withColumn("n", F.row_number().over(w)).where("n <= 3").drop("n")


@query(FILES + """, c as (select file_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '//[^\\n]*', '', 'g'), '#[^\\n]*', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g'), '"(?:[^"\\\\]|\\\\.)*"', '""', 'g') c from files),
k as (select file_id, regexp_extract_all(c, '[a-zA-Z_]\\w*|[0-9]+|[{}()\\[\\];,.:=<>!+\\-*/%&|^~?]') k from c), h as (select file_id, len(k)::int n, md5(array_to_string(k, ' ')) m, list_reduce(list_prepend(0::bigint, list_transform(string_split(array_to_string(k, ''), ''), lambda x: ord(x)::bigint)), lambda a, x: (a * 31 + x) % 4294967296) h from k where len(k) > 0)
select file_id, n, m, (case when h >= 2147483648 then h - 4294967296 else h end)::int as hash from h""")
def body_token_hash(t):
    k = _files(t).select("file_id", C.body_tokens(F.col("content")).alias("k")).where("size(k) > 0")
    return k.select("file_id", F.size("k").alias("n"), F.md5(F.array_join("k", " ")).alias("m"), C.hash31(F.array_join("k", "")).alias("hash"))


def _domain_sql(name: str, body: str) -> str:
    what = {"N": f"lower({name})", "L": f"lower({name})", "B": f"lower({name}) || lower({body})"}
    return "case " + " ".join(f"when regexp_matches({what[k]}, '{p}')" + (f" and length({name}) < 15" if k == "L" else "") + f" then '{d}'" for d, k, p in C.DOMAINS) + " else 'general' end"


@query(f"""{LINES}, i as (select file_id, line, text, unnest(regexp_extract_all(text, '{NAMED}', 1)) name from lines) select {_domain_sql("name", "text")} as domain, count(*) as n, min(name) as first_name from i group by 1""")
def function_domains(t):
    found = F.regexp_extract_all("text", F.lit(NAMED), F.lit(1))
    rows = standin.lines(t).select("text", F.explode(found).alias("name"))
    return rows.groupBy(C.domain(F.col("name"), F.col("text")).alias("domain")).agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


def _mask_sql(col: str) -> str:
    for p in C.SECRETS:
        col = f"regexp_replace({col}, '{p}', '[masked]', 'g')"
    keyed = _quoted(C.KEYED_SECRET)
    return f"regexp_replace(regexp_replace({col}, '{C.URL_SECRET}', '\\1[masked]@', 'g'), '{keyed}', '\\1\\2[masked]', 'g')"


@query(f"""{LINES} select {_mask_sql("text")} as masked, count(*) as n from lines where {_mask_sql("text")} <> text group by 1""")
def secret_masking(t):
    return C.masked_lines(standin.lines(t))


@query(f"""{LINES}, d as (select distinct path, line, text from lines), s as (select path, line, text, lead(line) over (partition by path order by line, text) nxt, max(line) over (partition by path) last from d where regexp_matches(text, '\\bfunction\\b')) select path, line, coalesce(nxt - 1, last) as end_line from s""")
def function_ends(t):
    w = Window.partitionBy("path").orderBy("line", "text")
    rows = standin.lines(t).where(F.col("text").rlike(r"\bfunction\b")).select("path", "line", "text").distinct()
    return rows.select("path", "line", F.coalesce(F.lead("line").over(w) - 1, F.max("line").over(Window.partitionBy("path"))).alias("end_line"))


@query(f"""{LINES}, d as (select distinct path, line, text from lines), h as (select *, max(case when starts_with(text, '//') or starts_with(text, '#') then line end) over (partition by path order by line, text) hl from d) select path, line, text, hl as heading_line from h where not starts_with(text, '//') and not starts_with(text, '#') and hl is not null""")
def heading_carry_forward(t):
    head = F.col("text").startswith("//") | F.col("text").startswith("#")
    w = Window.partitionBy("path").orderBy("line", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = standin.lines(t).select("path", "line", "text").distinct().withColumn("heading_line", F.last(F.when(head, F.col("line")), ignorenulls=True).over(w))
    return rows.where(~head & F.col("heading_line").isNotNull())


@query(f"""{LINES}, d as (select distinct path, line, text from lines), g as (select *, sum((text = '')::int) over (partition by path order by line, text rows unbounded preceding) g from d), l as (select path, g, text, lag(text) over (partition by path, g order by line, text) p from g where text <> '')
select path, g::bigint as block, count(*) as n, bool_and(p is null or text >= p) as ordered from l group by 1, 2""")
def sorted_blocks(t):
    w = Window.partitionBy("path").orderBy("line", "text")
    rows = standin.lines(t).select("path", "line", "text").distinct()
    blocks = rows.withColumn("block", F.sum((F.col("text") == "").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("text <> ''")
    before = F.lag("text").over(Window.partitionBy("path", "block").orderBy("line", "text"))
    return blocks.withColumn("ok", before.isNull() | (F.col("text") >= before)).groupBy("path", "block").agg(F.count("*").alias("n"), F.bool_and("ok").alias("ordered"))


OP = "case when regexp_matches(text, '\\bawait\\b') then 'async' when regexp_matches(text, '^return\\b') then 'return' when regexp_matches(text, '^throw\\b') then 'throw' when regexp_matches(text, '^(const|let)\\b') then 'assign' else 'call' end"


@query(f"""{LINES}, d as (select distinct path, line, text from lines where text <> ''), o as (select path, line, text, {OP} op from d), l as (select *, lag(op) over (partition by path order by line, text) p from o) select path, string_agg(op, '>' order by line, text) as ops, count(*) as n from l where p is null or p <> op group by 1""")
def operation_sequence(t):
    x = F.col("text")
    op = F.when(x.rlike(r"\bawait\b"), "async").when(x.rlike(r"^return\b"), "return").when(x.rlike(r"^throw\b"), "throw").when(x.rlike(r"^(const|let)\b"), "assign").otherwise("call")
    listed = F.array_sort(F.collect_list(F.struct("line", "text", "op")))
    rows = standin.lines(t).where("text <> ''").select("path", "line", "text").distinct().withColumn("op", op).groupBy("path").agg(listed.alias("l"))
    kept = F.filter("l", lambda e, i: (i == 0) | (F.get(F.col("l"), i - 1)["op"] != e["op"]))
    return rows.select("path", kept.alias("k")).select("path", F.array_join(F.transform("k", lambda e: e["op"]), ">").alias("ops"), F.size("k").cast("long").alias("n"))


@query(f"""{LINES}, e as (select path, line from lines where text like 'export %'), a as (select path, line, text from lines where regexp_matches(text, 'console|logger')) select distinct e.path, e.line, exists (select 1 from a where a.path = e.path and a.line between e.line - 5 and e.line + 20) as logged from e""")
def route_context(t):
    near = F.col("text").rlike("console|logger")
    return C.near_lines(standin.lines(t), ["path"], F.col("text").startswith("export "), near, 5, 20).select("path", "line", F.col("adjacent").alias("logged")).distinct()


@query(f"""{FILES}, x as (select distinct dir, regexp_extract(path, '([0-9]+)-', 1) base from files where path like '%.test.ts') select f.file_id, x.base is not null as tested from (select *, regexp_extract(path, '([0-9]+)-', 1) base from files where path not like '%.test.ts') f left join (select distinct dir from x) y using (dir) left join x on x.dir = f.dir and x.base = f.base""")
def adjacent_tests(t):
    files = _files(t).select("file_id", "dir", "path", F.regexp_extract("path", "([0-9]+)-", 1).alias("base"))
    tests = files.where("path like '%.test.ts'").select("dir", "base", F.lit(True).alias("t")).distinct()
    return files.where("path not like '%.test.ts'").join(tests, ["dir", "base"], "left").select("file_id", F.coalesce("t", F.lit(False)).alias("tested"))
