"""Functions, input flows and prompts over stand-ins made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators import functions as X
from plumbline.operators import taint
from plumbline.plans import standin
from plumbline.plans.registry import query
from plumbline.streaming import processor

# Each order is a file of three functions, with braces in strings, remarks, types and defaults.
_K = "cast(o_orderkey as string)"
SOURCE = (
    f"'// {{ not code' || chr(10) || 'export async function load' || {_K} || '(id: string, o = {{ a: [1, 2] }}): Promise<{{ a: number }}> {{' || chr(10) || '  const x = \"}}\";' || chr(10) || '  return find(id, x);' || chr(10) || '}}' || chr(10)"
    f" || repeat(chr(10), cast(o_custkey % 4 as int)) || 'const make' || {_K} || ' = (a, b) => {{' || chr(10) || '  if (a) {{ return b + 1; }}' || chr(10) || '  return a;' || chr(10) || '}};' || chr(10) || 'function no() {{ }}' || chr(10)"
).replace("{{", "{").replace("}}", "}")
_FILES = {"path": f"'src/' || {_K} || '.ts'", "language": "'typescript'", "content": SOURCE}


def _functions(t):
    return X.extract(t("orders").select(*(F.expr(v).alias(k) for k, v in _FILES.items())))


@query(f"""select path, 'load' || {_K} as name, 2 as start_line, 5 as end_line, 2 as params from (select *, {_FILES['path']} path from orders)
union all select path, 'make' || {_K}, (6 + o_custkey % 4)::int, (9 + o_custkey % 4)::int, 2 from (select *, {_FILES['path']} path from orders)""")
def function_extraction(t):
    """Name, lines and parameters of each function; the SQL states what the stand-in files hold."""
    return _functions(t).select("path", "name", "start_line", "end_line", "params")


@query("select case when a = 0 then 'load' else 'make' end as kind, count(*) as copies, count(distinct o_orderkey) as files, md5(case when a = 0 then 'const ID0 = STR ; return find ( ID1 , ID0 ) ;' else 'if ( ID0 ) { return ID1 + NUM ; } return ID0 ;' end) as digest from orders, (values (0), (1)) v(a) group by all")
def normalised_duplicates(t):
    """Functions whose normalised tokens are equal, by digest, in two files or more."""
    rows = _functions(t).select("path", F.substring("name", 1, 4).alias("kind"), F.md5(F.array_join(X.normalised("body"), " ")).alias("digest"))
    return rows.groupBy("kind", "digest").agg(F.count("*").alias("copies"), F.count_distinct("path").alias("files")).where("files >= 2")


@query("select path, name, 1.0::double as score from (select 'src/' || o_orderkey::varchar || '.ts' path, 'make' || o_orderkey::varchar as name from orders) order by path limit 20")
def similar_functions(t):
    """The 20 functions most like one body with other names; equal scores go by path."""
    return X.similar_to_body(_functions(t), "function other(p, q) { if (p) { return q + 7; } return p; }").select("path", "name", "score")


FLOW_LINES = ["const id = req.params.id;", "const name = req.query.name;", "db.Query(id);", "eval(name);", "box.innerHTML = name;", "const n = Number(id);", "schema.parse(name);", "fetch(id + name);", "const p = path.join(id);", "fs.readFile(id, done);", "run();"]
_FLOW = "cast((l_partkey * 13 + l_linenumber * 5 + l_suppkey) % 11 as int)"
_TEXT = f"case {_FLOW} " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(FLOW_LINES)) + " end"


@query(f"""with l as (select l_orderkey fn, l_linenumber line, {_TEXT} as text from lineitem),
src as (select fn, line, case when text like '%params%' then 'id' else 'name' end as variable, case when text like '%params%' then 'URL parameter' else 'query parameter' end as source from l where text like '%req.%'),
snk as (select fn, line, text, case when text like 'db%' then 'SQL query' when text like 'eval%' then 'code evaluation' when text like 'box%' then 'HTML injection' when text like 'fetch%' then 'outbound HTTP fetch' else 'file read' end as sink, case when text like 'db%' then 'sql_injection' when text like 'eval%' then 'code_injection' when text like 'box%' then 'xss' when text like 'fetch%' then 'ssrf' else 'path_traversal' end as category from l where regexp_matches(text, '^(db|eval|box|fetch|fs)')),
m as (select k.fn, variable, source, max(s.line) as source_line, sink, category, case when category in ('ssrf', 'path_traversal') then 'warning' else 'error' end as severity, k.line as sink_line from snk k join src s on s.fn = k.fn and s.line <= k.line and contains(k.text, variable) group by all)
select * from m where not exists (select 1 from l where l.fn = m.fn and l.line between m.source_line and m.sink_line and contains(l.text, m.variable) and ((l.text like 'const n = Number%' and category = 'sql_injection') or (l.text like 'const p = path%' and category = 'path_traversal') or l.text like 'schema%'))""")
def taint_flows(t):
    """Inputs that reach a dangerous call in their function without a cure on the way."""
    lines = t("lineitem").select(F.col("l_orderkey").alias("fn"), F.col("l_linenumber").alias("line"), F.expr(_TEXT).alias("text"), F.lit("javascript").alias("language"))
    return taint.flows(lines, ["fn"])


@query("""with p as (select conv_id, turn, trim(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g')) as line from conversations)
select conv_id, turn, case when length(line) > 80 then line[1:77] || '...' else line end as task from p""")
def task_summaries(t):
    """The first line of each turn, in 80 characters."""
    line = F.trim(F.regexp_replace(F.split("text", "\n")[0], r"\s+", " "))
    return t("conversations").select("conv_id", "turn", F.when(F.length(line) > 80, F.concat(F.substring(line, 1, 77), F.lit("..."))).otherwise(line).alias("task"))


@query()
def session_fold(t):
    """The session fold over the event table: clicks edit, errors flag, purchases resolve, signups prompt."""
    kind = F.expr("case event_type when 'click' then 'edit' when 'error' then 'flag' when 'purchase' then 'resolve' when 'signup' then 'prompt' end")
    file, category = F.concat(F.lit("src/f"), (F.floor("value") % 7).cast("string"), F.lit(".ts")), F.element_at(F.array(*map(F.lit, ("naming", "redundancy", "scope"))), (F.floor("value") % 3 + 1).cast("int"))
    text = F.when(kind == "prompt", F.concat(F.lit("Work on "), file)).otherwise((F.floor("value") % 5).cast("string"))
    return processor.session_table(t("events").select(F.col("user_id").cast("string").alias("sid"), F.col("event_id").cast("string").alias("aid"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("type"), file.alias("file"), category.alias("category"), text.alias("text")))


@query("""with e as (select user_id, floor(value)::bigint % 5 as finding, event_type, ts, event_id from events where event_type in ('error', 'purchase', 'signup')),
g as (select user_id, finding, count(*) filter (event_type = 'error') raised, count(*) filter (event_type = 'signup') decided, arg_max(event_type, (ts, event_id)) filter (event_type <> 'signup') last from e group by 1, 2)
select user_id, finding, raised, decided, case when last = 'error' then 'open' else 'resolved' end as state, last = 'error' and decided = 0 as awaits from g where raised > 0""")
def finding_states(t):
    """Whether each raised finding is open, and whether it awaits a decision; the last raise or resolution holds."""
    e = t("events").where("event_type in ('error', 'purchase', 'signup')").select("user_id", (F.floor("value") % 5).alias("finding"), "event_type", "ts", "event_id")
    last = F.max_by(F.when(F.col("event_type") != "signup", F.col("event_type")), F.when(F.col("event_type") != "signup", F.struct("ts", "event_id")))
    g = e.groupBy("user_id", "finding").agg(F.count_if(F.col("event_type") == "error").alias("raised"), F.count_if(F.col("event_type") == "signup").alias("decided"), last.alias("last")).where("raised > 0")
    open_ = F.col("last") == "error"
    return g.select("user_id", "finding", "raised", "decided", F.when(open_, "open").otherwise("resolved").alias("state"), (open_ & (F.col("decided") == 0)).alias("awaits"))


@query(f"with {standin.FINDINGS}, r as (select path, id, message, dup_size >= 4 as strong, row_number() over (partition by path order by (dup_size >= 4) desc, line, id) as place from findings) select path, id, message, strong, place from r where place <= 3")
def advisory_ranking(t):
    """The first three findings of each file: strong duplicates first, the others as they come."""
    strong = F.col("dup_size") >= 4
    w = Window.partitionBy("path").orderBy(strong.desc(), "line", "id")
    return standin.findings(t).select("path", "id", "message", strong.alias("strong"), F.row_number().over(w).cast("long").alias("place")).where("place <= 3")


@query("select d.doc_id, d.source, e.label, len(e.embedding)::int as dims from documents d join embeddings e on e.vec_id = d.doc_id")
def embedding_index_join(t):
    """Rows of the index: documents with the vector of the same id."""
    vectors = t("embeddings").select(F.col("vec_id").alias("doc_id"), "label", F.size("embedding").alias("dims"))
    return t("documents").select("doc_id", "source").join(vectors, "doc_id").select("doc_id", "source", "label", "dims")
