"""Edits written out from events, checked against a baseline, and votes on architecture over files written out from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import architecture as A
from plumbline.operators import functions as FN
from plumbline.plans.registry import query
from plumbline.streaming import edit_check as E

_AWAITS = "async function first(a) {\n  const x = await load(a);\n  const y = await keep(x);\n  return y;\n}\n"
_THENS = "function first(a) {\n  load(a).then(keep);\n  load(a).then(send);\n}\n"
_FETCH = "async function second(u) {\n  const r = await fetch(u);\n  const t = await r.text();\n  return t;\n}\n"
_NULLS = "function third(a) {\n  if (!a) { return null; }\n  return store.load(a);\n}\n"
_TOTAL = "function {}({}) {{\n  let {} = 0;\n  for (const {} of {}) {{ {} += {}.price * {}.count - {}.rebate; }}\n  return {};\n}}\n"
_COPY = _TOTAL.format("other", "lines", "s", "l", "lines", "s", "l", "l", "l", "s")
#: Contents of edits: clean, chained, fetching, null returning, chained and fetching, a copy with other names.
CONTENTS = [_AWAITS, _THENS, _FETCH, _NULLS, _THENS + _FETCH, _COPY]
_EDIT = "select cast(user_id % 40 as varchar) as project, cast(event_id as varchar) as edit_id, ts, 'src/f' || cast(floor(value)::bigint % 5 as varchar) || '.js' as path, event_id % 6 as content from events"
CONVENTIONS = [("async_patterns", "async_await"), ("architectural_consistency", "repository"), ("return_shape_consistency", "throws")]


def edits(t):
    contents = F.array(*map(F.lit, CONTENTS))
    return t("events").select((F.col("user_id") % 40).cast("string").alias("project"), F.col("event_id").cast("string").alias("edit_id"), F.col("ts").cast("timestamp").alias("ts"), F.format_string("src/f%d.js", F.floor("value").cast("long") % 5).alias("path"), F.get(contents, (F.col("event_id") % 6).cast("int")).alias("content"))


def baseline(t):
    """(conventions, index) of every project: three conventions and two functions."""
    projects = t("events").select((F.col("user_id") % 40).cast("string").alias("project")).distinct()
    rules = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.lit(p).alias("dominant")) for d, p in CONVENTIONS)))
    body = _TOTAL.format("total", "rows", "sum", "r", "rows", "sum", "r", "r", "r", "sum").split("{", 1)[1].rsplit("}", 1)[0]
    stored = F.explode(F.array(*(F.struct(F.lit(p).alias("path"), F.lit(n).alias("name"), F.lit(k).alias("start_line"), F.lit(b).alias("body")) for p, n, k, b in [("lib/sums.js", "total", 3, body), ("lib/texts.js", "join", 1, "\n  const parts = [];\n  return parts.join(a, b);\n")])))
    return projects.select("project", rules.alias("r")).select("project", "r.*"), E.indexed(projects.select("project", stored.alias("f")).select("project", "f.*"))


# An edit that chains in one function and awaits in another is mixed as a whole; its chains are still there for a finding on that function.
_FLAGS = f"""e as ({_EDIT}), f as (select project, edit_id, ts, path, unnest([
  {{'dimension': 'async_patterns', 'observed': 'then_chains', 'flagged': content = 1, 'shown': content in (1, 4)}}, {{'dimension': 'async_patterns', 'observed': 'mixed', 'flagged': content = 4, 'shown': content = 4}},
  {{'dimension': 'architectural_consistency', 'observed': 'http_client', 'flagged': content in (2, 4), 'shown': content in (2, 4)}},
  {{'dimension': 'return_shape_consistency', 'observed': 'null_sentinel', 'flagged': content = 3, 'shown': content = 3}}, {{'dimension': 'redundancy', 'observed': 'lib/sums.js:3', 'flagged': content = 5, 'shown': content = 5}}], recursive := true) from e)"""


@query(f"with {_FLAGS} select project, edit_id, path, dimension, observed from f where flagged")
def edit_findings(t):
    """What each edit brings in against its project's conventions and functions; the SQL knows which text was written."""
    return E.detect(edits(t), *baseline(t)).select("project", "edit_id", "path", "dimension", "observed")


@query(f"""with {_FLAGS}, n as (select *, row_number() over (partition by project, path, observed order by ts, edit_id) as n from f),
w as (select *, coalesce(max(case when flagged then n end) over past > coalesce(max(case when not shown then n end) over past, 0), false) as open from n window past as (partition by project, path, observed order by n rows between unbounded preceding and 1 preceding))
select project, edit_id, path, dimension, observed, case when flagged and not open then 'raised' when flagged then 'repeated' else 'resolved' end as kind from w where flagged or (open and not shown)""")
def edit_outcomes(t):
    """Findings raised, repeated and resolved by the edits of each file in order."""
    none = t("events").sparkSession.createDataFrame([], E.OPEN)
    return E.outcomes(edits(t), none, *baseline(t))[0].select("project", "edit_id", "path", "dimension", "observed", "kind")


# Files of a layered service: one for each order, in one of 24 folders by its customer; most take the first choice of each axis.
_K = {"access": "o_orderkey * 7 % 10", "errors": "o_orderkey * 3 % 11", "settings": "o_custkey % 9"}
_DIR = "'app/m' || cast(o_custkey % 24 as varchar)"
_FILE = f"{_DIR} || '/s' || cast(o_orderkey as varchar) || '.ts'"
_ACCESS = ["  const a = repo.load(id);\n", '  const a = sql("select * from t");\n  log("DELETE FROM t");\n', "  const a = fetch(id);\n"]
_ERRORS = ['  if (!a) { throw new InputError("none"); }\n', "  if (!a) { return null; }\n  res.status(404).json(a);\n", ""]


def layered_files(t):
    pick = lambda key, low, high: F.when(F.col(key) < low, 0).when(F.col(key) < high, 1).otherwise(2)
    rows = t("orders").select("o_orderkey", "o_custkey", *(F.expr(v).alias(k) for k, v in _K.items()))
    text = F.concat(F.lit("export function handle(id, res) {\n"), F.get(F.array(*map(F.lit, _ACCESS)), pick("access", 8, 9)), F.get(F.array(*map(F.lit, _ERRORS)), pick("errors", 8, 10)), F.when(F.col("settings") == 0, "  const u = process.env.URL;\n").otherwise("  const u = config.url;\n"), F.lit("  return send(a, u);\n}\n"))
    path = F.format_string("app/m%d/s%d.ts", F.col("o_custkey") % 24, F.col("o_orderkey"))
    return rows.select(path.alias("path"), F.lit("typescript").alias("language"), text.alias("content"))


def _votes(pairs: str) -> str:
    """SQL of a vote over (axis, folder, pattern): folders of three files with a share of .7 and deviators."""
    return f"""p as ({pairs}), n as (select axis, folder, pattern, count(*) as c from p group by all), g as (select axis, folder, sum(c)::bigint as total, max(c) as dominant_count, arg_max(pattern, c) as dominant from n group by 1, 2)
select axis, folder, dominant, dominant_count, total, cast(floor(dominant_count / total * 100 + 0.5) as bigint) as consistency, total - dominant_count as deviators from g where total >= 3 and dominant_count / total >= 0.7 and dominant_count < total"""


_KEYED = f"k as (select {_DIR} as folder, {', '.join(f'{v} as {k}' for k, v in _K.items())} from orders)"


@query(f"""with {_KEYED}, {_votes('''select 'data_access' as axis, folder, case when access < 8 then 'repository' when access < 9 then 'raw_sql' else 'http_client' end as pattern from k
union all select 'error_handling', folder, case when errors < 8 then 'wrap_with_context' else 'http_error_response' end from k where errors < 10
union all select 'configuration', folder, case when settings = 0 then 'env_direct' else 'config_struct_di' end from k''')}""")
def architecture_votes(t):
    """Folders that agree on an axis but for some of their files; all files inject nothing, so that axis says nothing."""
    return A.axis_findings(A.profiles(layered_files(t))).drop("severity")


@query(f"""with {_KEYED}, {_votes('''select 'shape' as axis, folder, case when errors < 8 then 'throws' else 'null_sentinel' end as pattern from k where errors < 10''')}""")
def return_shape_votes(t):
    """Folders that agree on an error path but for some of their files."""
    return A.shape_findings(FN.extract(layered_files(t))).withColumn("axis", F.lit("shape")).drop("severity")
