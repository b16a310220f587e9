"""Dangerous lines, usage records and payloads written out from line items, events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import security as S
from plumbline.operators import usage as U
from plumbline.plans.registry import query
from plumbline.sinks import compact as C

# Lines of files, what they are found by, and as what; the fifth needs the fourth within five lines.
_LINES = [
    ("const total = sum(rows);", None, None), ("db.query(`DELETE FROM t WHERE a = ${id}`);", "sql-injection", "error"), ("eval(text); // no-eval", None, None), ("const session = open();", None, None), ("const n = Math.random();", "math-random-crypto", "info"),
    ('const apiKey = "abcdefghij0123456789";', "hardcoded-api-key", "error"), ('const apiKey = "your_abcdefghij0123456789";', None, None), ("box.innerHTML = text;", "innerHTML-assignment", "info"), ("fetch(config.url + path);", None, None), ("fetch(host + path);", "ssrf-risk", "info"),
]
_AT = "cast((l_partkey * 7 + l_suppkey + l_linenumber * 3) % 10 as int)"


_TABLE = ", ".join("({}, '{}', {}, {})".format(i, text, *(f"'{v}'" if v else "null" for v in (rule, severity))) for i, (text, rule, severity) in enumerate(_LINES))


@query(f"""with r(k, text, rule, severity) as (values {_TABLE}),
l as (select 'src/f' || cast(l_orderkey as varchar) || '.js' as path, row_number() over (partition by l_orderkey order by l_linenumber, text)::int as line, k, rule, severity from lineitem join r on k = {_AT})
select path, line, rule, severity from l where rule is not null and (k <> 4 or exists (select 1 from l n where n.path = l.path and n.k in (3, 5, 6) and abs(n.line - l.line) <= 5))""")
def dangerous_lines(t):
    """Lines that meet a rule, nothing that clears them and what must be near; the SQL knows which line was written where."""
    text = F.get(F.array(*(F.lit(x) for x, *_ in _LINES)), F.expr(_AT))
    rows = t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", text.alias("text")))), lambda x: x["text"]), "\n").alias("content"))
    files = rows.select(F.format_string("src/f%d.js", "l_orderkey").alias("path"), F.lit("javascript").alias("language"), "content")
    return S.scan(files).select("path", "line", "rule", "severity")


@query("""with e as (select user_id, event_id, event_type, floor(value)::bigint as v from events),
s as (select user_id, event_id, sum((event_type = 'view')::int) over (partition by user_id order by event_id) as m, event_type, v from e),
m as (select user_id, m, max(case when event_type = 'view' then v end) as input, coalesce(arg_max(v, event_id) filter (event_type = 'click'), 0) as output from s where m > 0 and event_type in ('view', 'click') group by all),
t as (select user_id, sum(input)::bigint as input, sum(output)::bigint as output, count(*) as turns from m group by 1),
r as (select user_id, arg_max(v, event_id) as v from e where event_type = 'purchase' and event_id % 3 = 0 group by 1),
c as (select user_id, count(*) filter (event_type = 'error') as compactions from e group by 1)
select c.user_id as run, case when r.v is not null then r.v * 2 else coalesce(t.input, 0) end as input_tokens, case when r.v is not null then r.v else coalesce(t.output, 0) end as output_tokens, case when r.v is not null then 9 else coalesce(t.turns, 0) end as turns, compactions, case when r.v is not null then 'result' else 'messages' end as basis
from c left join t using (user_id) left join r using (user_id)""")
def usage_totals(t):
    """Tokens of each user's records: views start messages, clicks count their output up, some purchases are totals, errors compact."""
    v = F.floor("value").cast("long")
    text = (
        F.when(F.col("event_type") == "view", F.format_string('{"type":"message_start","message":{"usage":{"input_tokens":%d}}}', v))
        .when(F.col("event_type") == "click", F.format_string('{"type":"stream_event","event":{"type":"message_delta","usage":{"output_tokens":%d}}}', v))
        .when((F.col("event_type") == "purchase") & (F.col("event_id") % 3 == 0), F.format_string('{"type":"result","num_turns":9,"usage":{"input_tokens":%d,"output_tokens":%d}}', v * 2, v))
        .when(F.col("event_type") == "error", '{"type":"system","subtype":"compact_boundary"}')
        .otherwise("{not json")
    )
    rows = t("events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), text.alias("text"))
    return U.totals(rows).select("run", "input_tokens", "output_tokens", "turns", "compactions", "basis")


# The JSON of a payload is {"dna":{"functions":[...],"groups":["g"]},"files":[...]} with entries of ten letters.
_LIST = lambda n: f"(2 + {n} * 12 + greatest({n} - 1, 0))"


@query(f"""with p as (select o_orderkey as key, o_custkey % 30 as a, o_orderkey % 40 as b from orders), s as (select key, a, 46 + {_LIST('a')} + {_LIST('b')} as whole, 33 + {_LIST('b')} as bare from p),
z as (select *, whole > 400 and a > 0 as cut, case when whole > 400 and a > 0 then bare else whole end as mid from s)
select key, whole as bytes_before, array_to_string(list_filter([case when cut then 'functions' end, case when mid > 400 then 'files' end], lambda x: x is not null), ',') as trimmed from z""")
def payload_compaction(t):
    """What goes from each payload until it has 400 bytes at most."""
    entries = lambda n, letter: F.array_repeat(F.lit(letter * 10), n.cast("int"))
    rows = t("orders").select(F.col("o_orderkey").alias("key"), F.struct(entries(F.col("o_custkey") % 30, "x").alias("functions"), F.array(F.lit("g")).alias("groups")).alias("dna"), *(F.lit(None).cast(k).alias(c) for c, k in (("findings", "array<struct<message:string,locations:array<struct<file:string,line:int,snippet:string>>>>"), ("drifts", "array<struct<message:string,files:array<string>,truncated:int>>"), ("scores", "map<string,struct<score:double,findings:int>>"))), entries(F.col("o_orderkey") % 40, "y").alias("files"))
    return C.compact(rows, 400).select("key", "bytes_before", F.array_join("trimmed", ",").alias("trimmed"))
