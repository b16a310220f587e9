"""Scores, ranks, ledgers and point queries over stand-ins for findings, events and runs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators import code as C
from plumbline.operators import scoring as S
from plumbline.plans import code_queries, standin
from plumbline.plans.registry import query

FOUND = f"with {standin.FINDINGS}"
IMPORTANCE = f"case when regexp_matches(path, '{C.GENERATED}') or regexp_matches(path, '{C.FIXTURE}') then 0.05 when regexp_matches(path, '{C.TEST}') or regexp_matches(path, '{C.EXAMPLE}') then 0.35 when regexp_matches(path, '(^|/)(index|main|app|server)\\.[A-Za-z0-9]+$') then 1.5 else 1.0 end"
SEVERITY = "case severity when 'error' then 0.7 when 'warning' then 0.4 else 0.12 end"
#: Analyzers a0 to a5 vote, the others count; two of these count copies.
SIGNAL = "case when analyzer <= 'a5' then consistency end"
FUNCTIONS, LINES_TOTAL = 5000, 4000


def _findings(t):
    f = standin.findings(t).withColumn("importance", C.importance(F.col("path")))
    votes = F.col("analyzer") <= "a5"
    return f.withColumn("consistency", F.when(votes, F.col("consistency"))).withColumn("total_relevant", F.when(votes, F.col("total_relevant"))).withColumn("dup_size", F.when(F.col("analyzer").isin("a6", "a7"), F.col("dup_size")).otherwise(F.lit(0)))


DAMAGE = f"""{FOUND}, i as (select *, {IMPORTANCE} imp, {SIGNAL} cons, case when analyzer <= 'a5' then total_relevant end tr, case when analyzer in ('a6', 'a7') then dup_size else 0 end ds from findings),
g as (select category, analyzer, count(*) n, max({SEVERITY}) s, avg(confidence) c, max(imp) imp, bool_and(cons is not null) sig, max(1 - cons / 100.0) worst, bool_or(ds > 1) dup, sum(case when ds > 1 then (ds - 1) * imp else 0 end) copies, max(tr) tr from i group by 1, 2),
m as (select category, analyzer, n, least(0.85, s * c * case when not sig and dup then 1 else imp end * case when sig then (case when worst <= 0 then 0 else greatest(0.05, least(1, worst)) end) when dup then 1 - exp(-(copies / {FUNCTIONS}) / 0.15) else 1 - exp(-(n::double / {FUNCTIONS}) / 0.5) end
 * case when coalesce(tr, 0) <= 0 then 1 else least(1, tr / 8.0) end) damage from g)"""


@query(f"{DAMAGE} select category, analyzer, n, round(damage, 6) as damage from m")
def detector_damages(t):
    return S.detector_damage(_findings(t), FUNCTIONS, LINES_TOTAL / 1000).withColumn("damage", F.round("damage", 6))


WEIGHTS = [("c0", 16), ("c1", 14), ("c2", 12), ("c3", 10), ("c9", 8)]
WEIGHTS_SQL = "w as (select * from (values " + ", ".join(f"('{c}', {w})" for c, w in WEIGHTS) + ") v(category, weight))"


@query(f"""{DAMAGE}, {WEIGHTS_SQL}, h as (select category, product(1 - damage) health, sum(n)::bigint findings from m group by 1)
select category, weight, coalesce(findings, 0) as findings, floor(weight * coalesce(health, 0.8 + 0.2 * (1 - exp(-{LINES_TOTAL} / 2500.0))) * 10 + 0.5) / 10 as score from w left join h using (category)""")
def category_scores(t):
    f = _findings(t)
    dim = f.sparkSession.createDataFrame(WEIGHTS, "category string, weight int")
    return S.category_scores(S.detector_damage(f, FUNCTIONS, LINES_TOTAL / 1000), F.broadcast(dim), LINES_TOTAL)


@query(f"""{FOUND}, i as (select *, {IMPORTANCE} imp from findings), g as (select path, analyzer, count(*) n, least(0.85, max({SEVERITY}) * avg(confidence) * max(imp)) d from i group by 1, 2) select path, sum(n)::bigint as findings, floor(100 * product(1 - d) + 0.5)::bigint as score from g group by 1""")
def file_scores(t):
    return S.file_scores(_findings(t))


PRIORITY = "case when category = 'c0' then 10 when category = 'c1' then 8 when category = 'c2' then 6 when category = 'c3' then 5 else 2 end * case severity when 'error' then 3 when 'warning' then 2 else 1 end"


@query(f"{FOUND} select id, category, severity, confidence, {PRIORITY} as priority from findings where confidence >= 0.5 order by priority desc, confidence desc, id limit 30")
def fix_plan_top(t):
    top = F.expr("case category when 'c0' then 10 when 'c1' then 8 when 'c2' then 6 when 'c3' then 5 else 2 end")
    sev = F.expr("case severity when 'error' then 3 when 'warning' then 2 else 1 end")
    return standin.findings(t).where("confidence >= 0.5").withColumn("priority", top * sev).select("id", "category", "severity", "confidence", "priority").orderBy(F.desc("priority"), F.desc("confidence"), "id").limit(30)


@query(f"""{FOUND}, k as (select *, case when confidence >= 0.85 then 'high' when confidence >= 0.5 then 'medium' else 'dropped' end tier from findings), r as (select *, row_number() over (partition by analyzer, tier order by confidence desc, id) n from k)
select analyzer, tier, count(*) as n, min(case when n = 1 then id end) as best, count(*) filter (tier <> 'medium' or n <= 5) as kept from r group by 1, 2""")
def confidence_triage(t):
    tier = F.when(F.col("confidence") >= 0.85, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("dropped")
    best = F.min_by("id", F.struct(-F.col("confidence"), F.col("id")))
    g = standin.findings(t).groupBy("analyzer", tier.alias("tier")).agg(F.count("*").alias("n"), best.alias("best"))
    return g.withColumn("kept", F.when(F.col("tier") == "medium", F.least("n", F.lit(5))).otherwise(F.col("n")).cast("long"))


@query(f"""{FOUND}, r as (select *, row_number() over (partition by analyzer, message order by path, line, id) n, count(*) over (partition by analyzer, message) total from findings) select analyzer, message, max(total) as total, string_agg(path || ':' || line::int, ' ' order by n) as locations from r where n <= 15 group by 1, 2""")
def finding_projection(t):
    w = Window.partitionBy("analyzer", "message").orderBy("path", "line", "id")
    f = standin.findings(t).withColumn("n", F.row_number().over(w))
    totals = f.groupBy("analyzer", "message").agg(F.max("n").cast("long").alias("total"), F.array_sort(F.collect_list(F.when(F.col("n") <= 15, F.struct("n", F.concat("path", F.lit(":"), F.col("line").cast("int").cast("string")).alias("at"))))).alias("l"))
    return totals.select("analyzer", "message", "total", F.array_join(F.transform("l", lambda x: x["at"]), " ").alias("locations"))


@query(f"""{FOUND}, c as (select count(*) filter (analyzer = 'a6' and dup_size > 1) n, count(*) filter (analyzer = 'a6' and dup_size > 1) / {LINES_TOTAL / 1000} per from findings) select analyzer, case when analyzer <> 'a6' or (c.n >= 3 and per >= 1) then 'scored' else 'hygiene' end as track, count(*) as n from findings, c group by 1, 2""")
def retag_gate(t):
    f = standin.findings(t)
    many = F.count_if((F.col("analyzer") == "a6") & (F.col("dup_size") > 1))
    gate = F.broadcast(f.agg(((many >= 3) & (many / (LINES_TOTAL / 1000) >= 1)).alias("open")))
    return f.groupBy("analyzer").agg(F.count("*").alias("n")).join(gate).select("analyzer", F.when((F.col("analyzer") != "a6") | F.col("open"), "scored").otherwise("hygiene").alias("track"), "n")


@query(f"""{FOUND}, p as (select path, {", ".join(f"count(*) filter (category = 'c{i}') c{i}" for i in range(5))} from findings group by 1) select *, round(100.0 * ((c0 = 0)::int + (c1 = 0)::int + (c2 = 0)::int + (c3 = 0)::int + (c4 = 0)::int) / 5, 1)::double as coherence from p""")
def file_coherence(t):
    p = standin.findings(t).groupBy("path").pivot("category", [f"c{i}" for i in range(5)]).agg(F.count(F.lit(1))).fillna(0)
    return p.withColumn("coherence", F.round(100.0 * sum((F.col(f"c{i}") == 0).cast("int") for i in range(5)) / 5, 1))


@query(f"""{FOUND}, r as (select *, row_number() over (partition by category order by total_relevant desc, id) n from findings) select category, id, total_relevant, consistency, message from r where n = 1""")
def baseline_votes(t):
    best = F.min_by(F.struct("id", "total_relevant", "consistency", "message"), F.struct(-F.col("total_relevant"), F.col("id")))
    return standin.findings(t).groupBy("category").agg(best.alias("b")).select("category", "b.*")


@query(f"{FOUND}, r as (select *, row_number() over (partition by category order by id) n from findings) select category, id, severity, message from r where n = 1")
def first_per_category(t):
    return standin.findings(t).groupBy("category").agg(F.min_by(F.struct("id", "severity", "message"), "id").alias("b")).select("category", "b.*")


@query(f"{FOUND} select path, bool_or(analyzer = 'a3' and severity = 'error') as tripped, count(distinct analyzer) filter (analyzer = 'a3' and severity = 'error') as rules from findings group by 1")
def floor_trip(t):
    hit = (F.col("analyzer") == "a3") & (F.col("severity") == "error")
    return standin.findings(t).groupBy("path").agg(F.bool_or(hit).alias("tripped"), F.count_distinct(F.when(hit, F.col("analyzer"))).alias("rules"))


@query("select l_suppkey % 20 as grp, count(*) as n, list_sort(list(l_quantity))[(floor(count(*) / 2.0) + 1)::int] as median, list_sort(list(l_quantity))[(least(floor(count(*) * 0.9), count(*) - 1) + 1)::int] as p90, max(l_quantity) as top from lineitem group by 1")
def index_summary(t):
    """Median and ninetieth percentile by index, without interpolation."""
    hist = t("lineitem").groupBy((F.col("l_suppkey") % 20).alias("grp"), "l_quantity").agg(F.count("*").alias("c"))
    w = Window.partitionBy("grp").orderBy("l_quantity")
    run = hist.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("grp")))
    pick = lambda at: F.min(F.when(F.col("upto") > at, F.col("l_quantity")))
    return run.groupBy("grp").agg(F.max("n").alias("n"), pick(F.floor(F.col("n") / 2)).alias("median"), pick(F.least(F.floor(F.col("n") * 0.9), F.col("n") - 1)).alias("p90"), F.max("l_quantity").alias("top"))


@query(f"""{FOUND}, s as (select path, greatest(0, least(1, 0.25 * bool_or(severity = 'error')::int + 0.2 * bool_or(analyzer = 'a2')::int - 0.1 * (not bool_or(category = 'c1'))::int + 0.15 * bool_or(confidence > 0.8)::int)) score from findings group by 1)
select path, round(score, 4)::double as score, case when score >= 0.35 then 'justified' when score >= 0.15 then 'uncertain' else 'accidental' end as verdict from s""")
def deviation_justification(t):
    any_ = lambda c: F.bool_or(c).cast("int")
    raw = 0.25 * any_(F.col("severity") == "error") + 0.2 * any_(F.col("analyzer") == "a2") - 0.1 * (1 - any_(F.col("category") == "c1")) + 0.15 * any_(F.col("confidence") > 0.8)
    g = standin.findings(t).groupBy("path").agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4).alias("score"))
    return g.withColumn("verdict", F.when(F.col("score") >= 0.35, "justified").when(F.col("score") >= 0.15, "uncertain").otherwise("accidental"))


@query(f"""{FOUND}, a as (select path, line from findings where analyzer = 'a1'), b as (select path, line from findings where analyzer = 'a2') select 'all' as kind, count(*) as n from (select * from a union all select * from b) union all select 'distinct', count(*) from (select * from a union select * from b) union all select 'except', count(*) from (select * from a except select * from b) union all select 'intersect', count(*) from (select * from a intersect select * from b)""")
def layer_set_operations(t):
    f = standin.findings(t)
    a, b = (f.where(F.col("analyzer") == x).select("path", "line") for x in ("a1", "a2"))
    kinds = {"all": a.unionByName(b), "distinct": a.unionByName(b).distinct(), "except": a.subtract(b), "intersect": a.intersect(b)}
    out = None
    for kind, rows in kinds.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"{FOUND}, r as (select id, analyzer, severity, row_number() over (order by case severity when 'error' then 0 when 'warning' then 1 else 2 end, analyzer, id) as place from findings where confidence > 0.85) select * from r where place <= 200")
def diff_ordering(t):
    rank = F.expr("case severity when 'error' then 0 when 'warning' then 1 else 2 end")
    top = standin.findings(t).where("confidence > 0.85").select("id", "analyzer", "severity", rank.alias("k")).orderBy("k", "analyzer", "id").limit(200)
    return top.withColumn("place", F.row_number().over(Window.orderBy("k", "analyzer", "id")).cast("long")).drop("k")


@query(f"{FOUND}, s as (select *, 10 * (regexp_matches(path, '(main|index|app|server|lib|mod)[.]'))::int + 3 * dup_size + least(total_relevant / 20.0, 5) + 3 * (message = 'rule 3')::int score from findings) select id, round(score, 6)::double as score from s order by score desc, id limit 30")
def function_sampler(t):
    score = 10 * F.col("path").rlike("(main|index|app|server|lib|mod)[.]").cast("int") + 3 * F.col("dup_size") + F.least(F.col("total_relevant") / 20.0, F.lit(5.0)) + 3 * (F.col("message") == "rule 3").cast("int")
    return standin.findings(t).select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(30)


ZONE = "case when d < 0.25 then 'green' when d < 0.5 then 'yellow' else 'red' end"


@query(f"""with recursive e as (select user_id, event_id, ts, case when event_type = 'error' then 0.3 + (floor(value)::int % 5) / 10.0 else (floor(value)::int % 7) / 10.0 end d, row_number() over (partition by user_id order by ts, event_id) r from events),
z as (select *, {ZONE} raw from e), k(user_id, event_id, r, d, zone) as (select user_id, event_id, r, d, case when raw = 'yellow' and d < 0.3 then 'green' else raw end from z where r = 1
union all select z.user_id, z.event_id, z.r, z.d, case when (k.zone = 'green' and raw = 'yellow' and z.d < 0.3) or (k.zone = 'yellow' and raw = 'red' and z.d < 0.55) or (k.zone = 'yellow' and raw = 'green' and z.d > 0.2) or (k.zone = 'red' and raw = 'yellow' and z.d > 0.45) then k.zone else raw end from k join z on z.user_id = k.user_id and z.r = k.r + 1)
select user_id, count(*) as n, count(*) filter (zone = 'green') as green, count(*) filter (zone = 'yellow') as yellow, count(*) filter (zone = 'red') as red from k group by 1""")
def zone_hysteresis(t):
    """The zone after each event in order; a session's events are folded as one array of numbers."""
    n = F.floor("value").cast("int")
    d = F.when(F.col("event_type") == "error", 0.3 + (n % 5) / 10.0).otherwise((n % 7) / 10.0)
    listed = t("events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", d.alias("d")))).alias("l"))
    zero = F.struct(F.lit("green").alias("zone"), *(F.lit(0).cast("long").alias(c) for c in ("green", "yellow", "red")))

    def step(a, e):
        z = S.held_zone(a["zone"], e["d"])
        return F.struct(z.alias("zone"), *((a[c] + (z == c).cast("long")).alias(c) for c in ("green", "yellow", "red")))

    return listed.select("user_id", F.size("l").cast("long").alias("n"), F.aggregate("l", zero, step).alias("a")).select("user_id", "n", "a.green", "a.yellow", "a.red")


@query("""with f as (select user_id, count(*) filter (event_type = 'click') n, count(*) filter (event_type = 'error') s, count(*) filter (event_type = 'signup') c, count(*) filter (event_type = 'purchase') r from events group by 1),
g as (select user_id, floor((1 - (1 - 0.5 * least(1, s / greatest(n, 1)::double)) * (1 - 0.35 * least(1, c / greatest(n, 1)::double)) * (1 - 0.4 * least(1, r / greatest(n, 1)::double))) * 1000 + 0.5) / 1000 d from f) select user_id, d as drift, """ + ZONE + " as zone from g")
def drift_gauge(t):
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    edits = F.greatest(n("click"), F.lit(1))
    g = t("events").groupBy("user_id").agg(S.gauge(n("error") / edits, n("signup") / edits, n("purchase") / edits).alias("drift"))
    return g.withColumn("zone", S.zone(F.col("drift")))


@query("""with v as (select p_partkey, (p_size % 4) || '.' || (p_partkey % 7) || '.' || (p_size % 11) a, (p_size % 3 + 1) || '.' || (p_partkey % 5) || '.' || (p_partkey % 13) b, p_size * 2 s from part)
select p_partkey, a, b, list_transform(string_split(a, '.'), lambda x: x::int) > list_transform(string_split(b, '.'), lambda x: x::int) as newer, case when s >= 90 then 'A' when s >= 75 then 'B' when s >= 50 then 'C' when s >= 25 then 'D' else 'F' end as grade from v""")
def versions_and_grades(t):
    text = lambda *parts: F.concat_ws(".", *(p.cast("string") for p in parts))
    size, key = F.col("p_size"), F.col("p_partkey")
    v = t("part").select("p_partkey", text(size % 4, key % 7, size % 11).alias("a"), text(size % 3 + 1, key % 5, key % 13).alias("b"), (size * 2).alias("s"))
    parts = lambda c: [F.split(c, "[.]")[i].cast("int") for i in range(3)]
    newer = F.lit(False)
    for x, y in reversed(list(zip(parts("a"), parts("b"), strict=True))):
        newer = F.when(x != y, x > y).otherwise(newer)
    grade = F.when(F.col("s") >= 90, "A").when(F.col("s") >= 75, "B").when(F.col("s") >= 50, "C").when(F.col("s") >= 25, "D").otherwise("F")
    return v.select("p_partkey", "a", "b", newer.alias("newer"), grade.alias("grade"))


@query("""with r as (select l_orderkey run, l_suppkey % 10 task, l_linenumber % 2 arm, sum(l_quantity) * 3 + sum(l_extendedprice) * 0.001 cost, bool_or(l_returnflag = 'R') pass, bool_or(l_returnflag <> 'R') fail from lineitem group by 1, 2, 3),
a as (select task, avg(cost) filter (arm = 0) c0, avg(cost) filter (arm = 1) c1, stddev_samp(cost) filter (arm = 1) sd1, count(*) filter (pass and fail) flaky from r group by 1) select task, round(c1 - c0, 4) as delta, round(sd1, 4) as sd, flaky from a""")
def eval_delta(t):
    r = t("lineitem").groupBy(F.col("l_orderkey").alias("run"), (F.col("l_suppkey") % 10).alias("task"), (F.col("l_linenumber") % 2).alias("arm")).agg((F.sum("l_quantity") * 3 + F.sum("l_extendedprice") * 0.001).alias("cost"), F.bool_or(F.col("l_returnflag") == "R").alias("ok"), F.bool_or(F.col("l_returnflag") != "R").alias("bad"))
    arm = lambda k: F.when(F.col("arm") == k, F.col("cost"))
    return r.groupBy("task").agg(F.round(F.avg(arm(1)) - F.avg(arm(0)), 4).alias("delta"), F.round(F.stddev_samp(arm(1)), 4).alias("sd"), F.count_if(F.col("ok") & F.col("bad")).alias("flaky"))


@query("""with c as (select o_orderkey, o_custkey, o_orderdate, o_totalprice, sum(o_totalprice) over (partition by o_custkey order by o_orderdate desc, o_orderkey) run, max(o_orderdate) over () now from orders) select o_orderkey, o_custkey from c where run <= 500000 and o_orderdate >= now - interval 1500 day""")
def cache_prune(t):
    """Entries that stay: not past their age, and the newest of an owner up to a budget of bytes."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    orders = t("orders").withColumn("run", F.sum("o_totalprice").over(w))
    now = F.broadcast(orders.agg(F.max("o_orderdate").alias("now")))
    return orders.join(now).where((F.col("run") <= 500000) & (F.col("o_orderdate") >= F.expr("now - interval 1500 day"))).select("o_orderkey", "o_custkey")


@query("""with recursive e as (select user_id, event_id, octet_length(encode(props)) + 20 b, row_number() over (partition by user_id order by event_id) r from events),
k(user_id, event_id, r, batch, fill, rows_in) as (select user_id, event_id, r, 0, b, 1 from e where r = 1 union all select e.user_id, e.event_id, e.r, case when rows_in >= 9 or fill + b > 250 then batch + 1 else batch end, case when rows_in >= 9 or fill + b > 250 then b else fill + b end, case when rows_in >= 9 or fill + b > 250 then 1 else rows_in + 1 end from k join e on e.user_id = k.user_id and e.r = k.r + 1)
select user_id, batch, count(*) as n, min(event_id) as first_event from k group by 1, 2""")
def name_batches(t):
    """Greedy batches of an owner's entries, in order, by rows and bytes: a fold over sizes alone."""
    rows = t("events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", (F.octet_length("props") + 20).cast("long").alias("b")))).alias("l"))
    one = "struct<event_id:bigint,batch:int>"
    zero = F.struct(F.lit(0).alias("batch"), F.lit(0).cast("long").alias("fill"), F.lit(0).alias("n"), F.array().cast(f"array<{one}>").alias("out"))

    def step(a, e):
        new = (a["n"] > 0) & ((a["n"] >= 9) | (a["fill"] + e["b"] > 250))
        batch = a["batch"] + new.cast("int")
        return F.struct(batch.alias("batch"), F.when(new, e["b"]).otherwise(a["fill"] + e["b"]).alias("fill"), F.when(new, 1).otherwise(a["n"] + 1).alias("n"), F.concat(a["out"], F.array(F.struct(e["event_id"], batch.alias("batch")))).alias("out"))

    placed = rows.select("user_id", F.explode(F.aggregate("l", zero, step)["out"]).alias("e")).select("user_id", "e.*")
    return placed.groupBy("user_id", "batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("""select event_id, '"' || replace(props, '"', '""') || '"' as csv_field, substr(regexp_replace(trim(event_type || ' of ' || user_id || '   at   ' || ts::varchar), '\\s+', ' ', 'g'), 1, 20) as summary from events""")
def sink_fields(t):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    text = F.concat("event_type", F.lit(" of "), F.col("user_id").cast("string"), F.lit("   at   "), stamp)
    quoted = F.concat(F.lit('"'), F.replace(F.col("props"), F.lit('"'), F.lit('""')), F.lit('"'))
    return t("events").select("event_id", quoted.alias("csv_field"), F.substring(F.regexp_replace(F.trim(text), r"\s+", " "), 1, 20).alias("summary"))


@query("""with c as (select user_id, max(event_id) filter (event_type <> 'error') cut from events group by 1), e as (select events.*, row_number() over (partition by user_id, event_type order by event_id desc) r from events join c using (user_id) where event_id <= cut) select user_id, event_type, event_id, value from e where r = 1""")
def acknowledged_last(t):
    """The last value of each kind up to what its owner has committed."""
    ok = F.max(F.when(F.col("event_type") != "error", F.col("event_id")))
    cut = t("events").groupBy("user_id").agg(ok.alias("cut"))
    rows = t("events").join(cut, "user_id").where("event_id <= cut")
    return rows.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), "event_id").alias("b")).select("user_id", "event_type", "b.event_id", "b.value")


@query("""with s as (select user_id, count(*) filter (event_type = 'error') raised, count(*) filter (event_type = 'purchase') resolved, count(*) filter (event_type = 'click') edits from events group by 1), r as (select *, sum(edits) over (order by user_id) run from s)
select sum(raised)::bigint as raised, sum(resolved)::bigint as resolved, sum(least(raised, resolved))::bigint as closed, sum(greatest(raised - resolved, 0))::bigint as still_open, count(*) filter (run <= 100) as within_budget from r""")
def ledger_totals(t):
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    s = t("events").groupBy("user_id").agg(n("error").alias("raised"), n("purchase").alias("resolved"), n("click").alias("edits"))
    r = s.withColumn("run", F.sum("edits").over(Window.orderBy("user_id")))
    return r.agg(F.sum("raised").alias("raised"), F.sum("resolved").alias("resolved"), F.sum(F.least("raised", "resolved")).alias("closed"), F.sum(F.greatest(F.col("raised") - F.col("resolved"), F.lit(0))).alias("still_open"), F.count_if(F.col("run") <= 100).alias("within_budget"))


@query(code_queries._vote_sql(code_queries.ASYNC) + " and dir = 'src/m3'")
def dominant_pattern_of_directory(t):
    """Point query: the vote of one directory; the filter reaches the scan."""
    lines = standin.lines(t).where("dir = 'src/m3'")
    return code_queries._vote(C.async_style(lines, code_queries.KEYS))


DRIFT = code_queries.ASYNC + """, d as (select dir, style p, count(*) c, min(file_id) f from styles group by 1, 2), v as (select *, row_number() over (partition by dir order by c desc, f) r from d)
select s.file_id, s.style, v.p as dominant, s.style = v.p as fits from styles s join v on v.dir = s.dir and r = 1"""


@query(DRIFT)
def file_drift_checks(t):
    """The point query over all files at once: whether each fits its directory's convention."""
    styles = C.async_style(standin.lines(t), code_queries.KEYS)
    votes = code_queries._vote(styles).select("dir", "dominant")
    return styles.join(votes, "dir").select("file_id", "style", "dominant", (F.col("style") == F.col("dominant")).alias("fits"))


@query(f"""with {standin.FILES}, {standin.FINDINGS}, g as (select path, count(*) n, max(line) last_line from findings where severity = 'error' group by 1) select f.path, coalesce(n, 0) as n, last_line from files f left join g using (path)""")
def files_left_join_findings(t):
    g = standin.findings(t).where("severity = 'error'").groupBy("path").agg(F.count("*").alias("n"), F.max("line").alias("last_line"))
    return code_queries._files(t).select("path").join(g, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n"), "last_line")


@query(f"""with {standin.FILES}, {standin.FINDINGS} select language, count(*) as files, sum(line_count)::bigint as lines from (select *, {code_queries.EXT} as language from files) f where exists (select 1 from findings g where g.path = f.path and severity = 'error' and confidence > 0.6) group by 1""")
def changed_files_stats(t):
    """Files that a change touches (a semi join), and the statistics computed again."""
    changed = standin.findings(t).where("severity = 'error' and confidence > 0.6").select("path")
    files = code_queries._files(t).join(changed, "path", "left_semi")
    return files.groupBy(C.language(F.col("path")).alias("language")).agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"))


@query(f"""with {standin.LINES}, i as (select distinct path, unnest(regexp_extract_all(text, '{code_queries.NAMED}', 1)) name from lines) select name, count(*) as files from i group by 1 having count(*) >= 2""")
def reimplementation_candidates(t):
    return C.identifiers(standin.lines(t), ["path"]).select("path", "name").distinct().groupBy("name").agg(F.count("*").alias("files")).where("files >= 2")


LIKELY = [("raw_sql", "db[.]query", 0.8), ("orm", "prisma[.]", 0.85), ("repository", "[Rr]epository", 0.75)]


@query(f"""with {standin.FILES}, p as (select file_id, {", ".join(f"len(regexp_extract_all(content, '{p}')) * {w} {n}" for n, p, w in LIKELY)} from files), s as (select *, raw_sql + orm + repository total from p)
select file_id, round(raw_sql / total, 2)::double as raw_sql, round(orm / total, 2)::double as orm, round(repository / total, 2)::double as repository, case greatest(raw_sql, orm, repository) when raw_sql then 'raw_sql' when orm then 'orm' else 'repository' end as dominant from s where total > 0""")
def pattern_posterior(t):
    counts = [(F.regexp_count("content", F.lit(p)) * w).alias(n) for n, p, w in LIKELY]
    names = [n for n, _, _ in LIKELY]
    s = code_queries._files(t).select("file_id", *counts).withColumn("total", sum(F.col(n) for n in names[1:]) + F.col(names[0])).where("total > 0")
    top = F.greatest(*names)
    return s.select("file_id", *(F.round(F.col(n) / F.col("total"), 2).alias(n) for n in names), F.when(F.col("raw_sql") == top, "raw_sql").when(F.col("orm") == top, "orm").otherwise("repository").alias("dominant"))


HINTS = [("src/m1", "async_await"), ("src/m2", "then_chains"), ("src/m5", "ASYNC_AWAIT")]


@query(code_queries.ASYNC + ", h as (select * from (values " + ", ".join(f"('{d}', '{p}')" for d, p in HINTS) + """) v(dir, hint)), d as (select dir, style p, count(*) c, min(file_id) f from styles group by 1, 2), v as (select *, row_number() over (partition by dir order by c desc, f) r from d)
select h.dir, hint, v.p as dominant, lower(hint) <> lower(v.p) as diverges from h left join v on v.dir = h.dir and r = 1""")
def intent_divergence(t):
    styles = C.async_style(standin.lines(t), code_queries.KEYS)
    votes = code_queries._vote(styles).select("dir", "dominant")
    hints = F.broadcast(styles.sparkSession.createDataFrame(HINTS, "dir string, hint string"))
    return votes.join(hints, "dir", "right").select("dir", "hint", "dominant", (F.lower("hint") != F.lower("dominant")).alias("diverges"))


@query(f"""{DAMAGE}, per as (select f.id, f.category, f.analyzer from findings f where f.severity = 'error' and f.confidence > 0.85), h as (select category, product(1 - damage) health from m group by 1)
select p.id, p.category, p.analyzer, round(h.health / (1 - m.damage) - h.health, 6) as gain from per p join h using (category) join m on m.category = p.category and m.analyzer = p.analyzer""")
def finding_gain(t):
    """What the category would gain without the finding's analyzer: the survival divided by its own factor."""
    f = _findings(t)
    damages = S.detector_damage(f, FUNCTIONS, LINES_TOTAL / 1000).select("category", "analyzer", "damage")
    gains = S.leave_one_out(damages).select("category", "analyzer", F.round("impact", 6).alias("gain"))
    return f.where("severity = 'error' and confidence > 0.85").select("id", "category", "analyzer").join(F.broadcast(gains), ["category", "analyzer"])


@query(f"{FOUND} select category, message, min(consistency) as consistency, count(*) as n from findings where total_relevant >= 5 group by 1, 2 order by consistency, category, message limit 10")
def pattern_consensus(t):
    g = standin.findings(t).where("total_relevant >= 5").groupBy("category", "message").agg(F.min("consistency").alias("consistency"), F.count("*").alias("n"))
    return g.orderBy("consistency", "category", "message").limit(10)
