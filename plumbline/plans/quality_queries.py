"""Scores, joins, diffs and retention."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators import scoring as S
from plumbline.plans.registry import query

FINDINGS = """with f as (select l_returnflag category, l_linestatus || '-' || (l_linenumber % 3) analyzer, case when l_quantity > 45 then 'error' when l_quantity > 25 then 'warning' else 'info' end severity, l_discount * 5 + 0.3 confidence, case when l_tax > 0.07 then 1.0 else 0.35 end importance, l_tax * 4 deviation from lineitem),
g as (select category, analyzer, max(case severity when 'error' then 0.7 when 'warning' then 0.4 else 0.12 end) s, avg(confidence) c, max(importance) i, avg(deviation) d, count(*) n from f group by 1, 2),
dm as (select category, analyzer, n, least(0.85, s * c * i * d * least(1.0, n / 8.0))::double damage from g)"""
HEALTH = FINDINGS + ", hl as (select category, product(1 - damage) health, count(*) analyzers from dm group by 1)"


def _findings(t):
    """Findings with stand-in fields from lineitem."""
    sev = F.when(F.col("l_quantity") > 45, "error").when(F.col("l_quantity") > 25, "warning").otherwise("info")
    return t("lineitem").select(F.col("l_returnflag").alias("category"), F.concat("l_linestatus", F.lit("-"), (F.col("l_linenumber") % 3).cast("string")).alias("analyzer"), sev.alias("severity"), (F.col("l_discount") * 5 + 0.3).alias("confidence"), F.when(F.col("l_tax") > 0.07, 1.0).otherwise(0.35).alias("importance"), (F.col("l_tax") * 4).alias("deviation"))


@query(FINDINGS + " select category, analyzer, n, round(damage, 6) as damage from dm")
def detector_damage(t):
    return S.damage(_findings(t)).withColumn("damage", F.round("damage", 6))


@query(HEALTH + " select category, analyzers, round(health, 6) as health from hl")
def category_health(t):
    return S.health(S.damage(_findings(t))).withColumn("health", F.round("health", 6))


@query(HEALTH + " select count(*) as categories, floor(100 * exp(avg(ln(greatest(0.02, health)))) * 10 + 0.5) / 10 as composite from hl")
def composite_score(t):
    return S.composite(S.health(S.damage(_findings(t))))


@query(FINDINGS + ", h as (select category, product(1 - damage) h from dm group by 1) select category, analyzer, round(h, 6) as health, round(h / (1 - damage), 6) as health_without, round(h / (1 - damage) - h, 6) as impact from dm join h using (category)")
def leave_one_out_impact(t):
    return S.leave_one_out(S.damage(_findings(t))).select("category", "analyzer", *(F.round(c, 6).alias(c) for c in ("health", "health_without", "impact")))


@query(FINDINGS + ", r as (select * from dm where analyzer not like 'F-%'), hl as (select category, product(1 - damage) health from r group by 1) select count(*) as categories, floor(100 * exp(avg(ln(greatest(0.02, health)))) * 10 + 0.5) / 10 as composite from hl")
def what_if(t):
    """The composite if all findings of some analyzers were fixed."""
    return S.composite(S.health(S.damage(_findings(t).where(~F.col("analyzer").startswith("F-")))))


@query("select o_orderpriority, count(*) as n, round(100.0 * count(*) filter (o_totalprice <= 150000) / count(*), 1) as percentile from orders group by 1")
def ecdf_percentile(t):
    return S.ecdf(t("orders"), "o_orderpriority", "o_totalprice", F.lit(150000.0))


@query("""with e as (select user_id, ts::date as day, least(0.99, greatest(0.01, value / 100)) c from events)
select user_id, day, count(*) as n, round(least(0.999, 1 / (1 + exp(-sum(ln(c / (1 - c)))))), 5) as stacked from e group by 1, 2""")
def evidence_stacking(t):
    rows = t("events").select("user_id", F.col("ts").cast("date").alias("day"), (F.col("value") / 100).alias("c"))
    return S.stack_evidence(rows, ["user_id", "day"], "c").withColumn("stacked", F.round("stacked", 5))


@query("""with u as (select user_id, count(*) filter (event_type = 'error') k from events group by 1), m as (select avg(k) r from u)
select user_id, k, round(case when k = 0 then 1 else greatest(0, 1 - list_sum(list_transform(range(0, k), lambda i: exp(-r + i * ln(r) - lgamma(i + 1))))) end, 5) as tail from u, m""")
def poisson_outliers(t):
    u = t("events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("k"))
    rate = u.agg(F.avg("k")).first()[0] or 0.0
    return u.select("user_id", "k", F.round(S.poisson_tail(F.col("k"), F.lit(float(rate))), 5).alias("tail"))


@query("""with w as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) term from documents), n as (select count(*) n from documents)
select term, count(*) as df from w, n where length(term) <= 8 group by term having count(*) >= greatest(floor(0.3 * max(n)), 3)""")
def generic_terms_df(t):
    docs = t("documents")
    least = max(int(0.3 * docs.count()), 3)
    terms = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))).alias("term"))
    return terms.where(F.length("term") <= 8).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least)


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from documents),
w as (select *, max((line like '%the %')::int) over (partition by doc_id order by i rows between 5 preceding and 5 following) near from l)
select doc_id, i::bigint as line_no from w where contains(lower(line), 'licensed') and near = 1""")
def line_proximity(t):
    """Lines that mention a license within five lines of a common word."""
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    near = F.max(F.col("line").contains("the ").cast("int")).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(-5, 5))
    return lines.withColumn("near", near).where(F.lower("line").contains("licensed") & (F.col("near") == 1)).select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"))


@query("select c_custkey, c_name from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey)")
def anti_missing(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""with a as (select distinct l_partkey k from lineitem where l_shipdate < '1995-01-01'), b as (select distinct l_partkey k from lineitem where l_shipdate >= '1997-01-01')
select coalesce(a.k, b.k) as k, case when b.k is null then 'resolved' when a.k is null then 'new' else 'persistent' end as state from a full join b on a.k = b.k""")
def full_outer_diff(t):
    old = t("lineitem").where("l_shipdate < timestamp_ntz '1995-01-01'").select(F.col("l_partkey").alias("k"), F.lit(True).alias("o")).distinct()
    new = t("lineitem").where("l_shipdate >= timestamp_ntz '1997-01-01'").select(F.col("l_partkey").alias("k"), F.lit(True).alias("n")).distinct()
    return old.join(new, "k", "full_outer").select("k", F.when(F.col("n").isNull(), "resolved").when(F.col("o").isNull(), "new").otherwise("persistent").alias("state"))


@query("""with d as (select l_orderkey, l_linenumber, substr(sha256(concat_ws('|', l_returnflag, l_orderkey::varchar, (l_linenumber // 3)::varchar)), 1, 16) digest from lineitem)
select digest, count(*) as n, min(l_orderkey) as first_order from d group by 1""")
def finding_digest(t):
    digest = F.substring(F.sha2(F.concat_ws("|", "l_returnflag", F.col("l_orderkey").cast("string"), F.floor(F.col("l_linenumber") / 3).cast("string")), 256), 1, 16)
    return t("lineitem").groupBy(digest.alias("digest")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"))


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) r from orders) where r <= 10")
def retention_topk(t):
    """The ten latest snapshots of each owner are kept."""
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return t("orders").withColumn("r", r).where("r <= 10").select("o_custkey", "o_orderkey")


@query("""with x as (select o_orderstatus, o_orderkey, row_number() over (partition by o_orderstatus order by o_totalprice desc, o_orderkey) r from orders)
select o_orderstatus, case when r <= 20 then o_orderkey end as item, count(*) as n from x group by o_orderstatus, case when r <= 20 then o_orderkey end""")
def tier_rollup(t):
    """The top 20 of each tier, and one row for the rest."""
    r = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    orders = t("orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    top = orders.withColumn("r", r).where("r <= 20").select("o_orderstatus", F.col("o_orderkey").alias("item"), F.lit(1).cast("long").alias("n"))
    rest = orders.groupBy("o_orderstatus").agg((F.count("*") - 20).alias("n")).where("n > 0").select("o_orderstatus", F.lit(None).cast("long").alias("item"), "n")
    return top.unionByName(rest)


@query("""with x as (select l_orderkey k, l_shipdate, l_returnflag src, l_linenumber ln, case l_returnflag when 'R' then 1 when 'A' then 2 else 3 end p from lineitem)
select k, arg_min(src, (p, ln)) as kept, count(*) as merged, array_to_string(list_sort(list(distinct src)), ',') as sources from x group by 1""")
def dedup_priority(t):
    """One finding of each key, from the layer of highest priority, with all sources."""
    p = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3)
    return t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min_by("l_returnflag", F.struct(p, "l_linenumber")).alias("kept"), F.count("*").alias("merged"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("sources"))


@query("""with h as (select source, doc_id, sha256(doc_id::varchar || ':' || sha256(text)) h from documents), g as (select source, doc_id // 256 b, sha256(string_agg(h, chr(10) order by doc_id, h)) h from h group by 1, 2),
"""
    + ", ".join(f"g{k} as (select source, b // 256 b, sha256(string_agg(h, chr(10) order by b)) h from g{k - 1 or ''} group by 1, 2)" for k in range(1, 7))
    + " select source, h as key from g6")
def merkle_key(t):
    """A content key of each source: leaves, then seven levels of nodes of 256, which hold 2 to the power of 56 ids."""
    ordered = lambda o: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(o, "h"))), lambda x: x["h"]), "\n")
    leaf = t("documents").select("source", "doc_id", F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.sha2("text", 256)), 256).alias("h"))
    node = leaf.groupBy("source", F.floor(F.col("doc_id") / 256).alias("b")).agg(F.sha2(ordered("doc_id"), 256).alias("h"))
    for _ in range(6):
        node = node.groupBy("source", F.floor(F.col("b") / 256).alias("b")).agg(F.sha2(ordered("b"), 256).alias("h"))
    return node.select("source", F.col("h").alias("key"))


@query("""with p as (select doc_id, (regexp_matches(text, '(idiot|scum|moron|stupid|clown|loser)'))::int pred from documents), j as (select pred, toxic from p join labels using (doc_id)),
c as (select count(*) filter (pred = 1 and toxic = 1) tp, count(*) filter (pred = 1 and toxic = 0) fp, count(*) filter (pred = 0 and toxic = 1) fn from j)
select tp, fp, fn, round(tp::double / nullif(tp + fp, 0), 6) as precision, round(tp::double / nullif(tp + fn, 0), 6) as recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1 from c""")
def precision_recall(t):
    pred = t("documents").select("doc_id", F.col("text").rlike("(idiot|scum|moron|stupid|clown|loser)").alias("pred"))
    c = pred.join(t("labels"), "doc_id").agg(F.count_if(F.col("pred") & (F.col("toxic") == 1)).alias("tp"), F.count_if(F.col("pred") & (F.col("toxic") == 0)).alias("fp"), F.count_if(~F.col("pred") & (F.col("toxic") == 1)).alias("fn"))
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    return c.select("tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


@query("select event_type, count(*) as n, round(avg(value), 5) as mean, round(1.96 * stddev_samp(value) / sqrt(count(*)), 5) as half_width from events group by 1")
def t_interval(t):
    """Mean and 95 % half width; cohorts are large, so t is 1.96."""
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 5).alias("mean"), F.round(1.96 * F.stddev_samp("value") / F.sqrt(F.count("*")), 5).alias("half_width"))


@query("select user_id % 3 as arm, round(sum(value), 4) as cost, count(*) filter (event_type = 'purchase') as passed, round(sum(value) / nullif(count(*) filter (event_type = 'purchase'), 0), 4) as cost_per_pass from events group by 1")
def cost_per_pass(t):
    g = t("events").groupBy((F.col("user_id") % 3).alias("arm")).agg(F.sum("value").alias("c"), F.count_if(F.col("event_type") == "purchase").alias("passed"))
    return g.select("arm", F.round("c", 4).alias("cost"), "passed", F.round(F.try_divide("c", "passed"), 4).alias("cost_per_pass"))
