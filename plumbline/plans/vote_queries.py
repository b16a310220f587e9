"""Votes and per-entity aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators import vote as V
from plumbline.plans.registry import query

VOTE = """with d as (select source, lang p, count(*) c, min(doc_id) f from documents group by 1, 2),
v as (select *, row_number() over (partition by source order by c desc, f) r, sum(c) over (partition by source) t from d),
w as (select source, p as dominant, c as dominant_count, t::bigint as total, floor(100.0 * c / t + 0.5)::bigint as consistency, (t >= 3 and c::double / t >= 0.7 and c < t) as flagged from v where r = 1)"""


@query(VOTE + " select * from w")
def directory_vote(t):
    return V.vote(t("documents"), "source", "lang", "doc_id")


@query(VOTE + " select d.doc_id, d.source, d.lang, w.dominant from documents d join w using (source) where flagged and lang <> dominant")
def directory_vote_deviators(t):
    docs = t("documents").select("doc_id", "source", "lang")
    return V.deviators(docs, V.vote(docs, "source", "lang", "doc_id"), "source", "lang").select("doc_id", "source", "lang", "dominant")


@query("select o_orderpriority, o_orderstatus as pattern, count(*) as cnt, count(*)::double as weight, min(o_orderkey) as first_entity from orders group by 1, 2")
def pattern_distribution(t):
    return V.distribution(t("orders"), "o_orderpriority", "o_orderstatus", "o_orderkey")


@query("""with e as (select user_id, event_type, event_id, 2 * exp(-ln(2.0) * (epoch(m.mx) - epoch(ts)) / 86400 / 90) w from events, (select max(ts) mx from events) m),
d as (select user_id, event_type p, count(*) c, sum(w) w, min(event_id) f from e group by 1, 2),
v as (select *, row_number() over (partition by user_id order by w desc, f) r, sum(c) over (partition by user_id) t, sum(w) over (partition by user_id) tw from d)
select user_id, p as dominant, c as dominant_count, t::bigint as total, floor(100 * w / tw + 0.5)::bigint as consistency, (t >= 3 and w / tw >= 0.7 and c < t) as flagged from v where r = 1""")
def weighted_vote_temporal(t):
    events = t("events")
    latest = events.agg(F.max("ts")).first()[0]
    age = (F.lit(latest).cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")) / 86400
    return V.vote(events, "user_id", "event_type", "event_id", V.temporal_weight(age))


@query("""with d as (select user_id, event_type p, count(*) c, min(event_id) f from events group by 1, 2),
x as (select user_id, p, c, f, case when p = 'refund' then c * 1.5 else c end b from d
 union all select user_id, 'refund', 0, 4611686018427387904, 1.9 from d group by user_id having max((p = 'refund')::int) = 0),
v as (select *, row_number() over (partition by user_id order by b desc, f) rb, row_number() over (partition by user_id order by c desc, f) rc from x)
select user_id, max(case when rb = 1 then p end) as dominant, max(case when rc = 1 then p end) as raw_dominant, sum(c)::bigint as total, max(case when rc = 1 then p end) = 'refund' as matches_hint from v group by 1""")
def seeded_vote(t):
    return V.seeded_vote(t("events"), "user_id", "event_type", "event_id", "refund", 0.9)


@query("""with d as (select user_id, event_type, count(*) c from events group by 1, 2), p as (select *, c::double / sum(c) over (partition by user_id) p from d),
a as (select user_id, sum(c)::bigint total, count(*) k, sum(-p * log2(p)) entropy, max(p) top from p group by 1),
r as (select *, case when k < 2 then 0 else entropy / log2(k) end ratio from a)
select user_id, total, k, round(entropy, 6) as entropy, (k >= 2 and ratio > 0.8) as no_convention, round(case when k < 2 then 0.9 when ratio > 0.8 then 0.75 else least(0.9, greatest(0.3, 1 - ratio)) end, 6) as confidence, floor(top * 100 + 0.5)::bigint as score from r""")
def entropy_gate(t):
    return V.entropy_gate(t("events"), "user_id", "event_type")


@query("""with e as (select user_id, event_type p, date_diff('day', ts::date, (select max(ts) from events)::date) a from events),
d as (select user_id, p, count(*) filter (a <= 15) r, count(*) filter (a > 15) l from e group by 1, 2),
v as (select *, row_number() over (partition by user_id order by r desc, p desc) rr, row_number() over (partition by user_id order by l desc, p desc) rl, sum(r) over (partition by user_id) nr, sum(l) over (partition by user_id) nl from d),
a as (select user_id, max(case when rr = 1 then p end) rp, max(case when rl = 1 then p end) lp, max(r) r, max(l) l, max(nr)::bigint nr, max(nl)::bigint nl from v group by 1)
select user_id, rp as recent_dominant, lp as legacy_dominant, nr as n_recent, nl as n_legacy, (nr >= 3 and nl >= 3 and r >= 0.3 * nr and l >= 0.3 * nl and rp <> lp) as pivoted from a""")
def pivot_detection(t):
    events = t("events")
    latest = events.agg(F.max("ts")).first()[0]
    return V.pivot(events, "user_id", "event_type", F.datediff(F.lit(latest).cast("date"), F.col("ts").cast("date")), days=15, recent_share=0.3, legacy_share=0.3)


@query("""with m as (select max(ts) mx from events),
g as (select user_id, ts, event_type, event_id, epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts, event_id)) gap from events),
n as (select user_id, event_type, count(*) c from events group by 1, 2), p as (select user_id, sum(-(c::double / t) * log2(c::double / t)) h from (select *, sum(c) over (partition by user_id) t from n) group by 1)
select g.user_id, date_diff('day', max(ts)::date, (select mx from m)::date)::bigint as days_since, count(distinct event_type) as authors, count(*) filter (date_diff('day', ts::date, (select mx from m)::date) <= 14) as recent, count(*) as touches, (epoch(max(ts)) - epoch(min(ts)) <= 21600) as single_session, arg_min(event_type, (ts, event_id)) as first_author, round(max(h), 6) as author_entropy, round(median(gap) / 3600, 6) as median_gap_hours from g join p using (user_id) group by 1""")
def touch_metadata(t):
    events = t("events")
    latest = events.agg(F.max("ts")).first()[0]
    sec = F.col("ts").cast("timestamp").cast("double")
    rows = events.withColumn("gap", sec - F.lag(sec).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).withColumn("age", F.datediff(F.lit(latest).cast("date"), F.col("ts").cast("date")))
    share = F.col("c") / F.sum("c").over(Window.partitionBy("user_id"))
    mix = events.groupBy("user_id", "event_type").agg(F.count("*").alias("c")).withColumn("p", share).groupBy("user_id").agg(F.round(F.sum(-F.col("p") * F.log2("p")), 6).alias("author_entropy"))
    out = rows.groupBy("user_id").agg(F.min("age").cast("long").alias("days_since"), F.countDistinct("event_type").alias("authors"), F.count_if(F.col("age") <= 14).alias("recent"), F.count("*").alias("touches"), (F.max(sec) - F.min(sec) <= 21600).alias("single_session"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_author"), F.round(F.percentile("gap", 0.5) / 3600, 6).alias("median_gap_hours"))
    return out.join(mix, "user_id")


@query("""with g as (select user_id, count(*) n, count(distinct ts::date) d, count(distinct event_type) a from events group by 1)
select user_id, n, d as days, ((n::double / d > 2)::int + (d <= 20)::int + (a <= 4)::int)::int as signals, ((n::double / d > 2)::int + (d <= 20)::int + (a <= 4)::int) >= 2 as bursty from g""")
def burst_profile(t):
    g = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct(F.col("ts").cast("date")).alias("days"), F.countDistinct("event_type").alias("a"))
    signals = (F.col("n") / F.col("days") > 2).cast("int") + (F.col("days") <= 20).cast("int") + (F.col("a") <= 4).cast("int")
    return g.select("user_id", "n", "days", signals.alias("signals"), (signals >= 2).alias("bursty"))


@query("select lang, count(*) as files, sum(len(string_split(text, chr(10))))::bigint as lines from documents group by 1")
def document_languages(t):
    return t("documents").groupBy("lang").agg(F.count("*").alias("files"), F.sum(F.size(F.split("text", "\n", -1))).alias("lines"))


@query("""with h as (select source, lang, doc_id, 0.5 + (doc_id % 5) / 10.0 conf, case when lang = 'en' then 1 else 2 end prio from documents), r as (select *, row_number() over (partition by source, lang order by conf desc, prio, doc_id) rn from h)
select source, lang, doc_id, round(conf, 2)::double as confidence from r where rn = 1""")
def hint_dedupe(t):
    """The declared hint of largest confidence for each (scope, pattern)."""
    h = t("documents").select("source", "lang", "doc_id", (F.lit(0.5) + F.col("doc_id") % 5 / 10).alias("conf"))
    best = F.row_number().over(Window.partitionBy("source", "lang").orderBy(F.desc("conf"), "doc_id"))
    return h.withColumn("rn", best).where("rn = 1").select("source", "lang", "doc_id", F.round("conf", 2).alias("confidence"))
