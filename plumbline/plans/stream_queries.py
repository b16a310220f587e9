"""Session-event queries; the streaming forms are in ``plumbline.streaming``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.plans.registry import query
from plumbline.streaming.sessions import cooldown


def _session():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("""select user_id, count(*) as events, count(*) filter (event_type = 'error') as flags, count(*) filter (event_type = 'purchase') as resolved, arg_max(event_type, (ts, event_id)) as last_state, round(count(*) filter (event_type in ('click', 'view')) * 100.0 / count(*), 1) as coverage from events group by 1""")
def session_summary(t):
    kind = lambda *k: F.count_if(F.col("event_type").isin(*k))
    return t("events").groupBy("user_id").agg(F.count("*").alias("events"), kind("error").alias("flags"), kind("purchase").alias("resolved"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_state"), F.round(kind("click", "view") * 100.0 / F.count("*"), 1).alias("coverage"))


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) r from events) where r = 1")
def decisions_last(t):
    r = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    return t("events").withColumn("r", r).where("r = 1").select("user_id", "event_type", "event_id", "value")


@query("""with e as (select *, sum((event_type = 'click')::int) over (partition by user_id order by ts, event_id) o, sum((event_type = 'click')::int) over (partition by user_id) m from events)
select user_id, count(*) filter (event_type = 'click') as edits, count(*) filter (event_type = 'error') as flags, round(1 - power(0.65, count(*) filter (event_type = 'error')), 6) as drift from e where o > m - 5 group by 1""")
def gauge_last5(t):
    """Edits and flags since the fifth last edit, as a noisy-OR gauge."""
    edit = (F.col("event_type") == "click").cast("int")
    rows = t("events").withColumn("o", F.sum(edit).over(_session())).withColumn("m", F.sum(edit).over(Window.partitionBy("user_id")))
    flags = F.count_if(F.col("event_type") == "error")
    return rows.where("o > m - 5").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("edits"), flags.alias("flags"), F.round(1 - F.pow(F.lit(0.65), flags), 6).alias("drift"))


@query("""with recursive e as (select user_id, event_type, event_id, epoch_us(ts) t, row_number() over (partition by user_id, event_type order by ts, event_id) r from events),
k(user_id, event_type, event_id, t, r, last, kept) as (select user_id, event_type, event_id, t, r, t, true from e where r = 1
 union all select e.user_id, e.event_type, e.event_id, e.t, e.r, case when e.t - k.last >= 43200000000 then e.t else k.last end, e.t - k.last >= 43200000000 from k join e on e.user_id = k.user_id and e.event_type = k.event_type and e.r = k.r + 1)
select user_id, event_type, event_id from k where kept""")
def cooldown_throttle(t):
    """Events at least twelve hours after the last kept one of their key."""
    return cooldown(t("events"), ["user_id", "event_type"], "ts", "event_id", 12 * 3600)


@query("""with e as (select user_id, event_id, ts, floor(value)::bigint % 50 h from events), w as (select *, list(h) over (partition by user_id order by ts, event_id rows between 20 preceding and 1 preceding) prev from e)
select user_id, count(*) filter (list_contains(prev, h)) as reverts from w group by 1""")
def revert_detect(t):
    """Contents seen among the previous twenty of their owner."""
    rows = t("events").withColumn("h", F.floor("value").cast("long") % 50)
    prev = F.collect_list("h").over(_session().rowsBetween(-20, -1))
    return rows.withColumn("prev", prev).groupBy("user_id").agg(F.count_if(F.array_contains("prev", F.col("h"))).alias("reverts"))


@query("""with g as (select user_id, ts, case when epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts)) <= 21600 then 0 else 1 end n from events), s as (select *, sum(n) over (partition by user_id order by ts rows unbounded preceding) sid from g)
select user_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as n from s group by user_id, sid""")
def session_windows(t):
    """Sessions that end after six hours without an event."""
    sec = F.col("ts").cast("timestamp").cast("double")
    w = Window.partitionBy("user_id").orderBy("ts")
    new = F.when(sec - F.lag(sec).over(w) <= 21600, 0).otherwise(1)
    rows = t("events").withColumn("new", new).withColumn("sid", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "sid").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")).drop("sid")


@query("select event_id, substr(sha256('salt' || '/' || user_id::varchar), 1, 16) as path_hash, event_type as label, length(props)::bigint as detail_chars from events")
def upload_projection(t):
    return t("events").select("event_id", F.substring(F.sha2(F.concat_ws("/", F.lit("salt"), F.col("user_id").cast("string")), 256), 1, 16).alias("path_hash"), F.col("event_type").alias("label"), F.length("props").cast("long").alias("detail_chars"))


@query("""with e as (select *, row_number() over (partition by user_id order by event_id) p from events), f as (select *, min(case when value > 200 or event_type = 'error' then p end) over (partition by user_id) bad from e)
select user_id, count(*) filter (bad is null or p < bad) as committed, count(*) filter (p >= bad) as held from f group by 1""")
def prefix_commit(t):
    """Rows before the first failed one of each file are committed, the rest held."""
    rows = t("events").withColumn("p", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    bad = F.min(F.when((F.col("value") > 200) | (F.col("event_type") == "error"), F.col("p"))).over(Window.partitionBy("user_id"))
    return rows.withColumn("bad", bad).groupBy("user_id").agg(F.count_if(F.col("bad").isNull() | (F.col("p") < F.col("bad"))).alias("committed"), F.count_if(F.col("p") >= F.col("bad")).alias("held"))
