"""Token usage of agent runs from their streams of records, some of which are totals and some are parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_USAGE = "struct<input_tokens:long,output_tokens:long,cache_creation_input_tokens:long,cache_read_input_tokens:long>"
_EVENT = f"type:string,subtype:string,model:string,usage:{_USAGE},total_cost_usd:double,num_turns:long,message:struct<model:string,usage:{_USAGE}>"
SCHEMA = f"struct<{_EVENT},event:struct<{_EVENT}>>"
PARTS = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast("long"))


def totals(lines: DataFrame) -> DataFrame:
    """run, the four token sums, cost, turns, model, compactions, basis of ``lines`` (run, seq, text: one JSON record each).

    A record may stand inside another as its event. The last result with a usage is the run's total (basis "result"). Without one the
    messages are added up (basis "messages"): input and cache of a message from its start, output from its last delta that tells it, as deltas count up.
    Deltas before any message, broken lines and null lines count for nothing. A run without usage has zeros.
    """
    rows = lines.select("run", "seq", F.from_json("text", SCHEMA).alias("o"))
    both = rows.select("run", "seq", F.explode(F.array_compact(F.array(F.struct(F.lit(0).alias("inner"), *(F.col(f"o.{c}").alias(c) for c in ("type", "subtype", "model", "usage", "total_cost_usd", "num_turns", "message"))), F.when(F.col("o.event").isNotNull(), F.struct(F.lit(1).alias("inner"), *(F.col(f"o.event.{c}").alias(c) for c in ("type", "subtype", "model", "usage", "total_cost_usd", "num_turns", "message"))))))).alias("e")).select("run", "seq", "e.*")
    order = F.struct("seq", "inner")
    start = F.col("type") == "message_start"
    result = (F.col("type") == "result") & F.col("usage").isNotNull()
    whole = both.groupBy("run").agg(
        F.max_by(F.when(result, F.struct("usage", "total_cost_usd", "num_turns")), F.when(result, order)).alias("result"),
        F.min_by(F.when(start, F.col("message.model")), F.when(start & F.col("message.model").isNotNull(), order)).alias("said"),
        F.min_by(F.col("model"), F.when((F.col("type") == "system") & (F.col("subtype") == "init") & F.col("model").isNotNull(), order)).alias("begun"),
        F.count_if((F.col("type") == "system") & (F.col("subtype") == "compact_boundary")).alias("compactions"), F.count_if(start).alias("starts"),
    )
    # one event a line: the inner one where there is one
    event = both.withColumn("n", F.row_number().over(Window.partitionBy("run", "seq").orderBy(F.desc("inner")))).where("n = 1 and type in ('message_start', 'message_delta')")
    number = F.count_if(start).over(Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    delta = (F.col("type") == "message_delta") & F.col("usage.output_tokens").isNotNull()
    message = event.withColumn("message_no", number).where("message_no > 0").groupBy("run", "message_no").agg(
        *(F.max(F.when(start, F.col(f"message.usage.{p}"))).alias(p) for p in PARTS if p != "output_tokens"), F.max_by(F.col("usage.output_tokens"), F.when(delta, F.col("seq"))).alias("output_tokens"))
    added = message.groupBy("run").agg(*(F.sum(_zero(F.col(p))).alias(f"sum_{p}") for p in PARTS), F.count("*").alias("messages"))
    out = whole.join(added, "run", "left")
    told = F.col("result").isNotNull()
    tokens = [F.when(told, _zero(F.col(f"result.usage.{p}"))).otherwise(_zero(F.col(f"sum_{p}"))).alias(p) for p in PARTS]
    turns = F.when(told, F.coalesce("result.num_turns", "starts")).otherwise(_zero(F.col("messages")))
    return out.select("run", *tokens, F.col("result.total_cost_usd").alias("cost"), turns.alias("turns"), F.coalesce("said", "begun").alias("model"), "compactions", F.when(told, "result").otherwise("messages").alias("basis"))
