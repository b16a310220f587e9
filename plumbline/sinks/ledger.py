"""Ledgers and uploads of session events."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.code import mask_secrets

# Bytes of a ledger line, rows of an upload.
LINE_BYTES, BATCH = 32 * 1024, 50


def capped(events: DataFrame, fields: list[str], most: int = LINE_BYTES) -> DataFrame:
    """Events with secrets masked in ``fields`` and then the longest field cut until the JSON line fits ``most`` bytes.

    Masking goes first, so that no cut leaves half a secret. A round cuts from the longest field one character for each byte
    that the line is too long; a field that shrinks to nothing leaves the rest to the next one. ``truncated`` says whether
    anything was cut.
    """
    out = events.select(*(mask_secrets(F.col(c)).alias(c) if c in fields else F.col(c) for c in events.columns), F.lit(False).alias("truncated"))
    names = [c for c in out.columns]
    for _ in range(2 * len(fields)):
        over = F.octet_length(F.to_json(F.struct(*names))) - most
        longest = F.greatest(*(F.coalesce(F.octet_length(c), F.lit(0)) for c in fields), F.lit(-1))
        chosen: Column = F.lit(None)
        for c in reversed(fields):
            chosen = F.when(F.octet_length(c) == longest, F.lit(c)).otherwise(chosen)
        marked = out.withColumns({"__over": over, "__cut": chosen})
        cut = lambda c: F.when((F.col("__over") > 0) & (F.col("__cut") == c), F.substring(F.col(c), F.lit(1), F.greatest(F.lit(0), F.length(c) - F.col("__over")))).otherwise(F.col(c))
        out = marked.withColumns({**{c: cut(c) for c in fields}, "truncated": F.col("truncated") | (F.col("__over") > 0)}).select(*names)
    return out


def append(events: DataFrame, root: str, fields: list[str]) -> None:
    """Append to ledgers of JSON lines, one folder a session."""
    capped(events, fields).repartition("sid").write.mode("append").partitionBy("sid").json(root)


def upload(events: DataFrame, send: Callable[[list[dict]], None], size: int = BATCH, tries: int = 5, wait: float = 0.5) -> None:
    """Send rows from the executors in groups of ``size``, each tried again with doubled waits; after the last try the task fails.

    Delivery is at least once: a task that is run again sends its rows again, so receivers drop repeated aids.
    """

    def run(rows) -> None:
        def deliver(group: list[dict]) -> None:
            for attempt in range(tries):
                try:
                    return send(group)
                except Exception:
                    if attempt == tries - 1:
                        raise
                    time.sleep(wait * 2**attempt)

        group: list[dict] = []
        for row in rows:
            group.append(row.asDict(True))
            if len(group) == size:
                deliver(group)
                group = []
        if group:
            deliver(group)

    events.foreachPartition(run)


def upload_stream(events: DataFrame, send: Callable[[list[dict]], None], checkpoint: str, **options):
    """A streaming writer that uploads each batch; offsets are committed after it, so no event is lost."""
    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: upload(batch, send, **options))
