"""Hard negatives by a vector-approximation file.

Every vector is stored as one cell number for each dimension beside its exact components. A query looks up, for each
cell, the least and the greatest share that any vector of that cell can have in the inner product; the sums bound the
score. Only rows whose bounds reach into a window that is still open are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.llm.common import materialise

#: Cells of a dimension.
CELLS = 64
#: Queries are broadcast in blocks of at most so many bytes of components.
BLOCK_BYTES = 16 << 20
#: Queries whose tables are made at once, rows that are bounded at once, and pairs that are scored at once.
QUERIES, TILE, PAIRS = 512, 512, 1 << 16
#: Sums up to this are exact as doubles; beyond, they are added as whole numbers of any size and end at +-LIMIT.
EXACT = 2.0**53
LIMIT = 2**63 - 1


@dataclass
class Stats:
    """Figures of all rows: the dimension is that of the longest vector, shorter ones count as filled up with zeros."""

    dim: int
    low: np.ndarray
    high: np.ndarray
    edges: np.ndarray  # dim x (CELLS - 1)

    def cells(self, q: np.ndarray) -> np.ndarray:
        out = np.empty(q.shape, np.uint8)
        for d in range(self.dim):
            out[:, d] = np.searchsorted(self.edges[d], q[:, d], side="right")
        return out

    def borders(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest component of each cell, dim x CELLS."""
        low = np.concatenate([self.low[:, None], np.maximum(self.edges, self.low[:, None])], 1)
        high = np.concatenate([np.minimum(self.edges, self.high[:, None]), self.high[:, None]], 1)
        return low, np.maximum(low, high)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Components floor(256 * x) as float64 of a batch of vectors, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.values.slice(column.offsets[0].as_py(), int(sizes.sum())).to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), dim))
    out[np.arange(dim) < sizes[:, None]] = np.floor(256.0 * values)
    return out


def eligible(vectors: DataFrame) -> DataFrame:
    """Rows with a label and a vector of finite components: vec_id, label, embedding."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")


def statistics(rows: DataFrame) -> Stats:
    """Dimension, limits and cells from all rows: each task sends one row a dimension."""
    dim = rows.agg(F.max(F.size("embedding"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dim, np.inf), np.full(dim, -np.inf)
        total, squares, n = np.zeros(dim), np.zeros(dim), 0
        for batch in batches:
            if batch.num_rows:
                q = _matrix(batch.column(0), dim)
                low, high = np.minimum(low, q.min(0)), np.maximum(high, q.max(0))
                total, squares, n = total + q.sum(0), squares + (q * q).sum(0), n + len(q)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), *map(pa.array, (low, high, total, squares, np.full(dim, n)))], names=["d", "low", "high", "total", "squares", "n"])

    parts = rows.select("embedding").mapInArrow(run, "d long, low double, high double, total double, squares double, n long")
    found = parts.groupBy("d").agg(F.min("low"), F.max("high"), F.sum("total"), F.sum("squares"), F.sum("n")).orderBy("d").toPandas().to_numpy(dtype=float).reshape(-1, 6)
    low, high, total, squares, n = found[:, 1:].T
    mean = total / n
    spread = 3 * np.sqrt(np.maximum(squares / n - mean * mean, 1.0))
    with np.errstate(invalid="ignore", over="ignore"):
        edges = np.nan_to_num((mean - spread)[:, None] + (2 * spread)[:, None] * np.linspace(0, 1, CELLS + 1)[1:-1])
    return Stats(len(found), low, high, np.maximum.accumulate(np.ceil(edges), axis=1))


def build(rows: DataFrame, stats: Stats) -> DataFrame:
    """The vector-approximation file: rid, vec_id, label, cells, components. ``rid`` tells rows apart and is written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 36
        for batch in batches:
            if batch.num_rows:
                q = _matrix(batch.column(2), stats.dim)
                cells = stats.cells(q)
                exact = q.astype(np.int16) if np.abs(q).max(initial=0) < 2**15 else q
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(rid, rid + len(q))), batch.column(0), batch.column(1), pa.array([r.tobytes() for r in cells], pa.binary()), pa.array([r.tobytes() for r in exact], pa.binary())], names=["rid", "vec_id", "label", "cells", "exact"]
                )
                rid += len(q)

    return materialise(rows.select("vec_id", "label", "embedding").mapInArrow(run, "rid long, vec_id long, label long, cells binary, exact binary"))


def _exact(column, dim: int) -> np.ndarray:
    """Stored components as float64; two bytes each where a batch held none beyond."""
    return np.array([np.frombuffer(x, np.int16 if len(x) == 2 * dim else np.float64) for x in column], np.float64).reshape(len(column), dim)


@dataclass
class Block:
    """Queries of one pass, each with the same number of windows [low, high] of scores (empty ones have low > high)."""

    rid: np.ndarray
    label: np.ndarray
    q: np.ndarray
    low: np.ndarray
    high: np.ndarray
    keep: int
    same_label: bool


class Search:
    """Bounds and scores of one task's rows for up to QUERIES queries; keeps the best rows of every window so far."""

    def __init__(self, block: Block, stats: Stats, part: slice):
        self.rid, self.label, self.q, self.high = block.rid[part], block.label[part], block.q[part], block.high[part]
        self.floor = np.where(block.low[part] <= self.high, block.low[part], np.inf)
        self.keep, self.same_label, self.stats = block.keep, block.same_label, stats
        low, high = stats.borders()
        with np.errstate(over="ignore", invalid="ignore"):
            peak = float(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) * np.abs(self.q).max(initial=0) * max(stats.dim, 1))
        #: sums of 32-bit numbers are off by so much at most
        self.slack = peak * 2.0**-23 * (stats.dim + 2) if peak < 1e30 else np.inf
        self.whole = peak < EXACT
        #: query, window, score, vec_id, no vec_id, rid
        self.rows = [np.empty(0, kind) for kind in (np.int64, np.int64, np.int64, np.int64, bool, np.int64)]

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """For each dimension and cell the least and the greatest product with each query."""
        low, high = self.stats.borders()
        with np.errstate(over="ignore", invalid="ignore"):
            x, y = low[:, :, None] * self.q.T[:, None, :], high[:, :, None] * self.q.T[:, None, :]
            return np.minimum(x, y).astype(np.float32), np.maximum(x, y).astype(np.float32)

    def add(self, rid: np.ndarray, vec_id: np.ndarray, null_id: np.ndarray, label: np.ndarray, cells: np.ndarray, q: np.ndarray) -> None:
        tables = self._tables()
        for at in range(0, len(rid), TILE):
            part = slice(at, at + TILE)
            self._tile(*tables, rid[part], vec_id[part], null_id[part], label[part], cells[part], q[part])

    def _tile(self, least_of, most_of, rid, vec_id, null_id, label, cells, q) -> None:
        least, most = np.zeros((len(rid), len(self.rid)), np.float32), np.zeros((len(rid), len(self.rid)), np.float32)
        row = np.empty_like(least)
        with np.errstate(over="ignore", invalid="ignore"):
            for d in range(self.stats.dim):
                least += np.take(least_of[d], cells[:, d], axis=0, out=row, mode="clip")
                most += np.take(most_of[d], cells[:, d], axis=0, out=row, mode="clip")
            may = np.zeros(least.shape, bool)
            for k in range(self.high.shape[1]):
                may |= ~((most + self.slack < self.floor[:, k]) | (least - self.slack > self.high[:, k]))  # unknown bounds stay
        may &= (label[:, None] == self.label) == self.same_label
        may &= rid[:, None] != self.rid
        rows, queries = np.nonzero(may)
        for at in range(0, len(rows), PAIRS):
            r, a = rows[at : at + PAIRS], queries[at : at + PAIRS]
            if self.whole:
                score = np.einsum("ij,ij->i", q[r], self.q[a]).astype(np.int64)
            else:
                score = np.array([max(-LIMIT, min(LIMIT, sum(int(x) * int(y) for x, y in zip(q[i], self.q[j], strict=True)))) for i, j in zip(r, a, strict=True)], np.int64)
            self._merge(a, score, vec_id[r], null_id[r], rid[r])

    def _merge(self, a, score, vec_id, null_id, rid) -> None:
        """Rows that are in a window join the kept ones; each window keeps its best."""
        parts = []
        for k in range(self.high.shape[1]):
            i = np.nonzero((score >= self.floor[a, k]) & (score <= self.high[a, k]))[0]
            if len(i):
                parts.append((a[i], np.full(len(i), k), score[i], vec_id[i], null_id[i], rid[i]))
        if not parts:
            return
        rows = [np.concatenate(column) for column in zip(self.rows, *parts, strict=True)]
        query, window, score, vec_id, null_id, rid = rows
        order = np.lexsort((rid, vec_id, null_id, -score, window, query))
        group = query[order] * self.high.shape[1] + window[order]
        start = np.nonzero(np.r_[True, group[1:] != group[:-1]])[0]
        rank = np.arange(len(group)) - np.repeat(start, np.diff(np.r_[start, len(group)]))
        self.rows = [x[order[rank < self.keep]] for x in rows]
        full = order[rank == self.keep - 1]
        self.floor[query[full], window[full]] = score[full]

    def best(self) -> pa.RecordBatch:
        query, window, score, vec_id, null_id, rid = self.rows
        return pa.RecordBatch.from_arrays([pa.array(self.rid[query]), pa.array(window.astype(np.int32)), pa.array(score), pa.array(vec_id, mask=null_id), pa.array(rid)], names=["query", "window", "score", "vec_id", "rid"])


FOUND = "query long, window int, score long, vec_id long, rid long"


def search(va: DataFrame, stats: Stats, queries: DataFrame, keep: int, same_label: bool) -> DataFrame:
    """The best ``keep`` rows of ``va`` for each window of each query: query, window, score, vec_id, rid, rank.

    ``queries`` has rid, label, exact and ``windows``, an array of structs of low and high. Queries are sorted out into
    blocks whose components take BLOCK_BYTES at most; each block is broadcast and meets all rows where they lie, so rows
    are never shuffled or paired up. Each task sends its best rows of a window only.
    """
    spark = va.sparkSession
    n = queries.count()
    size = max(1, BLOCK_BYTES // (8 * max(1, stats.dim)))
    blocks = -(-n // size)
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(max(1, blocks))))
    out = None
    for k in range(blocks):
        found = numbered.where(F.col("block") == k).select("rid", "label", "exact", "windows").toPandas()
        if not len(found):
            continue
        wide = max(map(len, found.windows))
        low, high = np.full((len(found), wide), np.inf), np.full((len(found), wide), -np.inf)
        for i, windows in enumerate(found.windows):
            for j, w in enumerate(windows):
                low[i, j], high[i, j] = w["low"], w["high"]
        block = spark.sparkContext.broadcast(Block(found.rid.to_numpy(), found.label.to_numpy(), _exact(found.exact, stats.dim), low, high, keep, same_label))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            states = [Search(block.value, stats, slice(at, at + QUERIES)) for at in range(0, len(block.value.rid), QUERIES)]
            for batch in batches:
                if batch.num_rows:
                    cells = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, stats.dim)
                    ids = batch.column(1)
                    null_id = ids.is_null().to_numpy(zero_copy_only=False)
                    rows = batch.column(0).to_numpy(), ids.fill_null(0).to_numpy(), null_id, batch.column(2).to_numpy(), cells, _exact(batch.column(4).to_pylist(), stats.dim)
                    for state in states:
                        state.add(*rows)
            for state in states:
                yield state.best()

        part = va.select("rid", "vec_id", "label", "cells", "exact").mapInArrow(run, FOUND)
        part = materialise(part) if blocks > 1 else part
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], FOUND)
    # tasks' best rows meet: at most ``keep`` a window and task
    best = F.row_number().over(Window.partitionBy("query", "window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid"))
    return out.withColumn("rank", best).where(F.col("rank") <= keep)


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Hard negatives of the rows of ``vectors`` (vec_id, label, embedding) for which ``anchor`` holds.

    A component x becomes floor(256 * x); a score is the inner product of two rows. An anchor's positives are the
    ``positives`` rows of its label with the highest scores; for each, the ``negatives`` rows of other labels with the
    highest scores between ``low`` and ``high`` percent of the positive's score follow: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score.

    Rows with a null label, a null vector or a null or non-finite component take no part. Ties go to the smaller vec_id,
    null ones last. Rows that repeat are rows of their own: a copy of an anchor may be its positive, and an anchor that
    stands twice is answered twice. Shorter vectors count as filled up with zeros, so empty ones score 0. Scores beyond 63
    bits end there; windows are compared as doubles. An anchor without positives, a positive without negatives and an empty table
    give no rows. Other columns are left behind.
    """
    rows = eligible(vectors)
    stats = statistics(rows)
    va = build(rows, stats)
    anchors = va.where(anchor).select("rid", F.col("vec_id").alias("anchor_id"), "label", "exact")
    endless = F.array(F.struct(F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")))
    near = materialise(search(va, stats, anchors.withColumn("windows", endless), positives, same_label=True))
    score = F.col("score").cast("decimal(20,0)")
    window = F.when(F.col("score") < 0, F.struct(F.lit(1.0).alias("low"), F.lit(0.0).alias("high"))).otherwise(F.struct(F.ceil(score * low / 100).cast("double").alias("low"), F.floor(score * high / 100).cast("double").alias("high")))
    windows = near.select("query", "rank", window.alias("w")).groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "w"))), lambda x: x["w"]).alias("windows"))
    far = search(va, stats, anchors.join(windows, anchors.rid == windows.query).drop("query"), negatives, same_label=False)
    of = near.select("query", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.select("query", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(of, ["query", "window"]).join(anchors.select(F.col("rid").alias("query"), "anchor_id"), "query")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
