"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

The examples are a bounded sample of the labelled rows, near copies collapsed. Every
term of theirs is in the vocabulary, so every text has neighbours of either class. A term
weighs tf * idf, times SEPARATING where a G-test (at a level for the whole vocabulary)
says that it sets the classes apart: plain TF-IDF lets thousands of chance words outvote
a few telling ones (figures in the README).

The inverted index has two parts. Postings of the rarer terms are added up in full. Of the
frequent terms a matrix is kept in blocks of like examples, with the largest weight of each
term in each block; the sum over a query's terms, with the best of the rarer terms' scores,
bounds every cosine of a block. Blocks are opened from the highest bound on until no bound
reaches the k-th best: exact. Distance-weighted votes of the neighbours, weighted back to
the classes' true shares, are calibrated by isotonic regression on leave-one-out votes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_batches

#: Labelled rows of each class that are learned from, at most (by hash of doc_id).
EXAMPLES = 2_000
#: Weight of a term that sets the classes apart, against others.
SEPARATING = 30.0
#: Examples of one class with this Jaccard similarity of their term sets count once.
SAME = 0.8
#: Frequent terms that are kept as a matrix; examples of a block; texts that are scored at once.
DENSE, BLOCK, CHUNK = 512, 64, 64
#: Scored rows that are sent back at once: whole texts are held in memory on both sides.
ROWS = 8 * CHUNK
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[0] .. starts[0] + counts[0] - 1, starts[1] .. and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def distinct_examples(sets: list[np.ndarray], labels: list[int]) -> list[int]:
    """The examples (sorted term ids) left when later near copies of one class go; candidates share 4 of their 16 least term hashes."""
    kept, seen = [], {}
    for i, (own, label) in enumerate(zip(sets, labels, strict=True)):
        h = (own.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        least = (np.sort(h ^ (h >> np.uint64(32)))[:16]).tolist()
        shared = Counter(j for h in least for j in seen.get((label, h), ()))
        near = [sets[j] for j, s in shared.items() if s >= min(4, len(least))]
        if any((s := len(np.intersect1d(own, x, assume_unique=True))) >= SAME * (len(own) + len(x) - s) for x in near) or not len(own) and (label, None) in seen:
            continue
        kept.append(i)
        for h in least or [None]:
            seen.setdefault((label, h), []).append(i)
    return kept


def _alike(x: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Rows cut in halves along the direction of largest spread, down to blocks."""
    if len(rows) <= BLOCK:
        return [rows]
    own = x[rows] - x[rows].mean(0)
    v = own[np.abs(own).sum(1).argmax()] + 1e-9
    for _ in range(8):
        v = own.T @ (own @ v)
        v /= max(float(np.linalg.norm(v)), 1e-12)
    order = rows[np.argsort(own @ v, kind="stable")]
    half = -(-len(rows) // (2 * BLOCK)) * BLOCK
    return _alike(x, order[:half]) + _alike(x, order[half:])


class Neighbours:
    """The model: vocabulary, block-max index, calibration."""

    def __init__(self, bags: Iterable[dict[str, int]], labels: list[int], shares: tuple[float, float], keys: list | None = None, k: int = 15) -> None:
        vocab: dict[str, int] = {}
        sets, counts = [], []
        for bag in bags:  # one at a time: as dictionaries they are large
            own = np.array([vocab.setdefault(t, len(vocab)) for t in bag], np.int32)
            order = np.argsort(own)
            sets.append(own[order])
            counts.append(np.fromiter(bag.values(), np.int32, len(bag))[order])
        keep = distinct_examples(sets, labels)
        sets, counts, y = [sets[i] for i in keep], [counts[i] for i in keep], np.array([labels[i] for i in keep], np.int64)
        keys = [keys[i] if keys else i for i in keep]
        self.k, n, n1 = k, len(y), int(y.sum())
        self.prior = float(shares[1] / max(sum(shares), 1e-12))
        weight = np.array([shares[0] / max(1, n - n1), shares[1] / max(1, n1)])
        weight /= max(weight.sum(), 1e-12)
        rows = np.repeat(np.arange(n), np.array([len(x) for x in sets], np.int64))
        ids = np.concatenate([*sets, np.empty(0, np.int32)]).astype(np.int64)
        count = np.concatenate([*counts, np.empty(0, np.int32)]).astype(float)
        df = np.bincount(ids, minlength=len(vocab))
        new = np.cumsum(df > 0) - 1  # terms of collapsed copies alone are no terms
        self.vocab = {t: int(new[i]) for t, i in vocab.items() if df[i]}
        ids = new[ids] if len(ids) else ids
        a = np.bincount(ids[y[rows] == 1], minlength=len(self.vocab)).astype(float)
        b = np.bincount(ids, minlength=len(self.vocab)) - a
        cells = [a, b, n1 - a, n - n1 - b]
        g = 2 * (sum(map(_xlogx, cells)) - _xlogx(a + b) - _xlogx(n - a - b) - _xlogx(np.array(float(n1))) - _xlogx(np.array(float(n - n1))) + _xlogx(np.array(float(n))))
        self.separating = g > 2 * math.log(100 * max(1, len(self.vocab)))
        self.idf = (np.log((1 + n) / (1 + a + b)) + 1) * np.where(self.separating, SEPARATING, 1.0)
        frequent = np.argsort(-(a + b), kind="stable")[:DENSE]
        self.column = np.full(len(self.vocab), -1, np.int64)
        self.column[frequent] = np.arange(len(frequent))
        xs = self._unit(rows, ids, count, n)
        dense = self._dense(rows, ids, xs, n)
        blocks = _alike(dense, np.arange(n)) if n else []
        order = np.concatenate(blocks) if blocks else np.empty(0, np.int64)
        self.cuts = np.cumsum([0, *(len(b) for b in blocks)])
        self.y, self.w, self.keys = y[order], weight[y[order]], [keys[i] for i in order]
        self.dense = dense[order]
        self.top = np.stack([self.dense[lo:hi].max(0) for lo, hi in zip(self.cuts, self.cuts[1:], strict=False)]) if n else np.zeros((0, dense.shape[1]))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        rare = self.column[ids] < 0
        by_term = np.lexsort((place[rows[rare]], ids[rare]))
        self.post, self.post_x = place[rows[rare]][by_term].astype(np.int32), xs[rare][by_term]
        self.post_at = np.searchsorted(ids[rare][by_term], np.arange(len(self.vocab) + 1))
        self.opened = self.blocks_seen = 0
        begin = np.searchsorted(rows, np.arange(n + 1))
        votes = np.zeros(n)
        for lo in range(0, n, CHUNK):
            own = order[lo : lo + CHUNK]
            size = begin[own + 1] - begin[own]
            at = _spread(begin[own], size)
            votes[lo : lo + CHUNK] = self.votes(*self._nearest(np.repeat(np.arange(len(own)), size), ids[at], xs[at], len(own), np.arange(lo, lo + len(own))))
        self.steps, self.values = _isotonic(votes, self.y.astype(float), self.w)

    def vectors(self, bags: list[dict[str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors of known terms as (row, term, weight), sorted by row."""
        ids = np.array(list(map(self.vocab.get, chain.from_iterable(bags), repeat(-1))), np.int64)
        count = np.fromiter(chain.from_iterable(map(dict.values, bags)), np.float64, len(ids))
        rows = np.repeat(np.arange(len(bags)), np.fromiter(map(len, bags), np.int64, len(bags)))
        known = ids >= 0
        rows, ids = rows[known], ids[known]
        return rows, ids, self._unit(rows, ids, count[known], len(bags))

    def _unit(self, rows: np.ndarray, ids: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        xs = (1 + np.log(count)) * self.idf[ids]
        return xs / np.sqrt(np.bincount(rows, xs * xs, n))[rows]

    def _dense(self, rows: np.ndarray, ids: np.ndarray, xs: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, int((self.column >= 0).sum())))
        own = self.column[ids] >= 0
        out[rows[own], self.column[ids[own]]] = xs[own]
        return out

    def nearest(self, bags: list[dict[str, int]]) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, examples), k columns each, of the examples of largest cosine; ties to the first in the index.

        Places behind the last example with a cosine above zero have cosine 0.
        """
        return self._nearest(*self.vectors(bags), len(bags))

    def _nearest(self, rows: np.ndarray, ids: np.ndarray, xs: np.ndarray, m: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(self.y), min(self.k, len(self.y))
        if not n or not m:
            return np.zeros((m, 0)), np.zeros((m, 0), np.int64)
        query = self._dense(rows, ids, xs, m)
        rare = self.column[ids] < 0
        count = self.post_at[ids[rare] + 1] - self.post_at[ids[rare]]
        at = _spread(self.post_at[ids[rare]], count)
        partial = np.bincount(np.repeat(rows[rare], count) * n + self.post[at], np.repeat(xs[rare], count) * self.post_x[at], m * n).astype(float).reshape(m, n)
        if skip is not None:
            partial[np.arange(m), skip] = -np.inf
        bound = np.maximum.reduceat(partial, self.cuts[:-1], axis=1) + query @ self.top.T + 1e-9
        found = np.full((m, n), -np.inf)
        todo = np.argsort(-bound, axis=1, kind="stable")
        kth, done, step = np.full(m, 0.0), 0, 4
        while done < todo.shape[1]:
            part = todo[:, done : done + step]
            wanted = np.take_along_axis(bound, part, 1) >= np.maximum(kth, 1e-12)[:, None]
            if not wanted.any():
                break
            for block in np.unique(part[wanted]).tolist():
                lo, hi = self.cuts[block], self.cuts[block + 1]
                own = np.flatnonzero((wanted & (part == block)).any(1))
                found[own, lo:hi] = partial[own, lo:hi] + query[own] @ self.dense[lo:hi].T
            self.opened += int(wanted.sum())
            kth = np.partition(found, n - k, axis=1)[:, n - k]
            done, step = done + step, 2 * step
        self.blocks_seen += m * todo.shape[1]
        found = np.round(found, 9)
        near = np.argpartition(-found, k - 1, axis=1)[:, :k]
        # all that tie with the last place are weighed, so that the first in the index win
        last = np.take_along_axis(found, near, 1).min(1)
        for i in np.flatnonzero((found == last[:, None]).sum(1) > 1):
            near[i] = np.lexsort((np.arange(n), -found[i]))[:k]
        score = np.take_along_axis(found, near, 1)
        order = np.lexsort((near, -score), axis=1)
        score, near = np.take_along_axis(score, order, 1), np.take_along_axis(near, order, 1)
        return np.maximum(score, 0.0), near

    def votes(self, cosines: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Share of toxic neighbours, by cosine and class weight; the prior counts as one faint neighbour."""
        s = cosines * self.w[near]
        faint = 0.01 * float(self.w.mean()) if len(self.w) else 1.0
        return ((s * self.y[near]).sum(1) + faint * self.prior) / (s.sum(1) + faint)

    def score(self, bags: list[dict[str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, cosines, examples); texts without a neighbour have the share of toxic rows."""
        cosines, near = self.nearest(bags)
        votes = self.votes(cosines, near)
        scores = np.interp(votes, self.steps, self.values) if len(self.steps) else votes
        return np.where(cosines.sum(1) > 0, scores, self.prior), cosines, near


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic regression by pooling; one pseudo-example on either side keeps 0 and 1 out of reach."""
    if not len(x):
        return x, y
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for i in order:
        pools.append([y[i] * w[i], w[i], x[i], x[i]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    unit = float(w.mean())
    share = float((y * w).sum() / w.sum())
    value = lambda p: (p[0] + unit * share) / (p[1] + unit)
    xs = [v for p in pools for v in (p[2], p[3])]
    ys = np.maximum.accumulate([v for p in pools for v in (value(p), value(p))])
    return np.array(xs), ys


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, k: int = 15, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Neighbours:
    """Learn from ``labels`` (doc_id, toxic 0/1) of rows in ``docs``.

    At most ``examples`` labelled rows of each class reach the driver, as bags of words. A key with
    two labels counts as toxic; of rows that repeat a key one is taken.
    """
    clean = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)").groupBy("k").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in clean.groupBy("y").count().collect()}
    chosen = [clean.where(F.col("y") == c).orderBy(F.xxhash64("k"), "k").limit(examples) for c in (0, 1)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 x examples rows

    def bags(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [Counter(terms(t)) for t in batch.column("t").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("k"), batch.column("y"), pa.array([" ".join(c) for c in got], pa.string()), pa.array([list(c.values()) for c in got], pa.list_(pa.int32()))], ["k", "y", "term", "n"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(sample, "k").select(F.col("k").cast("long").alias("k"), "y", "t")
    found = map_batches(rows, bags, "k long, y int, term string, n array<int>").dropDuplicates(["k"]).toArrow().sort_by("k")
    each = (dict(zip(t.as_py().split(), c.as_py(), strict=True)) for t, c in zip(found["term"], found["n"], strict=True))
    return Neighbours(each, found["y"].to_pylist(), (float(counts.get(0, 0)), float(counts.get(1, 0))), found["k"].to_pylist(), k)


def score(docs: DataFrame, model: Neighbours, text: str = "text", keep: tuple[str, ...] = ("doc_id",), evidence: int = 3) -> DataFrame:
    """Adds ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) and ``evidence``: key, label and cosine of the nearest examples.

    Null and empty texts, and texts without a known term, have the share of toxic rows and no evidence. Texts
    are taken whole; equal texts have equal scores; examples of one cosine rank by their place in the
    index; repeated rows stay; an empty table gives an empty result. Columns that are not kept are ignored.
    """
    sent = [*keep, *({text} - set(keep))]  # a text that is kept goes once, not once more to be scored
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double, predicted int, evidence array<struct<doc_id:long,toxic:int,cosine:double>>"
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, scores, why = batch.column(sent.index(text)), [], []
        for lo in range(0, batch.num_rows, CHUNK):
            s, cosines, near = model.score([Counter(terms(t)) for t in texts.slice(lo, CHUNK).to_pylist()])
            scores += s.tolist()
            for c, e in zip(cosines[:, :evidence].tolist(), near[:, :evidence].tolist(), strict=True):
                why.append([{"doc_id": model.keys[i], "toxic": int(model.y[i]), "cosine": x} for x, i in zip(c, e, strict=True) if x > 0])
        cols = [*batch.columns[: len(keep)], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(why, kind)]
        return pa.RecordBatch.from_arrays(cols, [*keep, "score", "predicted", "evidence"])

    return map_batches(docs.select(*sent), run, schema, rows=ROWS)
