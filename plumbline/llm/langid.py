"""Language identification by nearest centroids.

Texts become unit TF-IDF vectors of hashed letter 1- to 3-grams. Each language has
several centroids (spherical k-means over a bounded sample of its labelled rows). The
centroid of largest cosine names the language; a text farther away than nearly all
examples of that centroid is marked as rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import map_batches

#: Labelled rows of each language that are learned from, at most (by hash of doc_id).
EXAMPLES = 400
#: Parts of a language's rows that the examples are chosen from first.
PARTS = 16
CENTROIDS = 3
BITS = 12
#: Characters and texts that are vectorised at once.
CHUNK_CHARS, CHUNK_TEXTS = 1 << 19, 256
_letter = np.zeros(0, bool)


def _letters() -> np.ndarray:
    global _letter
    if not len(_letter):
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letter


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x 2**BITS counts of hashed n-grams, number of letters of each text).

    A text stands between two blanks on either side; n-grams without a letter do not count. Long texts are worked off in
    pieces that share two characters: each n-gram counts in the piece that its last character is new in, so the counts are those of the whole text.
    """
    out, letters = np.zeros((len(texts), 1 << BITS), np.float32), np.zeros(len(texts), np.int64)
    pieces = []
    for i, t in enumerate(texts):
        t = f"  {t.lower()}  "
        pieces += [(i, t[max(0, a - 2) : a + CHUNK_CHARS], min(a, 2)) for a in range(0, len(t), CHUNK_CHARS)]
    at = 0
    while at < len(pieces):
        part, size = [], 0
        while at < len(pieces) and (not part or size < CHUNK_CHARS):
            part.append(pieces[at])
            size += len(pieces[at][1])
            at += 1
        cp = np.frombuffer("".join(p[1] for p in part).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(p[1]) for p in part])
        row = np.repeat([p[0] for p in part], sizes)
        start = np.repeat(np.cumsum(sizes) - sizes, sizes)  # where each character's piece begins
        place = np.arange(len(cp)) - start
        new = place >= np.repeat([p[2] for p in part], sizes)
        is_letter = _letters()[cp]
        x = np.where(is_letter, cp, 32).astype(np.uint64)
        letters += np.bincount(row[is_letter & new], minlength=len(texts))
        mix, step = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
        h, some, cells = np.zeros(len(x), np.uint64), np.zeros(len(x), bool), []
        for n in range(3):
            m = len(x) - n
            h = h[:m] * step + x[n:] + np.uint64(1)
            some = some[:m] | is_letter[n:]
            own = some & new[n:] & (place[n:] >= n)  # all of it in the piece
            cells.append((row[n:] * (1 << BITS) + ((h * mix) >> np.uint64(64 - BITS)).astype(np.int64))[own])
        out += np.bincount(np.concatenate(cells), minlength=out.size).reshape(out.shape)
    return out, letters


class Centroids:
    """idf weights, unit centroids, their languages and rejection radii."""

    def __init__(self, counts: np.ndarray, langs: list[str], per_language: int = CENTROIDS) -> None:
        n = len(langs)
        self.idf = (np.log((1 + n) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32) if n else np.ones(1 << BITS, np.float32)
        x = self.unit(counts)
        self.langs: list[str] = []
        centres, radius = [], []
        for lang in sorted(set(langs)):
            own = x[np.array([w == lang for w in langs])]
            c, group = _kmeans(own, min(per_language, len(own)))
            d = 1 - (own * c[group]).sum(1)
            for k in range(len(c)):
                self.langs.append(lang)
                centres.append(c[k])
                radius.append(float(np.quantile(d[group == k], 0.995)) * 1.1 if (group == k).any() else 0.0)
        self.centre = np.array(centres, np.float32).reshape(-1, 1 << BITS)
        self.radius = np.array(radius)

    def unit(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        langs, scores, rejected = [], [], []
        for lo in range(0, len(texts), CHUNK_TEXTS):
            counts, letters = gram_counts([t or "" for t in texts[lo : lo + CHUNK_TEXTS]])
            if not self.langs:
                langs += ["und"] * len(letters)
                scores += [0.0] * len(letters)
                rejected += [True] * len(letters)
                continue
            cos = self.unit(counts) @ self.centre.T
            best = cos.argmax(1)
            # share of the nearest language, against the nearest centroid of every language
            names = np.array(self.langs)
            each = np.stack([cos[:, names == w].max(1) for w in dict.fromkeys(self.langs)], 1)
            share = 1 / np.exp(12 * (each - each.max(1, keepdims=True))).sum(1)
            far = 1 - cos[np.arange(len(best)), best] > self.radius[best]
            blank = letters == 0
            langs += ["und" if b else self.langs[k] for k, b in zip(best, blank, strict=True)]
            scores += np.where(blank, 0.0, np.clip(share, 0, 1)).tolist()
            rejected += (far | blank).tolist()
        return langs, scores, rejected


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds: centres and the centre of each row."""
    seeds = [int((x @ x.mean(0)).argmax())]
    while len(seeds) < k:
        seeds.append(int((x @ x[seeds].T).max(1).argmin()))
    c = x[seeds]
    for _ in range(rounds):
        group = (x @ c.T).argmax(1)
        c = np.stack([x[group == i].mean(0) if (group == i).any() else c[i] for i in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c, (x @ c.T).argmax(1)


def fit(docs: DataFrame, use: Column, examples: int = EXAMPLES, text: str = "text", key: str = "doc_id", lang: str = "lang") -> Centroids:
    """Learn from rows where ``use`` holds, by text and language alone.

    At most ``examples`` rows of each language reach the driver, as sparse counts.
    """
    rows = docs.where(use & F.col(lang).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("l"))
    # the first rows of each part, then of these the first of each language: no task meets more than PARTS x examples
    rows = rows.withColumn("h", F.xxhash64("k"))
    for own in (["l", F.pmod(F.xxhash64("h"), F.lit(PARTS))], ["l"]):
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*own).orderBy("h", "k"))).where(F.col("r") <= examples).drop("r")
    chosen = rows.select("k").distinct()

    def sparse(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, count, seen = [], [], []
        texts = batch.column("t").to_pylist()
        for lo in range(0, len(texts), CHUNK_TEXTS):
            got, letters = gram_counts([t or "" for t in texts[lo : lo + CHUNK_TEXTS]])
            seen += letters.tolist()
            for r in got:
                at = np.flatnonzero(r)
                index.append(at.tolist())
                count.append(r[at].astype(int).tolist())
        return pa.RecordBatch.from_arrays([batch.column("k"), batch.column("l"), pa.array(seen, pa.int64()), pa.array(index, pa.list_(pa.int32())), pa.array(count, pa.list_(pa.int32()))], ["k", "l", "letters", "i", "n"])

    texts = docs.where(use & F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t")).join(F.broadcast(chosen), "k", "left_semi").select(F.col("k").cast("long").alias("k"), "l", "t")
    found = map_batches(texts, sparse, "k long, l string, letters long, i array<int>, n array<int>").dropDuplicates(["k"]).where("letters > 0").collect()
    found.sort(key=lambda r: r["k"])
    counts = np.zeros((len(found), 1 << BITS), np.float32)
    for row, r in enumerate(found):
        counts[row, r["i"]] = r["n"]
    return Centroids(counts, [r["l"] for r in found])


def predict(docs: DataFrame, model: Centroids, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (0 to 1) and ``rejected`` to the kept columns.

    ``lang_pred`` is ``und`` for null texts and texts without a letter (score 0), and
    where nothing was learned. Texts are taken whole; repeated rows stay and equal texts have
    equal results, ties going to the language first in order; an empty table gives an empty result; other
    columns are ignored.
    """
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double, rejected boolean"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = model.predict(batch.column(len(keep)).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, t) for c, t in zip(got, (pa.string(), pa.float64(), pa.bool_()), strict=True))], [*keep, "lang_pred", "score", "rejected"])

    return map_batches(docs.select(*keep, F.col(text).alias("__text")), run, schema)
