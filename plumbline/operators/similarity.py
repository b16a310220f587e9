"""Shingles, MinHash, banding, containment, longest common subsequences, cosine."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.operators.graph import stored


def tokens(text: Column) -> Column:
    """Lower-case ASCII words."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once and not for each use in a lambda."""
    return F.transform(F.array(value), body)[0]


def holds(text: Column, words: tuple[str, ...]) -> Column:
    """Whether ``text`` holds one of ``words``, if there are any: sooner known than whether it meets a pattern that needs one."""
    return functools.reduce(Column.__or__, (text.contains(w) for w in words)) if words else F.lit(True)


def shingles(words: Column, n: int = 5) -> Column:
    """Distinct runs of ``n`` words; shorter texts have none."""

    def runs(w: Column) -> Column:
        k = F.size(w) - n + 1
        every = F.transform(F.sequence(F.lit(1), k), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(k < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(every))

    return bind(words, runs)


def md5_int(value: Column) -> Column:
    """The first 32 bits of an MD5, which other SQL engines can compute too."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def minhash(shingle: Column, perms: int) -> Column:
    """Smallest seeded hash of the shingles, for each of ``perms`` seeds."""
    seeded = lambda sh: F.transform(F.sequence(F.lit(0), F.lit(perms - 1)), lambda p: F.array_min(F.transform(sh, lambda s: md5_int(F.concat(p.cast("string"), F.lit(":"), s)))))
    return bind(shingle, seeded)


#: Permutations and rows a band of the reference: pairs of similarity 0.8 meet with 94.7 %, of 0.9 with 99.999 %.
PERMS, ROWS = 128, 8
_SEEDS = np.random.default_rng(42).integers(0, 1 << 63, PERMS, dtype=np.uint64)


def _least(hashes: np.ndarray) -> np.ndarray:
    least = np.full(PERMS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 512):
        x = np.asarray(hashes[lo : lo + 512], np.int64).view(np.uint64)[:, None] ^ _SEEDS
        y = np.empty_like(x)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= np.right_shift(x, np.uint64(shift), out=y)
            x *= np.uint64(factor)
        x ^= np.right_shift(x, np.uint64(31), out=y)
        np.minimum(least, x.min(axis=0), out=least)
    return least.view(np.int64)


def wide_signatures(rows: DataFrame, key: str, hashes: str) -> DataFrame:
    """(key, sig): MinHash of PERMS permutations over each row's 64-bit shingle hashes, of which it has one at least."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "sig": [_least(h) for h in b[hashes]]})

    return rows.select(key, hashes).mapInPandas(run, f"{key} long, sig array<long>")


_WORD = re.compile(rb"[a-z0-9]+")


def text_signatures(rows: DataFrame, key: str, text: str, n: int = 5) -> DataFrame:
    """(key, sig): as ``wide_signatures`` over the XXH64 of each text's ``shingles``; texts without one have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sigs = [], [np.empty(0, np.int64)]
            for k, lower in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = _WORD.findall(lower.encode()) if lower else []
                found = {xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)}
                if found:
                    keys.append(k)
                    sigs.append(_least(np.fromiter(found, np.uint64, len(found)).view(np.int64)))
            ends = np.arange(len(keys) + 1, dtype=np.int32) * PERMS
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(ends, np.concatenate(sigs))], [key, "sig"])

    return rows.select(key, F.lower(text)).mapInArrow(run, f"{key} long, sig array<long>")


def _bands(sigs: DataFrame, key: str, sig: str) -> tuple[DataFrame, DataFrame]:
    """(band, value, rep) of one row of each signature, and the links (a, b) of the others to it."""
    reps = sigs.groupBy(sig).agg(F.min(key).alias("rep"))
    value = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(PERMS // ROWS - 1)), lambda b: F.xxhash64(F.slice(F.col(sig), b * ROWS + 1, ROWS))))
    same = sigs.join(reps, sig).where(F.col(key) != F.col("rep")).select(F.col("rep").alias("a"), F.col(key).alias("b"))
    return reps.select("rep", value.alias("band", "value")), same


def wide_pairs(sigs: DataFrame, key: str, sig: str) -> DataFrame:
    """As ``lsh_pairs``, for signatures of ``wide_signatures``: distinct pairs that share a band."""
    bands, same = _bands(sigs, key, sig)
    near = bands.withColumnRenamed("rep", "a").join(bands.withColumnRenamed("rep", "b"), ["band", "value"])
    return near.where("a < b").select("a", "b").distinct().unionByName(same)


def wide_stars(sigs: DataFrame, key: str, sig: str) -> DataFrame:
    """Links with the same components as ``wide_pairs``: each row of a band to the smallest, so n rows give n links."""
    bands, same = _bands(sigs, key, sig)
    stars = bands.join(bands.groupBy("band", "value").agg(F.min("rep").alias("a")), ["band", "value"])
    return stars.where("a < rep").select("a", F.col("rep").alias("b")).distinct().unionByName(same)


def lsh_pairs(sigs: DataFrame, key: str, sig: str, rows: int, perms: int) -> DataFrame:
    """Distinct pairs that share a band of ``rows`` values.

    Rows with equal signatures are linked to the smallest of them, so that a group of
    copies makes a star and not all pairs; only one row of each signature enters the bands.
    """
    reps = sigs.groupBy(sig).agg(F.min(key).alias("rep"))
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(perms // rows - 1)), lambda b: F.array_join(F.slice(F.col(sig), b * rows + 1, rows), ",")))
    bands = reps.select("rep", band.alias("band", "value"))
    a, b = bands.select("band", "value", F.col("rep").alias("a")), bands.select("band", "value", F.col("rep").alias("b"))
    near = a.join(b, ["band", "value"]).where("a < b").select("a", "b").distinct()
    same = sigs.join(reps, sig).where(F.col(key) != F.col("rep")).select(F.col("rep").alias("a"), F.col(key).alias("b"))
    return near.unionByName(same)


@F.pandas_udf(T.DoubleType())
def lcs_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * LCS / (len a + len b) of token arrays; 0 where the shorter is under half the longer."""
    out = []
    for x, y in zip(a, b, strict=True):
        n, m = len(x), len(y)
        if not n or not m or min(n, m) / max(n, m) < 0.5:
            out.append(0.0)
            continue
        # bit-parallel (Hyyro): the zero bits of v are the places of y where the row of the table rises
        places: dict[str, int] = {}
        for i, token in enumerate(y):
            places[token] = places.get(token, 0) | 1 << i
        full = (1 << m) - 1
        v = full
        for token in x:
            u = v & places.get(token, 0)
            v = ((v + u) | (v - u)) & full
        out.append(2.0 * (m - v.bit_count()) / (n + m))
    return pd.Series(out)


#: Words of one side of a tile.
TILE_WORDS = 4_000_000


def lcs_pairs(rows: DataFrame, key: str, words: str, share: float = 0.7) -> DataFrame:
    """(a, b, lcs): all pairs a < b of rows whose ``lcs_similarity`` of words is ``share`` or more; exact.

    What two rows have in common as bags of words bounds their common subsequence, and their lengths bound both. So rows meet
    in tiles of TILE_WORDS a side, by classes of length of which only neighbours can be alike enough; a tile counts common words by their
    hashes, which never makes them fewer, and only pairs with enough of them are verified. Equal rows meet others once and are all paired at the
    end. The tiles cost the square of the rows.
    """
    kind = rows.schema[key].dataType.simpleString()
    texts = stored(rows.where(F.size(words) > 0).select(F.col(key).alias("id"), F.col(words).alias("w"), F.sha2(F.array_join(words, "\0"), 256).alias("text")))
    members = stored(texts.select("id", "text").join(texts.groupBy("text").agg(F.min("id").alias("rep")), "text").select("rep", "id"))
    n = F.size("w")
    level = F.floor(F.log(n) / math.log((2 - share) / share + 1e-3)).cast("int")
    one = texts.join(members.select("rep").distinct(), F.col("id") == F.col("rep"), "left_semi")
    one = stored(one.select(F.col("id").alias("rep"), "w", n.alias("n"), level.alias("level"), F.transform("w", lambda x: F.hash(x)).alias("h")))

    counted = {r["level"]: -(-r["n"] // TILE_WORDS) for r in one.groupBy("level").agg(F.sum("n").alias("n")).collect()}
    known = F.create_map(*(F.lit(x) for pair in counted.items() for x in pair)) if counted else F.create_map(F.lit(0), F.lit(1))
    parts = lambda at: F.coalesce(F.try_element_at(known, at), F.lit(0))
    part, lv = F.pmod(F.xxhash64("rep"), parts(F.col("level"))).cast("int"), F.col("level")
    tile = lambda b, p, c, q, right: F.struct(b.alias("b"), p.cast("int").alias("p"), c.alias("c"), q.cast("int").alias("q"), right.alias("right"))
    every = lambda at, made: F.when(parts(at) > 0, F.transform(F.sequence(F.lit(0), F.greatest(parts(at) - 1, F.lit(0))), made)).otherwise(F.array())
    own = every(lv, lambda q: tile(lv, F.least(F.col("part"), q), lv, F.greatest(F.col("part"), q), F.col("part") > q))
    above = every(lv + 1, lambda q: tile(lv, F.col("part"), lv + 1, q, F.lit(False)))
    below = every(lv - 1, lambda q: tile(lv - 1, q, lv, F.col("part"), F.lit(True)))
    sent = one.select("rep", "n", "level", "h", part.alias("part")).select("rep", "n", "h", F.explode(F.concat(own, above, below)).alias("t")).select("rep", "n", "h", "t.*")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        diagonal = bool((group["b"].iat[0] == group["c"].iat[0]) and (group["p"].iat[0] == group["q"].iat[0]))
        left, right = group[~group["right"]], group[group["right"]]
        right = left if diagonal else right
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        if len(left) and len(right):
            # for each word the rows of the left side that hold it, and how often
            ids, sizes = left["rep"].to_numpy(), left["n"].to_numpy()
            word, row = np.concatenate(left["h"].to_numpy()), np.repeat(np.arange(len(left)), sizes)
            order = np.lexsort((row, word))
            word, row = word[order], row[order]
            begin = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (row[1:] != row[:-1])])
            often, word, row = np.diff(np.r_[begin, len(word)]), word[begin], row[begin]
            found, first = np.unique(word, return_index=True)
            first = np.r_[first, len(word)]
            for rep, size, own_words in zip(right["rep"], right["n"], right["h"], strict=True):
                held, times = np.unique(own_words, return_counts=True)
                at = np.minimum(np.searchsorted(found, held), len(found) - 1)
                there = found[at] == held
                common = np.zeros(len(left), np.int64)
                for k, most in zip(at[there], times[there], strict=True):
                    lo, hi = first[k], first[k + 1]
                    common[row[lo:hi]] += np.minimum(often[lo:hi], most)
                near = ids[2 * common >= share * (sizes + size) - 1e-6]
                near = near[near < rep] if diagonal else near
                a.append(near)
                b.append(np.full(len(near), rep, dtype=ids.dtype))
        return pd.DataFrame({"a": np.concatenate(a) if a else [], "b": np.concatenate(b) if b else []})

    near = sent.groupBy("b", "p", "c", "q").applyInPandas(meet, f"a {kind}, b {kind}")
    side = lambda x: one.select(F.col("rep").alias(x), F.col("w").alias(f"w{x}"))
    alike = near.join(side("a"), "a").join(side("b"), "b").select("a", "b", lcs_similarity("wa", "wb").alias("lcs")).where(F.col("lcs") >= share)
    copied = members.groupBy("rep").count().where("count > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("lcs"))
    of = lambda x: members.select(F.col("rep").alias(x), F.col("id").alias(f"id_{x}"))
    both = alike.unionByName(copied).join(of("a"), "a").join(of("b"), "b").where("a <> b or id_a < id_b")
    return both.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "lcs")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; 0 for unequal lengths or a zero norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def block_cosines(rows: DataFrame, queries: DataFrame, top: int, low: float, high: float, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(query_id, vec_id, c) of the ``top`` nearest rows, and (query_id, in_band) with ``low`` <= c < ``high``, of every query.

    Both tables have vec_id and v; a query does not meet its own id. Cosines count to 12 places; ties go by id.
    """
    cut = lambda df: df.count() // block + 1
    nr, nq = cut(rows), cut(queries)
    part = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = rows.select("vec_id", "v", part(nr, 1).alias("i"), every(nq).alias("j"), F.lit(False).alias("asks")).unionByName(queries.select("vec_id", "v", every(nr).alias("i"), part(nq, 2).alias("j"), F.lit(True).alias("asks")))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        vectors = [np.asarray(v if v is not None else [], float) for v in group["v"]]
        size = np.array([len(v) for v in vectors])
        flat = np.zeros((len(vectors), size.max()))
        for row, v in zip(flat, vectors, strict=True):
            row[: len(v)] = v
        norm = np.sqrt((flat**2).sum(axis=1))
        flat /= np.where(norm > 0, norm, 1)[:, None]
        ids, asks = group["vec_id"].to_numpy(), group["asks"].to_numpy()
        at = np.flatnonzero(~asks)
        out = []
        for q in np.flatnonzero(asks) if len(at) else ():
            c = np.round(np.where(size[at] == size[q], flat[at] @ flat[q], 0.0), 12)
            other = ids[at] != ids[q]
            c, near = c[other], ids[at][other]
            best = np.flatnonzero(c >= np.partition(c, -top)[-top]) if len(c) > top else np.arange(len(c))
            best = best[np.argsort(-c[best], kind="stable")][:top]
            out.append((ids[q], near[best], c[best], int(((c >= low) & (c < high)).sum())))
        return pd.DataFrame(out, columns=["query_id", "ids", "cs", "n"])

    found = both.groupBy("i", "j").applyInPandas(meet, "query_id long, ids array<long>, cs array<double>, n long")
    pairs = found.select("query_id", F.explode(F.arrays_zip("ids", "cs")).alias("p")).select("query_id", F.col("p.ids").alias("vec_id"), F.col("p.cs").alias("c"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("c"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= top).drop("rank"), found.groupBy("query_id").agg(F.sum("n").alias("in_band"))


def containment(part: Column, whole: Column) -> Column:
    """Share of the shingles of ``part`` that ``whole`` has."""
    return F.when(F.size(part) == 0, 0.0).otherwise(F.size(F.array_intersect(part, whole)) / F.size(part))
