"""SimHash near-duplicates by sharded vantage-point trees.

A pair within ``radius`` bits differs in at most ``radius // m`` bits of one of
``m`` sub-fingerprints (pigeonhole). Hamming distance over a sub-fingerprint is a
metric, so for each of them a vantage-point tree partitions the fingerprints:

* the upper levels give shards. A fingerprint lives in one shard of each tree and
  also visits, as a query, the shards that its ball overlaps: by the triangle bound
  it has to enter a branch only if its distance to the vantage point is within the
  ball's radius of the branch's distances;
* inside a shard the tree goes on in numpy, with the same bound, down to small leaves,
  whose pairs are compared over all 64 bits.

Each shard sends only the edges of a spanning forest, so that a group of n near
copies costs O(n) rows, and no link is lost to the components. A shard with
many fingerprints is cut into tiles of (home part, visitor part).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import hot_keys, join_on_skewed_key, map_batches, materialise, trim
from plumbline.llm.components import components

#: Fingerprints of one sub-fingerprint's tree that a shard has on average, at most.
SHARD_ROWS = 65_536
#: Rows of a shard from which it is cut into tiles.
TILE_ROWS = 262_144
MAX_LEVELS = 12
#: Vantage points of the shard levels are chosen from so many fingerprints.
SAMPLE = 2_048
LEAF = 48


# --- fingerprints ---------------------------------------------------------------


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle (ASCII lower case), in order, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lens) - 1
    starts = (ends - lens + 1)[:n].tolist()
    stops = ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """The bits that over half the hashes have, as a signed integer; zero without a hash."""
    n, counts = len(h), np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        part = h[lo : lo + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * counts > n).astype(np.uint8), bitorder="little")
    return int(bits.view(np.int64)[0])


def text_fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash of word shingles, as a signed integer."""
    return majority(shingle_hashes(text, shingle))


def remix(h: np.ndarray, number: int) -> np.ndarray:
    """An independent hash of each hash (the splitmix64 finaliser); number 0 is the hash itself."""
    if not number:
        return h
    z = h + np.uint64(number * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp) of every row; null and wordless texts have fingerprint zero."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        last: dict[bytes, int] = {}
        out = []
        for t in batch.column(1).to_pylist():
            own = xxhash.xxh3_128_digest(t or "")
            if own not in last:
                last[own] = text_fingerprint(t, shingle)
            out.append(last[own])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["doc_id", "fp"])

    return map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text)), run, "doc_id long, fp long")


# --- trees ----------------------------------------------------------------------


def masks(radius: int) -> list[int]:
    """Sub-fingerprints, as bit masks: pairs differ in at most one bit of one of them."""
    m = radius // 2 + 1
    cuts = [round(64 * i / m) for i in range(m + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def _distance(fp: np.ndarray, vantage: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((fp ^ vantage) & mask).astype(np.int16)


def build_shards(sample: np.ndarray, mask: int, levels: int, seed: int) -> list[tuple[int, int]]:
    """The shard levels of one tree as a heap of (vantage point, median distance)."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple[int, int]] = []
    parts = [sample]
    for _ in range(levels):
        below = []
        for part in parts:
            pool = part if len(part) >= 8 else sample
            best = None
            for v in rng.choice(pool, 6) if len(pool) else rng.integers(0, 1 << 63, 6, dtype=np.uint64):
                d = _distance(pool, np.uint64(v), np.uint64(mask))
                mu = int(np.median(d)) if len(d) else 32
                even = abs(2 * int((d <= mu).sum()) - len(d))
                if best is None or even < best[0]:
                    best = (even, int(v), mu)
            nodes.append(best[1:])
            d = _distance(part, np.uint64(best[1]), np.uint64(mask))
            below += [part[d <= best[2]], part[d > best[2]]]
        parts = below
    return nodes


def _route(fp: np.ndarray, mask: int, nodes: list[tuple[int, int]], levels: int, r: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, rows that enter it, whether it is their home)."""
    stack = [(0, np.arange(len(fp)), np.ones(len(fp), bool))]
    while stack:
        node, rows, home = stack.pop()
        if not len(rows):
            continue
        if node >= (1 << levels) - 1:
            yield node - (1 << levels) + 1, rows, home
            continue
        vantage, mu = nodes[node]
        d = _distance(fp[rows], np.uint64(vantage), np.uint64(mask))
        near, far = d <= mu + r, d >= mu + 1 - r
        stack.append((2 * node + 1, rows[near], (home & (d <= mu))[near]))
        stack.append((2 * node + 2, rows[far], (home & (d > mu))[far]))


class Forest:
    """Union-find that takes arrays of pairs and keeps the edges that joined two sets."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def _find(self, i: np.ndarray) -> np.ndarray:
        r = self.root[i]
        while not np.array_equal(up := self.root[r], r):
            r = up
        self.root[i] = r
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self._find(a), self._find(b)
        new = x != y
        if not new.any():
            return
        pairs = np.unique(np.stack([np.minimum(x, y)[new], np.maximum(x, y)[new]], 1), axis=0)
        for p, q in pairs.tolist():
            while self.root[p] != p:
                p = self.root[p]
            while self.root[q] != q:
                q = self.root[q]
            if p != q:
                self.root[max(p, q)] = min(p, q)
                self.edges.append((min(p, q), max(p, q)))


def link_shard(fp: np.ndarray, home: np.ndarray, mask: int, radius: int, r: int, seed: int = 7) -> np.ndarray:
    """Edges (k x 2, rows of ``fp``) that connect all pairs (home, any) within ``radius``.

    Each edge joins two rows that are connected by links; together they connect
    exactly what the links connect.
    """
    forest, rng, m = Forest(len(fp)), np.random.default_rng(seed), np.uint64(mask)
    stack = [(np.flatnonzero(home), np.arange(len(fp)), 0)]
    while stack:
        data, asked, failed = stack.pop()
        if not len(data) or not len(asked):
            continue
        if len(data) <= LEAF or failed >= 3:
            step = max(1, (1 << 21) // len(asked))
            for lo in range(0, len(data), step):
                part = data[lo : lo + step]
                i, j = np.nonzero(np.bitwise_count(fp[part][:, None] ^ fp[asked][None, :]) <= radius)
                forest.join(part[i], asked[j])
            continue
        v = fp[data[rng.integers(len(data))]] ^ rng.integers(0, 1 << 63, dtype=np.uint64)
        d = _distance(fp[data], v, m)
        mu = int(np.median(d))
        near = d <= mu
        if near.all():
            mu -= 1
            near = d <= mu
        if not near.any() or near.all():
            stack.append((data, asked, failed + 1))
            continue
        e = _distance(fp[asked], v, m)
        lopsided = failed + 1 if min(near.sum(), (~near).sum()) < len(data) // 16 else 0
        stack.append((data[near], asked[e <= mu + r], lopsided))
        stack.append((data[~near], asked[e >= mu + 1 - r], lopsided))
    return np.array(forest.edges, np.int64).reshape(-1, 2)


# --- the operator ---------------------------------------------------------------


def links(points: DataFrame, radius: int = 4, shard_rows: int = SHARD_ROWS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges (a, b) between rows of ``points`` (fp distinct, rep) within ``radius`` bits.

    The edges connect exactly what all links connect. ``a`` and ``b`` are reps.
    """
    n = points.count()
    levels = min(MAX_LEVELS, max(0, int(np.ceil(np.log2(max(1, n / shard_rows))))))
    seen = points.orderBy(F.xxhash64("fp")).limit(SAMPLE).select("fp").collect() if levels else []
    sample = np.array([r[0] for r in seen], np.int64).view(np.uint64)
    parts = masks(radius)
    r = radius // len(parts)
    trees = [build_shards(sample, mask, levels, seed) for seed, mask in enumerate(parts)]

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        shard, rows, home = [], [], []
        for k, mask in enumerate(parts):
            for leaf, own, is_home in _route(fp, mask, trees[k], levels, r):
                shard.append(np.full(len(own), (k << MAX_LEVELS) + leaf, np.int32))
                rows.append(own)
                home.append(is_home)
        rows = np.concatenate(rows)
        out = batch.take(pa.array(rows))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(shard)), out.column("fp"), out.column("rep"), pa.array(np.concatenate(home))], ["shard", "fp", "rep", "home"])

    rows = map_batches(points.select("fp", "rep"), spread, "shard int, fp long, rep long, home boolean")
    # at most len(parts) << MAX_LEVELS shards, whatever the input
    sizes = rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > tile_rows)
    tiles = sizes.select("shard", F.ceil(F.col("n") / tile_rows).cast("int").alias("cuts"))
    cut = rows.join(F.broadcast(tiles), "shard", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("cuts")).cast("int")
    every = F.sequence(F.lit(0), F.col("cuts") - 1)
    # tile (i, j) compares home part i with visitor part j; a row is needed in row i and column j
    as_home = cut.where("home").select("shard", F.col("fp"), "rep", F.lit(True).alias("home"), own.alias("i"), F.explode(every).alias("j"))
    as_guest = cut.select("shard", "fp", "rep", F.lit(False).alias("home"), F.explode(every).alias("i"), own.alias("j")).where(~F.col("rep").isNull())
    dealt = as_home.unionByName(as_guest)

    def link(key: tuple, group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().view(np.uint64)
        rep, home = group.column("rep").to_numpy(), group.column("home").to_numpy()
        edges = link_shard(fp, home, parts[key[0].as_py() >> MAX_LEVELS], radius, r)
        a, b = rep[edges[:, 0]], rep[edges[:, 1]]
        keep = a != b
        return pa.table({"a": a[keep], "b": b[keep]})

    return dealt.groupBy("shard", "i", "j").applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the
    smallest key that can be reached over links, itself included. Null, empty and
    wordless texts have fingerprint zero and link like any other. Rows with a null
    key link among the rest but never give their key to a component. Rows that repeat
    a key stay, each with its own fingerprint. Columns besides key and text are
    ignored. An empty table gives an empty result.
    """
    prints = materialise(fingerprints(docs, shingle, text, key))
    counts = materialise(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep")))
    found = components(links(counts.where("rep is not null"), radius))
    named = counts.join(found.withColumnRenamed("vertex", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    hot = hot_keys(counts, "fp", "n", prints.count())
    joined = join_on_skewed_key(prints, named, hot, "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies by similarity -----------------------------------------------------

#: Words of 64 bits of a wide fingerprint. One 64-bit word tells a Jaccard similarity of
#: 0.8 apart from 0.6 too badly, and pairs of 0.8 differ in about ten of its bits.
WIDE = 4
#: Bits of the wide fingerprint that candidates may differ in. One spanning forest is kept for
#: each limit, so that an edge that verification drops is not the only trace of closer pairs.
LIMITS = (24, 32, 38, 44, 52)
#: Partners in a leaf up to which a row's pairs are all verified at once; rows with more have their forests' edges
#: verified first, and after that their pairs with other components.
FEW = 32
#: Shingles of one part of a group that is not settled: two parts meet in a task.
PART_SHINGLES = 1 << 19
#: As SHARD_ROWS. Each level of shards sends about 1.4 times the rows, so shards are as large as a task
#: bears: this many rows of 41 bytes.
WIDE_SHARD_ROWS = 262_144
#: Bits of one word that candidates may differ in: far over what pairs of 0.8 do.
WORD_LIMIT = 20
_WORDS = [f"w{k}" for k in range(WIDE)]
#: Shingle sets smaller than this get all their links by prefixes besides; their wide fingerprints are too coarse.
SHORT = 30


def wide_fingerprints(docs: DataFrame, shingle: int, text: str, key: str, longest: int = 0) -> DataFrame:
    """(doc_id, w0 .. w3, short): SimHash over the distinct shingles, once for each of WIDE hash functions.

    ``short`` is the set of shingle hashes of a text with 1 to ``longest`` of them, else null.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        last: dict[bytes, tuple] = {}
        out = []
        for t in batch.column(1).to_pylist():
            own = xxhash.xxh3_128_digest(t or "")
            if own not in last:
                h = np.unique(shingle_hashes(t, shingle))
                last[own] = [majority(remix(h, k)) for k in range(WIDE)], h.view(np.int64) if 0 < len(h) <= longest else None
            out.append(last[own])
        words = np.array([w for w, _ in out], np.int64).reshape(-1, WIDE)
        short = pa.array([h for _, h in out], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(words[:, k]) for k in range(WIDE)), short], ["doc_id", *_WORDS, "short"])

    return map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text)), run, "doc_id long, " + ", ".join(f"{w} long" for w in _WORDS) + ", short array<long>")


def short_links(points: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b), a < b, that connect all pairs of ``points`` (rep, short) with a Jaccard similarity of ``similarity``.

    Such a pair shares one of the first n - ceil(similarity * n) + 1 hashes of each of its sets, in any one order:
    here the rarer first, so that few sets meet. Where they meet, a search over exact similarities gives a spanning forest.
    """
    # at most 1,000 times the size of a set, whatever the input
    seen = points.select(F.explode("short").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= max(50, points.count() // 1000)).collect()
    often = {r.h: r.n for r in seen}

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = batch.column("short").to_pylist()
        first = [sorted(x, key=lambda h: (often.get(h, 0), h))[: len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1] for x in sets]
        out = batch.take(pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in first])))
        return pa.RecordBatch.from_arrays([pa.array([h for x in first for h in x], pa.int64()), out.column("rep"), out.column("short")], ["h", "rep", "short"])

    def link(key: tuple, group: pa.Table) -> pa.Table:
        rep, sets = group.column("rep").to_numpy(), group.column("short").to_pylist()
        size = np.array([len(x) for x in sets])
        row = np.repeat(np.arange(len(sets)), size)
        code = np.unique(np.concatenate([np.array(x, np.int64) for x in sets]), return_inverse=True)[1]
        starts = np.concatenate(([0], np.cumsum(size)))
        left, a, b = np.ones(len(sets), bool), [], []
        for start in range(len(sets)):
            todo = [start] if left[start] else []
            left[start] = False
            while todo:
                at = todo.pop()
                own = np.zeros(code.max() + 1, bool)
                own[code[starts[at] : starts[at + 1]]] = True
                shared = np.bincount(row[own[code]], minlength=len(sets))
                near = np.flatnonzero(left & (shared >= similarity * (size[at] + size - shared) - 1e-9))
                left[near] = False
                todo += near.tolist()
                a += [rep[at]] * len(near)
                b += rep[near].tolist()
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    dealt = map_batches(points.select("rep", "short"), deal, "h long, rep long, short array<long>")
    return dealt.groupBy("h").applyInArrow(link, "a long, b long").where("a < b").distinct()


def link_wide(words: np.ndarray, home: np.ndarray, tree: int, mask: int, limits: tuple[int, ...] = LIMITS, seed: int = 7) -> np.ndarray:
    """Edges (k x 2) of one spanning forest for each limit, over the pairs (home, any) that the tree reaches.

    Pairs of rows with FEW partners at most are edges besides, so that small groups are verified whole.
    A row with a pair that is in neither gets the edge (row, row) as a mark.

    The tree is over the bits ``mask`` of word ``tree``, in which a pair may differ in one bit.
    """
    fp, m = words[:, tree], np.uint64(mask)
    direct: list[np.ndarray] = []
    forests, rng = [Forest(len(fp)) for _ in limits], np.random.default_rng(seed)
    stack = [(np.flatnonzero(home), np.arange(len(fp)), 0)]
    while stack:
        data, asked, failed = stack.pop()
        if not len(data) or not len(asked):
            continue
        if len(data) <= LEAF or failed >= 3:
            step = max(1, (1 << 21) // len(asked))
            for lo in range(0, len(data), step):
                part = data[lo : lo + step]
                i, j = np.nonzero(np.bitwise_count(fp[part][:, None] ^ fp[asked][None, :]) <= WORD_LIMIT)
                a, b = part[i], asked[j]
                d = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int16)
                for limit, forest in zip(limits, forests, strict=True):
                    near = (d <= limit) & (a != b)
                    if near.any():
                        forest.join(a[near], b[near])
                a, b = a[near], b[near]
                few = (np.bincount(a, minlength=1)[a] <= FEW) & (np.bincount(b, minlength=1)[b] <= FEW)
                marked = np.unique(np.concatenate([a[~few], b[~few]]))
                direct += [np.stack([a[few], b[few]], 1), np.stack([marked, marked], 1)]
            continue
        v = fp[data[rng.integers(len(data))]] ^ rng.integers(0, 1 << 63, dtype=np.uint64)
        d = _distance(fp[data], v, m)
        mu = int(np.median(d))
        near = d <= mu
        if near.all():
            mu -= 1
            near = d <= mu
        if not near.any() or near.all():
            stack.append((data, asked, failed + 1))
            continue
        e = _distance(fp[asked], v, m)
        lopsided = failed + 1 if min(near.sum(), (~near).sum()) < len(data) // 16 else 0
        stack.append((data[near], asked[e <= mu + 1], lopsided))
        stack.append((data[~near], asked[e >= mu], lopsided))
    return np.concatenate([np.array([e for f in forests for e in f.edges], np.int64).reshape(-1, 2), *direct])


def wide_links(points: DataFrame, shard_rows: int = WIDE_SHARD_ROWS, tile_rows: int = 4 * WIDE_SHARD_ROWS) -> DataFrame:
    """Distinct candidate edges (a, b), a < b, between reps of ``points`` (w0 .. w3 distinct, rep).

    Rows (a, a) mark the reps that have candidates besides.
    """
    n, carried = points.count(), ["rep"]
    levels = min(MAX_LEVELS, max(0, int(np.ceil(np.log2(max(1, n / shard_rows))))))
    seen = points.orderBy(F.xxhash64(*_WORDS)).limit(SAMPLE).select(*_WORDS).collect() if levels else []
    sample = np.array(seen, np.int64).reshape(-1, WIDE).view(np.uint64)
    trees = [(k, mask, build_shards(sample[:, k], mask, levels, 16 * k + i)) for k in range(WIDE) for i, mask in enumerate(masks(7))]

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        shard, rows, home = [], [], []
        for number, (k, mask, nodes) in enumerate(trees):
            for leaf, own, is_home in _route(batch.column(_WORDS[k]).to_numpy().view(np.uint64), mask, nodes, levels, 1):
                shard.append(np.full(len(own), (number << MAX_LEVELS) + leaf, np.int32))
                rows.append(own)
                home.append(is_home)
        out = batch.take(pa.array(np.concatenate(rows)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(shard)), *(out.column(w) for w in (*_WORDS, *carried)), pa.array(np.concatenate(home))], ["shard", *_WORDS, *carried, "home"])

    rows = map_batches(points.select(*_WORDS, *carried), spread, "shard int, " + ", ".join(f"{w} long" for w in (*_WORDS, *carried)) + ", home boolean")
    # at most len(trees) << MAX_LEVELS shards, whatever the input
    sizes = rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > tile_rows)
    tiles = sizes.select("shard", F.ceil(F.col("n") / tile_rows).cast("int").alias("cuts"))
    cut = rows.join(F.broadcast(tiles), "shard", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    own = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("cuts")).cast("int")
    every = F.sequence(F.lit(0), F.col("cuts") - 1)
    # in an uncut shard the home rows are visitors too, so each row goes there once
    whole = cut.where("cuts = 1").select("shard", *_WORDS, *carried, "home", F.lit(0).alias("i"), F.lit(0).alias("j"))
    as_home = cut.where("cuts > 1 and home").select("shard", *_WORDS, *carried, F.lit(True).alias("home"), own.alias("i"), F.explode(every).alias("j"))
    as_guest = cut.where("cuts > 1").select("shard", *_WORDS, *carried, F.lit(False).alias("home"), F.explode(every).alias("i"), own.alias("j"))
    dealt = whole.unionByName(as_home).unionByName(as_guest)

    def link(key: tuple, group: pa.Table) -> pa.Table:
        words = np.stack([group.column(w).to_numpy() for w in _WORDS], 1).view(np.uint64)
        rep, home = group.column("rep").to_numpy(), group.column("home").to_numpy()
        k, mask, _ = trees[key[0].as_py() >> MAX_LEVELS]
        edges = link_wide(words, home, k, mask)
        a, b = rep[edges[:, 0]], rep[edges[:, 1]]
        keep = (a != b) | (edges[:, 0] == edges[:, 1])
        trim()
        return pa.table({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]})

    return dealt.groupBy("shard", "i", "j").applyInArrow(link, "a long, b long").distinct()


def shingle_sets(docs: DataFrame, used: DataFrame, shingle: int, text: str, key: str) -> DataFrame:
    """(doc_id, shingles): the distinct shingle hashes of the rows that ``used`` (doc_id) names."""

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in batch.column(1).to_pylist()]
        offsets = np.concatenate(([0], np.cumsum([len(g) for g in got]))).astype(np.int32)
        flat = np.concatenate(got) if got else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))], ["doc_id", "shingles"])

    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("__text")).join(used.hint("merge"), "doc_id", "left_semi")
    return materialise(map_batches(own, sets, "doc_id long, shingles array<long>"))


def verified(edges: DataFrame, docs: DataFrame, similarity: float, shingle: int, text: str, key: str) -> DataFrame:
    """The edges whose texts have a Jaccard similarity of shingle sets of ``similarity`` or more.

    Texts at the hub of many edges, on either side, are sent out in a copy for each 1/1024 of the edges.
    """
    have = shingle_sets(docs, edges.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), shingle, text, key)
    total = edges.count()
    share = max(2, total // 1024)
    both = edges
    for side, other, name in (("b", "a", "__y"), ("a", "b", "__x")):
        hubs = edges.groupBy(side).agg(F.count("*").alias("n")).where(F.col("n") >= share).select(side, F.ceil(F.col("n") / share).cast("int").alias("copies"))
        hubs = F.broadcast(materialise(hubs))  # at most 1,024 rows
        copies = F.coalesce("copies", F.lit(1))
        salted = both.join(hubs, side, "left").withColumn("salt", F.pmod(F.xxhash64(other), copies).cast("int")).drop("copies")
        dealt = have.withColumnRenamed("doc_id", side).join(hubs, side, "left").select(side, F.col("shingles").alias(name), F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"))
        both = salted.join(dealt, [side, "salt"]).drop("salt")
    shared = F.size(F.array_intersect("__x", "__y"))
    rows = both.select("a", "b", shared.alias("s"), (F.size("__x") + F.size("__y")).alias("n"))
    return rows.where(F.col("s") >= similarity * (F.col("n") - F.col("s")) - 1e-9).select("a", "b").distinct()


def unsettled(marked: DataFrame, found: DataFrame) -> DataFrame:
    """The marked points (rep, of, label) of groups of candidates that are not one component yet.

    ``marked`` names the group of each marked point (rep, of), ``label`` is the component in ``found``. A candidate
    pair lies within one group, so all others are settled.
    """
    named = marked.join(found.withColumnRenamed("vertex", "rep"), "rep", "left")
    named = materialise(named.select("rep", "of", F.coalesce("component", "rep").alias("label")))
    sizes = materialise(named.groupBy("of").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")))
    mixed = sizes.where("low < high").select("of")
    return join_on_skewed_key(named, mixed, hot_keys(sizes, "of", "n", named.count()), "of").select("rep", "of", "label")


def link_sets(sets: list[np.ndarray], label: np.ndarray, home: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Edges that join labels: pairs (home row, any row) of different labels with a Jaccard similarity of ``similarity``.

    The shared shingles of a home row and all others are counted over an inverted index. An edge whose labels
    earlier edges have joined stays out, so there are fewer edges than labels.
    """
    size = np.array([len(x) for x in sets], np.int64)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    begin = np.concatenate(([0], np.cumsum(size)))
    by_code = np.argsort(code, kind="stable")
    post = np.repeat(np.arange(len(sets)), size)[by_code]
    at = np.searchsorted(code[by_code], np.arange(code.max() + 2 if len(code) else 1))
    now, edges = np.unique(label, return_inverse=True)[1], []
    for r in np.flatnonzero(home).tolist():
        own = code[begin[r] : begin[r + 1]]
        count = at[own + 1] - at[own]
        ends = np.cumsum(count)
        places = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(at[own], count)
        shared = np.bincount(post[places], minlength=len(sets))
        near = np.flatnonzero((shared >= similarity * (size[r] + size - shared) - 1e-9) & (now != now[r]))
        for g in near.tolist():
            if now[g] != now[r]:
                edges.append((r, g))
                now[now == now[g]] = now[r]
    return edges


def settle(left: DataFrame, docs: DataFrame, similarity: float, shingle: int, text: str, key: str, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """Links (a, b), a < b, that connect what all links between the labels of a group of ``left`` (rep, of, label) connect.

    Every pair of rows of a group meets in a task; a group with many shingles is cut into parts, and two parts meet in a tile.
    A tile sends fewer edges than it has labels.
    """
    sets = shingle_sets(docs, left.select(F.col("rep").alias("doc_id")), shingle, text, key)
    rows = materialise(left.join(sets.withColumnRenamed("doc_id", "rep"), "rep"))
    cuts = rows.groupBy("of").agg(F.ceil(F.sum(F.size("shingles")) / part_shingles).cast("int").alias("cuts")).where("cuts > 1")
    # a row for each part_shingles of shingles, at most
    cut = rows.join(F.broadcast(materialise(cuts)), "of", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("cuts")).cast("int"))
    carried = ["of", "rep", "label", "shingles"]
    as_home = cut.select(*carried, F.lit(True).alias("home"), F.col("own").alias("i"), F.explode(F.sequence("own", F.col("cuts") - 1)).alias("j"))
    as_guest = cut.where("own > 0").select(*carried, F.lit(False).alias("home"), F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("i"), F.col("own").alias("j"))

    def link(_: tuple, group: pa.Table) -> pa.Table:
        rep, home = group.column("rep").to_numpy(), group.column("home").to_numpy()
        sets = group.column("shingles").combine_chunks()
        flat, offsets = sets.values.to_numpy(), sets.offsets.to_numpy()
        edges = np.array(link_sets([flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)], group.column("label").to_numpy(), home, similarity), np.int64).reshape(-1, 2)
        a, b = rep[edges[:, 0]], rep[edges[:, 1]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return as_home.unionByName(as_guest).groupBy("of", "i", "j").applyInArrow(link, "a long, b long").distinct()


def near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, component_id) of every row: groups of texts whose sets of word shingles are similar.

    Candidates come from vantage-point trees over wide fingerprints; each edge is then
    verified by the exact Jaccard similarity. ``component_id`` is the smallest key that can be reached over
    verified edges. Pairs with a set of under SHORT shingles are all found, by prefixes.
    Of the others, a pair of just 0.8 is a candidate with a probability of about 0.99 by simulation; the closer, the surer.
    Every candidate pair is verified, or its two texts are connected by verified edges already: rows with many candidates
    have their forests' edges verified first, and where a group is not one component then, all its pairs meet in tiles.
    Null, empty and wordless texts form one group; texts of one shingle set are one group. Rows
    with a null key take the component of their text (null if no other row has the text). Rows that
    repeat a key should repeat the text too; they stay. Other columns are ignored. An empty table gives an empty
    result.
    """
    longest = int((SHORT - 1) / similarity + 1e-9)  # partners of the largest short set
    prints = materialise(wide_fingerprints(docs, shingle, text, key, longest))
    counts = materialise(prints.groupBy(*_WORDS).agg(F.count("*").alias("n"), F.min("doc_id").alias("rep"), F.min("short").alias("short")))
    prints, points = prints.drop("short"), counts.where("rep is not null").select(*_WORDS, "rep")
    short = short_links(counts.where("rep is not null and short is not null").select("rep", "short"), similarity)
    candidates = materialise(wide_links(points))
    edges = candidates.where("a < b")
    sure = materialise(verified(edges, docs, similarity, shingle, text, key).unionByName(short).distinct())
    found = materialise(components(sure))
    groups = components(candidates).select(F.col("vertex").alias("rep"), F.col("component").alias("of"))
    marked = materialise(candidates.where("a = b").select(F.col("a").alias("rep")).join(groups, "rep"))
    left = materialise(unsettled(marked, found))
    if not left.isEmpty():
        found = materialise(components(sure.unionByName(settle(left, docs, similarity, shingle, text, key))))
    named = counts.join(found.withColumnRenamed("vertex", "rep"), "rep", "left").select(*_WORDS, F.coalesce("component", "rep").alias("component_id"))
    hot = hot_keys(counts, _WORDS, "n", prints.count())
    return join_on_skewed_key(prints, named, hot, _WORDS).select("doc_id", "component_id")
