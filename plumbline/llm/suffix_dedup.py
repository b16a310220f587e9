"""Removal of repeated byte strings by longest-previous-factor arrays.

A suffix array of a whole corpus fits no machine, so the text is first cut by
content. Every window of ``length`` bytes has one anchor: the smallest hash of its
``K``-byte strings, leftmost first. Equal windows have equal anchors at equal offsets, so
consecutive windows with one anchor form a *run*, and a window can be repeated only
among runs with the same anchor hash. Runs whose anchor occurs once leave at once.
Rows with one text collapse (map-side) into one, and equal runs into one class, so a
hot group of copies costs one class. Only anchors with several classes need bytes: their classes are
concatenated, a suffix array is built (ranks of doubling prefixes), and previous and next
smaller positions in suffix order give the longest earlier match of each window
start, previous and next larger ones the longest later match.

Anchors with more than ``GROUP_BYTES`` of distinct classes are not put into one task:
their windows meet by a 128-bit digest instead, in an ordinary aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import HOT_SHARE, hot_keys, join_on_skewed_key, materialise, trim

#: Bytes of an anchor string.
K = 100
#: Bytes that are hashed at once; positions in a chunk take POS_BITS bits.
CHUNK = 1 << 18
POS_BITS = 19
#: Bytes of classes that one suffix array holds.
ARRAY_BYTES = 1 << 20
#: Positions whose common prefixes are measured at once.
BLOCK = 1 << 16
#: Bytes of distinct classes of one anchor beyond which windows meet by digest.
GROUP_BYTES = 4 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        inverse = pow(int(_BASE), -1, 1 << 64)
        for base in (int(_BASE), inverse):
            table = np.full((1 << POS_BITS) + 1, base, np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers[0], _powers[1]


def _mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return v ^ (v >> np.uint64(29))


def window_runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int, k: int = K) -> tuple[np.ndarray, ...]:
    """(text number, first start in ``data``, number of starts, anchor hash) of all runs.

    ``data`` holds texts ``[begins, ends)`` of together fewer than 2**POS_BITS bytes.
    """
    up, down = _power_tables()
    n, width = len(data), length - k + 1
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    if n < length:
        return none
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    grams = _mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
    low = np.uint64((1 << POS_BITS) - 1)
    keyed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    # sliding minimum over ``width`` positions: block-wise suffix and prefix minima
    blocks = -(-len(keyed) // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1), np.uint64)
    padded[: len(keyed)] = keyed
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - length + 1], ahead[width - 1 : width + n - length])
    anchor = (least & low).astype(np.int64)
    count = np.maximum(ends - begins - length + 1, 0)
    valid = np.zeros(n - length + 2, np.int8)
    some = count > 0
    np.add.at(valid, begins[some], 1)
    np.add.at(valid, begins[some] + count[some], -1)
    ok = np.cumsum(valid[:-1]) > 0
    first = ok.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~ok[:-1]
    first[begins[some]] = True
    start = np.flatnonzero(first)
    if not len(start):
        return none
    doc = np.searchsorted(begins, start, side="right") - 1
    stop = np.minimum(np.append(start[1:], n), begins[doc] + count[doc])
    return doc, start, stop - start, grams[anchor[start]]


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[list[int], list[int], list[int]]]:
    """(texts, begins, ends) of chunks of at most CHUNK bytes; longer texts are cut, with overlap."""
    rows, begins, ends, size = [], [], [], 0
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        while b - a >= length:
            e = min(b, a + CHUNK)
            if size + e - a > CHUNK and rows:
                yield rows, begins, ends
                rows, begins, ends, size = [], [], [], 0
            rows.append(i)
            begins.append(a)
            ends.append(e)
            size += e - a
            if e == b:
                break
            a = e - length + 1
    if rows:
        yield rows, begins, ends


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows (nulls: empty)."""
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def _runs(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            data, offsets = _bytes_of(batch.column("text"))
            for rows, begins, ends in _pieces(offsets, length):
                part = np.concatenate([data[a:b] for a, b in zip(begins, ends, strict=True)])
                size = np.array(ends) - np.array(begins)
                at = np.cumsum(size) - size
                doc, start, n, anchor = window_runs(part, at, at + size, length)
                raw = part.tobytes()
                h = np.fromiter((digest(raw[a : a + c]) for a, c in zip(start.tolist(), (n + length - 1).tolist(), strict=True)), np.uint64, len(start))
                row = np.array(rows)[doc]
                begin = start - at[doc] + np.array(begins)[doc] - offsets[row]
                own = batch.select(["did", "t1", "t2"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int32)), own.column("did"), own.column("t1"), own.column("t2"), pa.array(begin.astype(np.int64))],
                    ["h", "s", "n", "did", "t1", "t2", "start"],
                )
        trim()

    return docs.mapInArrow(run, "h long, s long, n int, did long, t1 long, t2 long, start long")


# --- suffix arrays --------------------------------------------------------------


def _dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    rises = np.zeros(len(keys), np.bool_)
    in_order = keys[order]
    np.not_equal(in_order[1:], in_order[:-1], out=rises[1:])
    del in_order
    rank = np.empty(len(keys), np.int32)
    rank[order] = np.cumsum(rises, dtype=np.int32)
    return rank


def prefix_ranks(data: np.ndarray, length: int) -> dict[int, np.ndarray]:
    """Ranks of the prefixes of 8, 16, 32, ... bytes of every suffix (zeros behind the end)."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for i in range(8):
        word <<= np.uint64(8)
        word |= padded[i : i + n]
    ranks, size = {8: _dense(word)}, 8
    del word
    while 2 * size <= length:
        now = ranks[size]
        both = now.astype(np.int64) << 32
        both[: max(0, n - size)] |= now[size:]
        ranks[2 * size] = _dense(both)
        size *= 2
    return ranks


def _nearest(pos: np.ndarray, step: int) -> np.ndarray:
    """Index of the nearest entry before (step -1) or behind (1) with a smaller value; -1 if none."""
    n = len(pos)
    if step > 0:
        found = _nearest(pos[::-1], -1)[::-1]
        return np.where(found < 0, -1, n - 1 - found)
    near = np.arange(-1, n - 1, dtype=np.int32)
    todo = np.flatnonzero((near >= 0) & (pos[near] > pos))
    while len(todo):
        near[todo] = near[near[todo]]
        c = near[todo]
        todo = todo[(c >= 0) & (pos[c] > pos[todo])]
    return near


def _common(ranks: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, counted up to ``length``; b may be -1 (0)."""
    out = np.zeros(len(a), np.int32)
    ok = np.flatnonzero(b >= 0)
    x, y = a[ok], b[ok]
    top = max(ranks)
    full = (ranks[top][x] == ranks[top][y]) & (ranks[top][x + length - top] == ranks[top][y + length - top])
    out[ok[full]] = length
    part, at = ok[~full], np.zeros(int((~full).sum()), np.int32)
    x, y = x[~full], y[~full]
    for size in sorted(ranks, reverse=True):
        same = ranks[size][x + at] == ranks[size][y + at]
        at = np.minimum(at + size * same, length - 1)
    out[part] = at  # exact to 8 bytes, and below ``length``
    return out


def factors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest next factor at ``starts``, counted up to ``length``.

    Each of ``starts`` has ``length`` bytes behind it. Lengths below ``length`` are
    exact to 8 bytes.
    """
    ranks = prefix_ranks(data, length)
    top = max(ranks)
    order = np.lexsort((starts, ranks[top][starts + length - top], ranks[top][starts])).astype(np.int32)
    pos = starts[order].astype(np.int32)
    out = []
    for sign in (1, -1):
        best = np.zeros(len(pos), np.int32)
        for step in (-1, 1):
            near = _nearest(sign * pos, step)
            for lo in range(0, len(pos), BLOCK):
                part = slice(lo, lo + BLOCK)
                other = np.where(near[part] >= 0, pos[near[part]], -1)
                best[part] = np.maximum(best[part], _common(ranks, pos[part], other, length))
        back = np.empty(len(pos), np.int32)
        back[order] = best
        out.append(back)
    return out[0], out[1]


def _ranges(flags: np.ndarray) -> list[int]:
    """[first, end, first, end, ...] of the runs of true flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).ravel().tolist()


def _matched(segments: DataFrame, length: int) -> DataFrame:
    """Ranges of starts with an earlier match, and with any, of each class of an anchor.

    ``segments`` (h, s, n, did, start, bytes) must have each anchor in one partition,
    sorted by anchor and place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        size = 0

        def solve() -> pa.RecordBatch:
            raw = b"".join(r["bytes"] for r in group)
            counts = np.array([r["n"] for r in group], np.int64)
            at = np.concatenate(([0], np.cumsum([len(r["bytes"]) for r in group])[:-1])).astype(np.int64)
            ends = np.cumsum(counts)
            starts = np.arange(ends[-1], dtype=np.int32) + np.repeat((at - ends + counts).astype(np.int32), counts)
            before, after = factors(np.frombuffer(raw, np.uint8), starts, length)
            old, new = before >= length, (before >= length) | (after >= length)
            cut = list(zip((ends - counts).tolist(), ends.tolist(), strict=True))
            return pa.RecordBatch.from_pydict(
                {"h": [r["h"] for r in group], "s": [r["s"] for r in group], "n": [r["n"] for r in group], "earlier": [_ranges(old[a:b]) for a, b in cut], "either": [_ranges(new[a:b]) for a, b in cut]},
                schema=pa.schema([("h", pa.int64()), ("s", pa.int64()), ("n", pa.int32()), ("earlier", pa.list_(pa.int32())), ("either", pa.list_(pa.int32()))]),
            )

        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for r in batch.to_pylist():
                if group and r["h"] != group[-1]["h"]:
                    seen.clear()
                    if size >= ARRAY_BYTES:
                        yield solve()
                        group, size = [], 0
                if (r["s"], r["n"]) in seen:  # the rows of a document that is there twice
                    continue
                seen.add((r["s"], r["n"]))
                group.append(r)
                size += len(r["bytes"])
        if group:
            yield solve()
        trim()

    return segments.mapInArrow(run, "h long, s long, n int, earlier array<int>, either array<int>")


def _windows(segments: DataFrame, length: int) -> DataFrame:
    """The same ranges by 128-bit digests of all windows, for anchors with very many classes."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                raw, n = part.column("bytes").to_pylist(), part.column("n").to_numpy()
                row = np.repeat(np.arange(len(n)), n)
                off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                d = [xxhash.xxh3_128_digest(raw[i][a : a + length]) for i, a in zip(row.tolist(), off.tolist(), strict=True)]
                two = np.frombuffer(b"".join(d), np.int64).reshape(-1, 2)
                own = part.select(["h", "s", "n", "did", "start"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), *(own.column(c) for c in ("h", "s", "n", "did", "start")), pa.array(off.astype(np.int32))], ["d1", "d2", "h", "s", "n", "did", "start", "off"])

    rows = materialise(segments.mapInArrow(spread, "d1 long, d2 long, h long, s long, n int, did long, start long, off int").dropDuplicates(["h", "s", "n", "off"]))
    place = F.struct("did", F.col("start") + F.col("off"), "s", "off")
    seen = materialise(rows.groupBy("d1", "d2").agg(F.count("*").alias("c"), F.min(place).alias("first")).where("c > 1"))
    hot = hot_keys(seen, ["d1", "d2"], "c", max(1, rows.count()))
    got = join_on_skewed_key(rows, seen, hot, ["d1", "d2"]).groupBy("h", "s", "n").agg(F.sort_array(F.collect_list("off")).alias("either"), F.sort_array(F.collect_list(F.when(F.col("first") != place, F.col("off")))).alias("earlier"))
    pairs = lambda c: F.flatten(F.transform(c, lambda x: F.array(x, (x + 1).cast("int"))))
    return got.select("h", "s", "n", pairs("earlier").alias("earlier"), pairs("either").alias("either"))


# --- the operator ---------------------------------------------------------------


TEXT = ["t1", "t2"]


def repeated_ranges(docs: DataFrame, length: int = 400, keep_first: bool = True) -> tuple[DataFrame, DataFrame]:
    """Ranges that repeated windows cover in each text of ``docs`` (did, t1, t2, text).

    Returns (t1, t2, lead, ranges, others): ``ranges`` hold for the row with key ``lead``,
    ``others`` for further rows with that text; and the keys of texts with very many rows. With
    ``keep_first`` the first place of a window, by key and offset, stays out.
    """
    runs = materialise(_runs(docs.select("did", *TEXT, "text"), length))
    anchors = materialise(runs.groupBy("h").agg(F.count("*").alias("c"), F.min("s").alias("s0"), F.max("s").alias("s1")).where("c > 1").select("h", "c", (F.col("s0") != F.col("s1")).alias("several")))
    total = runs.count()
    keys = ["h", "s", "n"]
    # rows with one text collapse here, before anything else looks at their runs
    again = join_on_skewed_key(runs, anchors.select("h", "several"), hot_keys(anchors, "h", "c", total), "h")
    found = materialise(again.groupBy(*keys, *TEXT, "start").agg(F.count("*").alias("places"), F.min("did").alias("did"), F.first("several").alias("several")))
    here = F.struct("did", *TEXT, "start")
    classes = materialise(found.where(F.lit(keep_first) | F.col("several")).groupBy(*keys).agg(F.sum("places").alias("c"), F.count("*").alias("texts"), F.min(here).alias("first"), F.first("several").alias("several")))
    crowd = classes.where("several").groupBy("h").agg(F.sum(F.col("n") + length).alias("size"))
    wanted = classes.where("several").join(crowd, "h").select(*keys, *(F.col(f"first.{c}").alias(c) for c in ("did", *TEXT, "start")), (F.col("size") > GROUP_BYTES).alias("wide"))
    by_doc = wanted.groupBy("did", *TEXT).agg(F.collect_list(F.struct("h", "s", "n", "start", "wide")).alias("want"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h", pa.int64()), ("s", pa.int64()), ("n", pa.int32()), ("did", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary()), ("wide", pa.bool_())])
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                out = []
                for r in batch.slice(lo, 64).to_pylist():
                    raw = (r["text"] or "").encode()
                    out += [w | {"did": r["did"], "bytes": raw[w["start"] : w["start"] + w["n"] + length - 1]} for w in r["want"]]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    segments = materialise(docs.join(by_doc, ["did", *TEXT]).select("did", "text", "want").mapInArrow(cut, "h long, s long, n int, did long, start long, bytes binary, wide boolean"))
    by_array = _matched(segments.where("not wide").drop("wide").repartition("h").sortWithinPartitions("h", "did", "start"), length)
    ranges = by_array.unionByName(_windows(segments.where("wide").drop("wide"), length)) if segments.where("wide").limit(1).count() else by_array
    none = F.array().cast("array<int>")
    solved = materialise(classes.join(ranges, keys, "left").withColumns({c: F.coalesce(c, none) for c in ("earlier", "either")}))
    every = F.array(F.lit(0), F.col("n"))
    cols = [*TEXT, "did", "start"]
    if keep_first:
        dim = solved.select(*keys, "first", "earlier", "texts")
        joined = join_on_skewed_key(found, dim, hot_keys(dim, keys, "texts", total), keys)
        covered = joined.select(*cols, F.when(here != F.col("first"), every).otherwise(F.col("earlier")).alias("r"), every.alias("o"))
    else:
        # a class with one place is its own row; every place of the others goes
        single = solved.where("c = 1").select(*(F.col(f"first.{c}").alias(c) for c in cols), F.col("either").alias("r"))
        dim = solved.where("c > 1").select(*keys, "texts")
        many = join_on_skewed_key(found.where("several"), dim, hot_keys(dim, keys, "texts", total), keys)
        covered = single.unionByName(many.select(*cols, every.alias("r"))).unionByName(found.where("not several").select(*cols, every.alias("r"))).withColumn("o", F.col("r"))
    by_text = covered.groupBy(*TEXT).agg(F.min("did").alias("lead"), F.collect_list(F.struct("start", "r")).alias("ranges"), F.collect_list(F.struct("start", F.col("o").alias("r"))).alias("others"))
    # texts whose rows are many: at least a share of all runs for each of their windows
    hot = found.groupBy(*TEXT).agg(F.max("places").alias("rows")).orderBy(F.desc("rows"), *TEXT).limit(int(1 / HOT_SHARE)).where("rows > 16").select(*TEXT)
    return by_text, materialise(hot)


def _spans(ranges: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal byte spans that the windows at the given starts cover."""
    out: list[tuple[int, int]] = []
    spans = sorted((g["start"] + g["r"][i], g["start"] + g["r"][i + 1] - 1 + length) for g in ranges or () for i in range(0, len(g["r"]), 2))
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _inner_chars(raw: bytes, a: int, b: int) -> tuple[int, int]:
    """The span shrunk to whole characters."""
    while a < b and a < len(raw) and raw[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def dedup_substrings(docs: DataFrame, length: int = 400, keep_first: bool = True, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Remove repeated strings of ``length`` bytes or more from every row's text.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of
    [begin, end) byte pairs), kept (the text without the spans shrunk to whole
    characters) and the columns named in ``keep``. With ``keep_first`` the first place of each repeated string, by key and
    offset, stays; otherwise every place goes. Matches never cross texts. Null texts
    count as empty, texts below ``length`` bytes never lose anything, texts of any length
    are taken whole. Rows that repeat key and text are alike: with ``keep_first`` all of them keep
    what the first keeps. Null keys sort first. An empty table gives an empty
    result; other columns are ignored.
    """
    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("did"), F.xxhash64(text).alias("t1"), (F.shiftleft(F.crc32(F.coalesce(F.col(text), F.lit(""))), 31).bitwiseXOR(F.coalesce(F.octet_length(text), F.lit(-1)).cast("long"))).alias("t2"), F.col(text).alias("text"), F.struct(F.lit(0).alias("_"), *keep).alias("kept_with"))
    ranges, hot = repeated_ranges(named, length, keep_first)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]  # then kept_with, as it came
        schema = pa.schema(list(zip(names, [pa.int64()] * 4 + [pa.string(), pa.list_(pa.list_(pa.int64())), pa.string()], strict=True)))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = []
                part = batch.slice(lo, 256)
                for r in part.select(["doc_id", "text", "ranges"]).to_pylist():
                    raw, spans = (r["text"] or "").encode(), _spans(r["ranges"], length)
                    kept, shown, at, shown_at = [], [], 0, 0
                    for a, b in spans:
                        kept.append(raw[at:a])
                        at = b
                        a, b = _inner_chars(raw, a, b)
                        shown.append(raw[shown_at:a])
                        shown_at = b
                    kept, shown = b"".join([*kept, raw[at:]]), b"".join([*shown, raw[shown_at:]])
                    out.append((r["doc_id"], len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [list(s) for s in spans], shown.decode()))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)), part.column("kept_with")], [*names, "kept_with"])
        trim()

    joined = join_on_skewed_key(named, ranges, hot, TEXT, "left").select("doc_id", "text", F.when(F.col("did") == F.col("lead"), F.col("ranges")).otherwise(F.col("others")).alias("ranges"), "kept_with")
    made = joined.mapInArrow(finish, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>, kept string, kept_with {joined.schema['kept_with'].dataType.simpleString()}")
    return made.select("*", *(F.col("kept_with")[c].alias(c) for c in keep)).drop("kept_with")
