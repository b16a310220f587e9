"""Ranked lexical search by Block-Max WAND over an index that is dealt out by documents.

Each task numbers the documents it reads and turns them into posting lists of fixed-size blocks: document gaps and
term counts packed to as few bits as a block needs, the last document and the highest impact of the block beside
them. A search looks at these figures alone to find stretches of documents whose impacts could add up to more than the tenth best
score so far, and unpacks only the blocks of such stretches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import materialise

#: Postings of a block.
BLOCK = 128
#: A shard ends at so many documents or postings, whichever comes first.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 4_000_000
#: Asked terms are sent to all tasks up to so many bytes; with more of them every term is indexed and joined.
TERM_BYTES = 32 << 20
#: Queries are sent to all tasks in blocks of so many terms.
QUERY_TERMS = 200_000
#: Stretches that are looked at before the threshold is raised again.
STRETCHES = 64

#: Bytes that end a term become blanks, A-Z become a-z; bytes of other letters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """All terms of a whole text in UTF-8, in order, with repeats; none for null."""
    return text.translate(_FOLD).split() if text else []


def pack(values: np.ndarray) -> bytes:
    """Whole numbers in as few bits each as the largest needs; the first byte says how many."""
    bits = int(values.max(initial=0)).bit_length()
    return bytes([bits]) + np.packbits((values[:, None] >> np.arange(bits)) & 1).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    bits = data[0]
    return np.unpackbits(np.frombuffer(data, np.uint8, offset=1), count=n * bits).reshape(n, bits) @ (1 << np.arange(bits, dtype=np.int64))


POSTED = "shard long, term binary, docs binary, tfs binary, ids binary, nulls binary, ns binary, df long"
_FIELDS = ["shard", "term", "docs", "tfs", "ids", "nulls", "ns", "df"]


class _Shard:
    """Documents that one task has read and not yet sent."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.ns: list[int] = []
        self.posted: dict[bytes, tuple[list[int], list[int]]] = {}
        self.n = 0

    def add(self, doc_id: int | None, text: bytes | None, asked: frozenset[bytes] | None) -> None:
        terms = terms_of(text)
        if not terms:
            return  # it counts nowhere
        at = len(self.ids)
        self.ids.append(doc_id)
        self.ns.append(len(terms))
        if asked is not None:
            terms = [t for t in terms if t in asked]
        for term, tf in Counter(terms).items():
            docs, tfs = self.posted.setdefault(term, ([], []))
            docs.append(at)
            tfs.append(tf)
            self.n += 1

    def rows(self, number: int) -> pa.RecordBatch:
        """One row of the documents (null term), one a term; documents are numbered by doc_id, nulls last, so that ties go to the earlier number."""
        nulls = np.array([i is None for i in self.ids])
        ids = np.array([i or 0 for i in self.ids], np.int64)
        order = np.lexsort((ids, nulls))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        ns = np.array(self.ns, np.int64)
        out: list[tuple] = [(number, None, None, None, ids[order].tobytes(), nulls[order].tobytes(), ns[order].tobytes(), len(ids))]
        for term, (docs, tfs) in self.posted.items():
            d = place[docs]
            by = np.argsort(d)
            out.append((number, term, d[by].tobytes(), np.array(tfs, np.int32)[by].tobytes(), None, None, ns[docs][by].astype(np.int32).tobytes(), len(docs)))
        kinds = [pa.int64(), *[pa.binary()] * 6, pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=_FIELDS)


def post(docs: DataFrame, asked: frozenset[bytes] | None) -> DataFrame:
    """Posting lists by shard with each document's number of terms, uncompressed and without impacts, of all terms or of those asked for."""
    terms = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = _Shard(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard.add(doc_id, text.as_py(), terms.value)
                if len(shard.ids) >= SHARD_DOCS or shard.n >= SHARD_POSTINGS:
                    yield shard.rows(number)
                    shard, number = _Shard(), number + 1
        if shard.ids:
            yield shard.rows(number)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, POSTED)


@dataclass
class Index:
    """``lists`` has shard, term, weight, last, peak (int32 and int64 for each block) and packed blocks with their ends; ``docs`` shard, ids, nulls, ms."""

    lists: DataFrame
    docs: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame, asked: frozenset[bytes] | None = None) -> Index:
    """Index of ``docs`` (doc_id, text): one pass over the texts, then one over the posting lists once the whole table's figures are known."""
    posted = materialise(post(docs, asked))
    heads = posted.where("term is null")
    total = heads.select("df", "ns").mapInArrow(_sums, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = (total[0] or 0), (total[1] or 0)

    def lengths(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            ms = [_ms(np.frombuffer(x, np.int64), n_docs, n_terms).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ms, pa.binary())], names=["shard", "ms"])

    ms = heads.select("shard", "ns").mapInArrow(lengths, "shard long, ms binary")
    shards = materialise(heads.select("shard", "ids", "nulls").join(ms, "shard"))
    weight = posted.where("term is not null").groupBy("term").agg(F.sum("df").alias("all")).select("term", F.floor(1000 * F.log((F.lit(2.0 * n_docs + 2)) / (2.0 * F.col("all") + 1))).cast("long").alias("weight"))
    weight = F.broadcast(weight) if asked is not None else weight  # as many as were sent to all tasks before
    lists = posted.where("term is not null").select("shard", "term", "docs", "tfs", "ns").join(weight, "term")
    return Index(materialise(lists.mapInArrow(_sealer(n_docs, n_terms), SEALED)), shards.select("shard", "ids", "nulls", "ms"), n_docs, n_terms)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(np.frombuffer(x, np.int64).sum()) for x in batch.column(1).to_pylist()], pa.int64())], names=["docs", "terms"])


def _ms(ns: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of each document: 10 + (90 * n * N) div L, in whole numbers of 64 bits."""
    if len(ns) and 90 * int(ns.max()) * n_docs >= 2**63:
        return np.array([10 + 90 * int(n) * n_docs // n_terms for n in ns], np.int64)
    return 10 + 90 * ns * n_docs // max(1, n_terms)


def impacts(tfs: np.ndarray, ms: np.ndarray) -> np.ndarray:
    """A term's share of the score without its weight; it rises with tf and falls with m."""
    return 1_000_000_000 * tfs // (1000 * tfs + 8 * ms)


SEALED = "shard long, term binary, weight long, n long, block int, last binary, peak binary, ends binary, blob binary"


def _sealer(n_docs: int, n_terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function by which posting lists become blocks: packed gaps and counts, with last documents and highest impacts beside them."""

    size = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shard, term, docs, tfs, weight, ns in zip(*(batch.column(name).to_pylist() for name in ("shard", "term", "docs", "tfs", "weight", "ns")), strict=True):
                d, tf, n = (np.frombuffer(x, np.int32).astype(np.int64) for x in (docs, tfs, ns))
                impact = impacts(tf, _ms(n, n_docs, n_terms))
                gaps = np.diff(d, prepend=-1) - 1
                starts = np.arange(0, len(d), size)
                blob, ends = bytearray(), []
                for at in starts:
                    a, b = pack(gaps[at : at + size]), pack(tf[at : at + size] - 1)
                    ends += [len(blob) + len(a), len(blob) + len(a) + len(b)]
                    blob += a + b
                last = d[np.minimum(starts + size, len(d)) - 1].astype(np.int32)
                out.append((shard, term, weight, len(d), size, last.tobytes(), np.maximum.reduceat(impact, starts).tobytes(), np.array(ends, np.int32).tobytes(), bytes(blob)))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SEALED.split(", ")])

    return run


class PostingList:
    """Blocks of one term in one shard; unpacked blocks are kept for the next query."""

    def __init__(self, weight: int, n: int, block: int, last: bytes, peak: bytes, ends: bytes, blob: bytes, ms: np.ndarray):
        self.n, self.size, self.ms, self.blob, self.weight = n, block, ms, blob, weight
        self.last = np.frombuffer(last, np.int32).astype(np.int64)
        self.peak = weight * np.frombuffer(peak, np.int64)
        self.ends = np.r_[0, np.frombuffer(ends, np.int32)]
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of a block."""
        if k not in self.open:
            n = min(self.size, self.n - k * self.size)
            a, b, c = self.ends[2 * k : 2 * k + 3]
            docs = np.cumsum(unpack(self.blob[a:b], n) + 1) + (self.last[k - 1] if k else -1)
            self.open[k] = docs, self.weight * impacts(unpack(self.blob[b:c], n) + 1, self.ms[docs])
        return self.open[k]


def best_of_shard(lists: list[PostingList], top: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the ``top`` best documents of a shard above 0, best first, ties by number.

    The ends of all blocks cut the documents into stretches in which every term stays within one block. The sum of
    these blocks' highest impacts bounds a stretch; those at or below the threshold are passed over unopened, since documents come in the order in which
    ties are broken.
    """
    ends = np.unique(np.concatenate([x.last for x in lists]))
    starts = np.r_[0, ends[:-1] + 1]
    bound, at = np.zeros(len(ends), np.int64), []
    for x in lists:
        k = np.searchsorted(x.last, ends)  # a shallow move: no block is unpacked
        at.append(k)
        bound += np.r_[x.peak, 0][k]
    docs, scores, threshold = np.empty(0, np.int64), np.empty(0, np.int64), 0
    for lo in range(0, len(ends), STRETCHES):
        part = np.arange(lo, min(lo + STRETCHES, len(ends)))
        part = part[bound[part] > threshold]
        if not len(part):
            continue
        base, limit = starts[part[0]], ends[part[-1]]
        alive = np.zeros(limit - base + 2, np.int64)
        np.add.at(alive, starts[part] - base, 1)
        np.add.at(alive, ends[part] - base + 1, -1)
        sums = np.zeros(limit - base + 1, np.int64)
        for x, k in zip(lists, at, strict=True):
            for b in np.unique(k[part]):
                if b < len(x.last):
                    d, s = x.block(int(b))
                    i, j = np.searchsorted(d, (base, limit + 1))
                    sums[d[i:j] - base] += s[i:j]
        hits = np.nonzero((np.cumsum(alive)[:-1] > 0) & (sums > threshold))[0]
        if len(hits):
            docs, scores = np.r_[docs, hits + base], np.r_[scores, sums[hits]]
            order = np.lexsort((docs, -scores))[:top]
            docs, scores = docs[order], scores[order]
            if len(docs) == top:
                threshold = int(scores[-1])
    return docs, scores


HITS = "item long, doc_id long, score long"
_LIST = ("shard", "term", "weight", "n", "block", "last", "peak", "ends", "blob")
_HEAD = ("shard", "ids", "nulls", "ms")


def _answer(asked: Broadcast, top: int) -> Callable[[pa.Table], pa.Table]:
    """The function that answers all asked queries over one shard's rows."""

    def run(shard: pa.Table) -> pa.Table:
        rows = shard.to_pylist()
        head = next(r for r in rows if r["term"] is None)
        ids, nulls, ms = np.frombuffer(head["ids"], np.int64), np.frombuffer(head["nulls"], bool), np.frombuffer(head["ms"], np.int64)
        lists = {r["term"]: PostingList(r["weight"], r["n"], r["block"], r["last"], r["peak"], r["ends"], r["blob"], ms) for r in rows if r["term"] is not None and r["weight"] > 0}
        found = []
        for item, terms in asked.value:
            if mine := [lists[t] for t in terms if t in lists]:
                docs, scores = best_of_shard(mine, top)
                found += [(item, None if nulls[d] else int(ids[d]), int(s)) for d, s in zip(docs, scores, strict=True)]
        return pa.table([pa.array(c, pa.int64()) for c in list(zip(*found, strict=True)) or ((), (), ())], names=["item", "doc_id", "score"])

    return run


def search(index: Index, queries: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` best documents of each query: item, rank, doc_id, score. ``queries`` has item (a number) and terms (distinct, binary).

    Each shard answers all queries of a block from its own lists and sends ``top`` rows a query at most; queries come in
    blocks of at most QUERY_TERMS terms (or one query), so what is broadcast is bounded.
    """
    spark = queries.sparkSession
    size = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks, out = -(-size // QUERY_TERMS), None
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(max(1, blocks))))
    for number in range(blocks):
        rows = numbered.where(F.col("block") == number).select("item", "terms").collect()
        if not rows:
            continue
        asked = spark.sparkContext.broadcast([(r["item"], [bytes(t) for t in r["terms"]]) for r in rows])

        wanted = index.lists
        if size <= QUERY_TERMS:  # terms of all queries at once: lists that no query asks for are not read further
            terms = queries.select(F.explode("terms").alias("term")).distinct()
            wanted = wanted.join(F.broadcast(terms), "term", "left_semi")
        shards = index.docs.select(*_HEAD).unionByName(wanted.select(*_LIST), allowMissingColumns=True)
        part = shards.groupBy("shard").applyInArrow(_answer(asked, top), HITS)
        part = materialise(part) if blocks > 1 else part
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], HITS)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", rank).where(F.col("rank") <= top).select("item", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` documents of each item (item_id, text) by the contract's score: item_id, rank, doc_id, score.

    Terms are runs of ASCII letters and digits and of all other letters and signs beyond ASCII in the whole text, with A-Z
    lower-cased. Documents without a term, null and empty texts among them, count nowhere. Documents that repeat are ranked
    each; ties go to the smaller doc_id, null ones last. An item that repeats is answered for each row; an item without a term, or whose
    terms no document holds, gives no rows, as do empty tables. Other columns are left behind.

    Posting lists are made for the terms of the items, as no other term changes a score; where these are too many to be sent
    to all tasks, every term is indexed.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(terms_of(x))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(terms, pa.list_(pa.binary()))], names=["item_id", "item", "terms"])

    numbered = items.select("item_id", F.col("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("item"))
    queries = materialise(numbered.mapInArrow(run, f"item_id {dict(items.dtypes)['item_id']}, item long, terms array<binary>"))
    terms = queries.select(F.explode("terms").alias("term")).distinct()
    size = terms.agg(F.sum(F.length("term") + 64)).first()[0] or 0
    asked = frozenset(bytes(r["term"]) for r in terms.collect()) if size <= TERM_BYTES else None
    found = search(build(docs, asked), queries.select("item", "terms"), top)
    return found.join(queries.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
