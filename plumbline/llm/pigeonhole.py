"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters with error budget e is cut into e + 1 pieces: within e edits
at least one piece stays whole. One Aho-Corasick automaton finds all pieces in a text;
each hit gives the place where the item would stand, and Myers' bit-parallel
algorithm takes the least edit distance around it. Items of a few words have no budget: they
are found where they stand verbatim, as whole words.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_batches, materialise

#: Edits for each character of an item.
RATE = 0.05
#: Items of fewer words are searched verbatim, as whole words.
EXACT_WORDS = 5
#: Characters of items in one automaton; more items are taken in several blocks.
BLOCK_CHARS = 8_000_000
#: Columns that the operator adds.
RESULT = ("contaminated", "item_ids", "distances", "ends")
_SPACE = re.compile(r"\s+")


def normalise(text: str | None) -> str:
    """Lower case, white space as single blanks."""
    return _SPACE.sub(" ", (text or "").lower()).strip()


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of ``pattern`` to a substring of ``text``, its first end)."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full  # a match may begin anywhere
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, exact_words: int = EXACT_WORDS) -> None:
        import ahocorasick

        self.items: dict[str, list[int]] = {}
        for item, text in items:
            if norm := normalise(text):
                self.items.setdefault(norm, []).append(item)
        self.texts = list(self.items)
        self.exact = [len(t.split()) < exact_words for t in self.texts]
        self.budget = [0 if exact else int(len(t) * rate) for t, exact in zip(self.texts, self.exact, strict=True)]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, (t, e) in enumerate(zip(self.texts, self.budget, strict=True)):
            cuts = [len(t) * k // (e + 1) for k in range(e + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(t[a:b], []).append((i, a))
        self.machine = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.machine.add_word(piece, (len(piece), places))
        self.machine.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, edit distance, end in the normalised text) of the best place of each leaked item."""
        if not self.texts or not text:
            return []
        norm = normalise(text)
        best: dict[int, tuple[int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for last, (size, places) in self.machine.iter(norm):
            for i, offset in places:
                if i in best and best[i][0] == 0:
                    continue
                t, e = self.texts[i], self.budget[i]
                at = last + 1 - size - offset
                if self.exact[i] and (norm[at - 1 : at].isalnum() or norm[at + len(t) : at + len(t) + 1].isalnum()):
                    continue
                if at >= 0 and norm.startswith(t, at):
                    best[i] = (0, at + len(t))
                    continue
                # one window of 2e starts serves all hits of a diagonal band
                band = (i, at // (e + 1))
                if band in tried or e == 0:
                    continue
                tried.add(band)
                lo = max(0, band[1] * (e + 1) - e)
                d, end = myers(t, norm[lo : band[1] * (e + 1) + 2 * e + 1 + len(t)])
                if d <= e and (i not in best or d < best[i][0]):
                    best[i] = (d, lo + end)
        return sorted((item, d, end) for i, (d, end) in best.items() for item in self.items[self.texts[i]])


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, exact_words: int = EXACT_WORDS, block_chars: int = BLOCK_CHARS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Which benchmark items stand in each row's text, within ``rate`` edits for each character.

    Returns doc_id, the other columns of ``docs``, then contaminated, item_ids (sorted), distances and ends (in the
    normalised text) of the items; columns of ``docs`` with one of these four names are replaced. Of equal distances
    the place found first counts. Items under ``exact_words`` words are found verbatim only, as whole
    words. Null and empty texts hold no item; null and blank items are never found; items with equal
    texts are all reported. Repeated rows stay. An empty table gives an empty result, an empty
    benchmark clean rows. Items travel with the tasks in blocks of about ``block_chars``
    characters, each a pass over the texts that writes the hits alone.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item")).where("item_id is not null and item is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("item")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    kind = pa.list_(pa.struct([("item", pa.int64()), ("distance", pa.int32()), ("end", pa.int64())]))
    hits = "array<struct<item:long,distance:int,end:long>>"
    rest = [c for c in docs.columns if c != key and c not in RESULT]
    own = docs.select(F.col(key).alias("doc_id"), F.struct(F.lit(0).alias("_"), *rest).alias("rest"), F.col(text).alias("t"))

    def matcher(block: int) -> Callable[[list[str | None]], pa.Array]:
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == block)
        part = sorted((r["item_id"], r["item"]) for r in mine.collect())  # a block: about block_chars characters
        holder: list[Matcher] = []

        def find(texts: list[str | None]) -> pa.Array:
            if not holder:
                holder.append(Matcher(part, rate, exact_words))
            return pa.array([[{"item": i, "distance": d, "end": e} for i, d, e in holder[0].find(t)] for t in texts], kind)

        return find

    if blocks == 1:
        find = matcher(0)
        out = map_batches(own, lambda b: pa.RecordBatch.from_arrays([b.column(0), b.column(1), find(b.column(2).to_pylist())], ["doc_id", "rest", "found"]), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, rest {own.schema['rest'].dataType.simpleString()}, found {hits}")
    else:
        # what a text holds depends on the text alone, so hits go by its digest
        digest = {"h1": F.xxhash64("t"), "h2": F.xxhash64("t", F.octet_length("t"))}
        texts = own.select("t").withColumns(digest)
        found = None
        for block in range(blocks):

            def run(b: pa.RecordBatch, find: Callable = matcher(block)) -> pa.RecordBatch:
                got = find(b.column(0).to_pylist())
                some = pc.greater(pc.list_value_length(got), 0)
                return pa.RecordBatch.from_arrays([b.column(1).filter(some), b.column(2).filter(some), got.filter(some)], ["h1", "h2", "found"])

            part = materialise(map_batches(texts, run, f"h1 long, h2 long, found {hits}").dropDuplicates(["h1", "h2"]))
            found = part if found is None else found.unionByName(part)
        each = found.groupBy("h1", "h2").agg(F.flatten(F.collect_list("found")).alias("found"))  # once a block
        out = own.withColumns(digest).join(each, ["h1", "h2"], "left").select("doc_id", "rest", F.coalesce("found", F.array().cast(hits)).alias("found"))
    order = F.array_sort("found")
    return out.select(F.col("doc_id").alias(key), *(F.col("rest")[c].alias(c) for c in rest), (F.size("found") > 0).alias("contaminated"), order["item"].alias("item_ids"), order["distance"].alias("distances"), order["end"].alias("ends"))
