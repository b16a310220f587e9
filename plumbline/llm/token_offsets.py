"""Token counts of fields and sections by offset-mapped attribution.

A whole document is encoded once. A byte-level token covers as many bytes as its
vocabulary entry has, so running sums give token spans; these are mapped to character
offsets and meet the sections' intervals in a sorted interval join. A token that
crosses a boundary goes to one section by an explicit rule:

* ``start``: the section that holds its first character;
* ``majority``: the section that holds most of its characters, the first at a tie.

So the counts of a document's sections always add up to its tokens.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("start", "majority")
#: The public split pattern of byte-level BPE vocabularies of 50,257 ids.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the split pattern has it, in runs that are too long for its look-ahead.
LONG_RUN = 10_000
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


class Tokens:
    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pattern = pattern
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)

    def _ids(self, text: str) -> list[int]:
        """Ids of a whole text. A long run of white space is one piece of the split pattern but for its last character where more follows.

        The pattern would walk back over such a run one call deeper for each character; cutting it out by this rule gives the same pieces.
        """
        ids, at = [], 0
        for run in _RUN.finditer(text) if self.pattern == PATTERN else ():
            end = run.end() - (run.end() < len(text))
            ids += self.encoding.encode_ordinary(text[at : run.start()])
            ids += self.encoding._encode_single_piece(text[run.start() : end].encode())
            at = end
        return ids + self.encoding.encode_ordinary(text[at:])

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Character spans [first, end) of the tokens: every character that a token has a byte of."""
        ids = self._ids(text)
        width = self.width[np.array(ids, np.int64)] if ids else np.empty(0, np.int64)
        ends = np.cumsum(width)
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) == len(text):
            return ends - width, ends
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character of each byte
        return char[ends - width], char[ends - 1] + 1


def attribute(first: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of the sections that start at ``bounds`` (ascending, from 0).

    A crossing token counts as crossing in the section that it goes to.
    """
    a = np.searchsorted(bounds, first, side="right") - 1
    b = np.searchsorted(bounds, end - 1, side="right") - 1
    to, cross = a.copy(), a != b
    if rule == "majority":
        for t in np.flatnonzero(cross):
            cuts = np.concatenate(([first[t]], bounds[a[t] + 1 : b[t] + 1], [end[t]]))
            to[t] = a[t] + int(np.diff(cuts).argmax())
    return np.bincount(to, minlength=len(bounds)), np.bincount(to[cross], minlength=len(bounds))


def count(docs: DataFrame, vocabulary: str, fields: tuple[str, ...] = ("text",), key: str = "doc_id", rule: str = "start", pattern: str = PATTERN) -> DataFrame:
    """Tokens of every section of every row.

    A document is its fields, joined by a newline; a section is a line of a field, its newline
    included. Returns doc_id, field, section (from 0 in each field), char_start, char_end
    (in the joined document), n_tokens, n_crossing, doc_tokens. A null field counts as
    empty; an empty field is one empty section. Each row has at least one section for each field.
    Texts are encoded whole, however long, runs of a million blanks among them (with the pattern of this module); repeated rows give repeated sections; an empty table gives an empty
    result; other columns are ignored. ``vocabulary`` is a .tiktoken file that stands
    at this path on every machine.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    names = ["doc_id", "field", "section", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens"]
    kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 5]

    def run(batches):
        tokens = Tokens(vocabulary, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out: list[list] = [[] for _ in names]
                for doc, *values in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    values = [v or "" for v in values]
                    whole, bounds, own, number, at = "\n".join(values), [], [], [], 0
                    for name, v in zip(fields, values, strict=True):
                        start, k = at, 0
                        while True:
                            bounds.append(start)
                            own.append(name)
                            number.append(k)
                            start, k = whole.find("\n", start, at + len(v)) + 1, k + 1
                            if not start:
                                break
                        at += len(v) + 1
                    begin = np.array(bounds, np.int64)
                    first, end = tokens.spans(whole)
                    n, cross = attribute(first, end, begin, rule)
                    m = len(bounds)
                    for col, v in zip(out, ([doc] * m, own, number, bounds, [*bounds[1:], len(whole)], n.tolist(), cross.tolist(), [len(first)] * m), strict=True):
                        col += v
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    schema = "doc_id long, field string, section int, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long"
    return docs.select(F.col(key).cast("long").alias("doc_id"), *fields).mapInArrow(run, schema)
