"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch of texts becomes flat numpy arrays: one symbol id for each character, the
rank of the pair that starts at each symbol, and the start of each segment. A round
takes the smallest pair rank of every segment (``np.minimum.reduceat``), merges all
of its leftmost non-overlapping places at once, compacts the arrays, and looks up
only the pairs beside a merge again. Segments leave the arrays when no pair remains.

Segments are cut where no piece can span: between characters whose bigram stands in
no piece. Merging every place of the smallest rank in one round equals the
library's one-at-a-time order where the merged piece is no part of a piece that ranks
before it, as no pair that the merge makes can then come first. The few pieces for
which that fails (found when the model is loaded) merge one place a round.

Each distinct unit (a run of spaces with the word behind it) is encoded once and
kept in a bounded table.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import trim

SPACE = "▁"
NONE = np.int32(2**31 - 1)
_UNITS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Bytes of kept units for each Python worker, about, after which the table starts anew.
KEPT_BYTES = 64 << 20
#: Texts, and characters of texts, that are spread into units at once.
PART_TEXTS, PART_CHARS = 256, 1 << 20
#: Characters of new units that are merged at once.
CHUNK_CHARS = 1_000_000


class Pairs:
    """Pair of ids -> (rank, id), an open-addressing table of numpy arrays."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, ids: np.ndarray) -> None:
        bits = max(10, int(len(keys) * 8 - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, NONE, np.int32)
        self.id = np.full(1 << bits, -1, np.int32)
        self.probes, left, at = 0, np.arange(len(keys)), self._slot(keys)
        while len(left):
            self.probes += 1
            free = self.key[at] < 0
            first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)[1]
            first = first[free[first]]
            self.key[at[first]], self.rank[at[first]], self.id[at[first]] = keys[left[first]], ranks[left[first]], ids[left[first]]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NONE where there is no piece) and ids of the joined pairs."""
        keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
        at = self._slot(keys)
        got = self.key[at]
        rank, ids = np.where(got == keys, self.rank[at], NONE), self.id[at]
        todo = np.flatnonzero((got != keys) & (got >= 0))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            at = (at + 1) & self.mask if len(at) == len(todo) else (at[todo] + 1) & self.mask
            got, want = self.key[at], keys[todo]
            hit = got == want
            rank[todo[hit]], ids[todo[hit]] = self.rank[at[hit]], self.id[at[hit]]
            more = ~hit & (got >= 0)
            todo, at = todo[more], at[more]
        return rank, ids


class PieceModel:
    """The pieces of a SentencePiece BPE model file with byte fallback.

    Supports what the public 32k model uses: identity normalisation, a dummy prefix,
    escaped spaces, byte fallback. Other settings raise ValueError.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or trainer.treat_whitespace_as_suffix or trainer.model_type != 2:
            raise ValueError("only BPE models with identity normalisation and a dummy prefix are supported")
        self.piece = [p.piece for p in proto.pieces]
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(p.type in (4, 5) for p in proto.pieces) or any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("user-defined, unused or multi-word pieces are not supported")
        self.byte_id = np.zeros(256, np.int64)
        self.bytes_of: dict[int, int] = {}
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.bytes_of[i] = int(p.piece[3:5], 16)
        self.control = {i for i, p in enumerate(proto.pieces) if p.type == 3}
        self.end_id = next(i for i, p in enumerate(proto.pieces) if p.piece == "</s>")
        # rank: by falling score; parts of a piece may be characters without a piece of their own
        order = sorted(normal.values(), key=lambda i: (-proto.pieces[i].score, i))
        rank = {self.piece[i]: r for r, i in enumerate(order)}
        chars = sorted({c for p in normal for c in p})
        extra = {c: len(self.piece) + k for k, c in enumerate(c for c in chars if c not in normal)}
        self.unknown = len(self.piece) + len(extra)
        known = normal | extra
        self.char_id = np.full(0x110000, self.unknown, np.int32)
        for c in chars:
            self.char_id[ord(c)] = known[c]
        self.first_extra = len(self.piece)
        self.extra_char = {i: c for c, i in extra.items()}
        found, bigrams = [], set()
        self.all_places = np.ones(len(order), bool)  # by rank
        for p, i in normal.items():
            bigrams.update((known[p[k]], known[p[k + 1]]) for k in range(len(p) - 1))
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if (a in normal or a in extra) and (b in normal or b in extra):
                    found.append((known[a], known[b], rank[p], i))
                    for x in (a, b):
                        if len(x) > 1 and rank[x] > rank[p]:
                            self.all_places[rank[x]] = False
        t = np.array(found, np.int64)
        self.pairs = Pairs((t[:, 0] << 32) | t[:, 1], t[:, 2].astype(np.int32), t[:, 3].astype(np.int32))
        s = np.array(sorted(bigrams), np.int64)
        self.spans = Pairs((s[:, 0] << 32) | s[:, 1], np.zeros(len(s), np.int32), np.zeros(len(s), np.int32))

    def merge(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after another, and the number of ids of each."""
        cp = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        lens = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(lens)
        unit_of = np.repeat(np.arange(len(units)), lens)
        sym = self.char_id[cp]
        pos = np.arange(len(sym))  # the first character, which orders the output
        out_pos, out_sym = [], []
        # a segment starts with a unit, and where no piece spans the two characters
        head = np.zeros(len(sym) + 1, bool)
        head[np.concatenate(([0], ends[:-1]))] = True
        head = head[:-1]
        if len(sym) > 1:
            head[1:] |= self.spans.find(sym[:-1], sym[1:])[0] == NONE
        rank, new = self._ranks(sym, head)
        while len(sym):
            starts = np.flatnonzero(head)
            low = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(sym)))
            live = low != NONE
            if not live.all():
                keep = np.repeat(live, size)
                out_pos.append(pos[~keep])
                out_sym.append(sym[~keep])
                sym, pos, head, rank, new = sym[keep], pos[keep], head[keep], rank[keep], new[keep]
                low, size = low[live], size[live]
                if not len(sym):
                    break
            place = np.flatnonzero(rank == np.repeat(low, size))
            # of places side by side the first, third, ... merge; a pair never leaves its segment
            run = np.ones(len(place), bool)
            run[1:] = np.diff(place) != 1
            first = np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - first) % 2 == 0]
            one = ~self.all_places[rank[place]]
            if one.any():
                seg = np.cumsum(head)[place]
                place = place[~one | np.concatenate(([True], seg[1:] != seg[:-1]))]
            sym[place] = new[place]
            keep = np.ones(len(sym), bool)
            keep[place + 1] = False
            at = place - np.arange(len(place))  # where the merged symbols stand after compaction
            sym, pos, head, rank, new = sym[keep], pos[keep], head[keep], rank[keep], new[keep]
            left = at - 1
            left = left[(left >= 0) & ~head[at]]
            redo = np.concatenate((at, left))
            nxt = np.minimum(redo + 1, len(sym) - 1)
            r, i = self.pairs.find(sym[redo], sym[nxt])
            r[(redo + 1 >= len(sym)) | head[nxt]] = NONE
            rank[redo], new[redo] = r, i
        pos, sym = np.concatenate(out_pos or [np.empty(0, np.int64)]), np.concatenate(out_sym or [np.empty(0, np.int32)])
        order = np.argsort(pos)
        pos, sym = pos[order], sym[order].astype(np.int64)
        unit = unit_of[pos]
        rough = np.flatnonzero(sym >= self.first_extra)  # characters without a piece become their bytes
        if len(rough):
            width = np.where(cp < 0x80, 1, np.where(cp < 0x800, 2, np.where(cp < 0x10000, 3, 4)))
            n = np.ones(len(sym), np.int64)
            n[rough] = width[pos[rough]]
            data = np.frombuffer(cp[pos[rough]].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            at = np.cumsum(n) - n
            ids = np.repeat(sym, n)
            w = n[rough]
            inner = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            ids[np.repeat(at[rough], w) + inner] = self.byte_id[data]
            return ids, np.bincount(np.repeat(unit, n), minlength=len(units))
        return sym, np.bincount(unit, minlength=len(units))

    def _ranks(self, sym: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, new = np.full(len(sym), NONE, np.int32), np.full(len(sym), -1, np.int32)
        if len(sym) > 1:
            rank[:-1], new[:-1] = self.pairs.find(sym[:-1], sym[1:])
            rank[:-1][head[1:]] = NONE
        return rank, new

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, the library's way: bytes join, one leading space goes."""
        out, run, first = [], bytearray(), True
        for i in ids:
            if (b := self.bytes_of.get(i)) is not None:
                run.append(b)
                first = False
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            if i in self.control:
                continue
            p = self.piece[i]
            if first and p.startswith(SPACE):
                p = p[1:]
            first = False
            out.append(p.replace(SPACE, " "))
        out.append(_utf8(run))
        return "".join(out)


def _utf8(run: bytearray) -> str:
    """Bytes as text; each byte that is part of no character is U+FFFD."""
    out, i = [], 0
    while i < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            i += 1
    return "".join(out)


class Encoder:
    """Encodes and decodes whole texts, a batch at a time."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.known: dict[str, tuple[int, str, str]] = {}
        self.kept_bytes = 0
        #: What each id alone decodes to; bytes from 0x80 on depend on their neighbours.
        self.plain = [chr(model.bytes_of[i]) if model.bytes_of.get(i, 0x80) < 0x80 else p.replace(SPACE, " ") for i, p in enumerate(model.piece)]
        self.plain_len = np.array([len(p) for p in self.plain])
        self.number_len = np.array([len(str(i)) + 1 for i in range(len(model.piece))])
        self.rough = np.array([model.bytes_of.get(i, 0) >= 0x80 for i in range(len(model.piece))])

    def units(self, text: str) -> list[str]:
        """The text cut before each run of spaces, without the first space of each."""
        if text and SPACE not in text and "  " not in text and text[0] != " ":
            return text.split(" ")
        return [u[1:] for u in _UNITS.findall(SPACE + text.replace(" ", SPACE))] if text else []

    def learn(self, units: list[str]) -> None:
        model, at, n = self.model, 0, len(units)
        while at < n:
            chunk, chars = [], 0
            while at < n and (not chunk or chars < CHUNK_CHARS):
                chunk.append(SPACE + units[at])
                chars += len(units[at]) + 1
                at += 1
            ids, counts = model.merge(chunk)
            ends = np.cumsum(counts)
            # one string for the chunk, cut by the lengths of its parts
            number = " ".join(map(str, ids.tolist())) + " "
            number_at = np.concatenate(([0], np.cumsum(self.number_len[ids])))[np.concatenate(([0], ends))].tolist()
            text = "".join([self.plain[i] for i in ids.tolist()])
            text_at = np.concatenate(([0], np.cumsum(self.plain_len[ids])))[np.concatenate(([0], ends))].tolist()
            rough = np.zeros(len(chunk), bool)
            rough[np.searchsorted(ends, np.flatnonzero(self.rough[ids]), side="right")] = True
            for u, unit in enumerate(chunk):
                self.known[unit[1:]] = (int(counts[u]), number[number_at[u] : number_at[u + 1]], text[text_at[u] : text_at[u + 1]])
            for u in np.flatnonzero(rough).tolist():
                own, unit = ids[ends[u] - counts[u] : ends[u]].tolist(), chunk[u]
                self.known[unit[1:]] = (len(own), number[number_at[u] : number_at[u + 1]], " " + model.decode(own))

    def batch(self, texts: list[str | None]) -> tuple[list[int], list[str], list[str]]:
        """Token counts (with the end id), the ids in decimal, the decoded texts."""
        docs = [self.units(t or "") for t in texts]
        fresh = list(dict.fromkeys(u for d in docs for u in d if u not in self.known))
        self.learn(fresh)
        known, end = self.known, str(self.model.end_id)
        counts, ids, decoded = [], [], []
        for d in docs:
            n, numbers, words = zip(*map(known.__getitem__, d), strict=True) if d else ((), (), ())
            counts.append(sum(n) + 1)
            ids.append("".join(numbers) + end)
            decoded.append("".join(words)[1:])
        # a unit's strings in two copies, its numbers, and some 330 bytes of objects
        self.kept_bytes += sum(330 + 2 * sys.getsizeof(u) + len(known[u][1]) for u in fresh)
        if self.kept_bytes > KEPT_BYTES:
            known.clear()
            self.kept_bytes = 0
        return counts, ids, decoded


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(PieceModel(path))
    return _encoders[path]


def parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most PART_TEXTS rows and PART_CHARS bytes of text; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    lo, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and (i - lo >= PART_TEXTS or size + n > PART_CHARS):
            yield batch.slice(lo, i - lo)
            lo, size = i, 0
        size += n
    if batch.num_rows > lo:
        yield batch.slice(lo)


def encode(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), full: bool = True) -> DataFrame:
    """Encode and decode column ``text`` of every row.

    Returns the ``keep`` columns with ``n_tokens``, ``ids_sha256``,
    ``decoded_sha256`` and, if ``full``, ``ids`` (decimal, space-joined) and
    ``decoded``. The file ``model`` must be installed at the same path on every
    machine, as a package's file is. Null and empty texts have the end id alone;
    texts of any length are taken whole; repeated rows stay; an empty table gives an
    empty result; other columns of ``docs`` are ignored unless kept.
    """
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema += ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in batches:
            for part in parts(batch, len(keep)):
                counts, ids, decoded = encoder.batch(part.column(len(keep)).to_pylist())
                cols = [*part.columns[: len(keep)], pa.array(counts, pa.int64()), pa.array(map(_sha, ids), pa.string()), pa.array(map(_sha, decoded), pa.string())]
                cols += [pa.array(ids, pa.string()), pa.array(decoded, pa.string())] if full else []
                yield pa.RecordBatch.from_arrays(cols, [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *(("ids", "decoded") if full else ())])
        trim()

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)
