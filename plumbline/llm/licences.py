"""License scans by template-markup matching.

A template is mandatory wording with regions: ``[...]`` may be missing, ``{n}``
stands for up to n words of any kind, ``(a|b)`` for one of several wordings. It
compiles into an automaton over words; a text is accepted where the automaton runs
through, so all mandatory words match exactly. Base phrases are templates without regions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_batches

# The phrases and labels of the base rule.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Notices that name a license, label first.
NOTICES = [
    ("mit", "(released|licensed|distributed|available) under the [terms of the] mit license"),
    ("apache-2", "licensed under the apache license version 2 [0] [the license]"),
    ("bsd", "(released|licensed|distributed) under the [terms of the] [{2}] bsd [(2|3|4) clause] license"),
    ("gpl-2", "(released|licensed|distributed) under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 2"),
    ("gpl-3", "(released|licensed|distributed) under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 3"),
    ("gpl-3", "this (program|work|software|library) is free software [{8}] you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3"),
    ("lgpl", "(released|licensed|distributed) under the [terms of the] gnu lesser general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license [v] [version] 2 0"),
    ("cc-by-nc", "licensed under [a] (cc|creative commons) (by nc|attribution noncommercial|attribution non commercial) [(nd|sa)] [(2|3|4) (0|5)] [international] [license]"),
    ("cc-by-sa", "licensed under [a] (cc|creative commons) (by sa|attribution sharealike|attribution share alike) [(2|3|4) (0|5)] [international] [license]"),
    ("cc-by", "licensed under [a] (cc by|creative commons attribution) (2|3|4) (0|5) [international] [license]"),
    ("cc0", "(released|licensed|dedicated) (under|to) [the] (cc0|public domain) [1 0] [universal] [license]"),
]
# The whole wording of short licenses; names and numbering are replaceable or optional.
TEXTS = [
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and (noninfringement|non infringement) "
        "in no event shall {8} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "[1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "[2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "[[3] neither the name of {12} nor the names of [its] contributors may be used to endorse or promote products derived from this software without specific prior written permission] "
        "this software is provided by {8} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall {8} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
        "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and {6} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall {6} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will {4} be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "[1] the origin of this software must not be misrepresented you must not claim that you wrote the original software "
        "if you use this software in a product an (acknowledgment|acknowledgement) in the product documentation would be appreciated but is not required "
        "[2] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [3] this notice may not be removed or altered from any source distribution",
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {7} "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
]
TEMPLATES = NOTICES + TEXTS
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))
_SYNTAX = re.compile(r"\[|\]|\(|\)|\||\{\d+\}|[^\s\[\](){}|]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of letters A-Z (lower-cased), digits and non-ASCII characters, as UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


class Automaton:
    """A template as states with word edges, free edges and edges for any word."""

    def __init__(self, template: str) -> None:
        self.word: list[dict[bytes, int]] = []
        self.free: list[list[int]] = []
        self.any: list[int | None] = []
        tokens = _SYNTAX.findall(template)
        first = self._state()
        self.end, rest = self._sequence(tokens, first)
        if rest:
            raise ValueError(f"unbalanced template: {template}")
        self.closed = [self._closure({s}) for s in range(len(self.word))]
        self.first = self.closed[first]
        self.starts = {w for s in self.first for w in self.word[s]}
        if any(self.any[s] is not None for s in self.first) or self.end in self.first:
            raise ValueError(f"a template has to start with a mandatory word: {template}")
        depth = re.sub(r"\[[^\[\]]*\]", " ", re.sub(r"\[[^\[\]]*\]", " ", template))
        self.mandatory = [w.encode() for w in re.sub(r"\([^()]*\)|\{\d+\}", " ", depth).split()]
        # how many mandatory words lie behind each state, for partial scores
        self.done = self._progress(first)

    def _state(self) -> int:
        self.word.append({})
        self.free.append([])
        self.any.append(None)
        return len(self.word) - 1

    def _sequence(self, tokens: list[str], at: int) -> tuple[int, list[str]]:
        while tokens and tokens[0] not in "])|":
            t, tokens = tokens[0], tokens[1:]
            if t == "[":
                to, tokens = self._sequence(tokens, at)
                self.free[at].append(to)
                at, tokens = to, tokens[1:]
            elif t == "(":
                end = self._state()
                while True:
                    begin = self._state()
                    self.free[at].append(begin)
                    to, tokens = self._sequence(tokens, begin)
                    self.free[to].append(end)
                    stop, tokens = tokens[0], tokens[1:]
                    if stop == ")":
                        break
                at = end
            elif t[0] == "{":
                end = self._state()
                for _ in range(int(t[1:-1])):
                    self.free[at].append(end)
                    self.any[at] = nxt = self._state()
                    at = nxt
                self.free[at].append(end)
                at = end
            else:
                to = self._state()
                self.word[at][t.encode()] = to
                at = to
        return at, tokens

    def _closure(self, states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def _progress(self, first: int) -> list[int]:
        done, todo = [0] * len(self.word), [(first, 0)]
        seen = set()
        while todo:
            s, n = todo.pop()
            if (s, n) in seen:
                continue
            seen.add((s, n))
            done[s] = max(done[s], n)
            todo += [(t, n) for t in self.free[s]] + [(t, n + 1) for t in self.word[s].values()]
            if self.any[s] is not None:
                todo.append((self.any[s], n))
        return done

    def match(self, words: list[bytes], at: int) -> tuple[int | None, float]:
        """(end of the longest match from ``at``, share of the wording that was reached)."""
        states, best, reach = self.first, None, 0  # of several ends the last, so optional regions are taken where they fit
        while at < len(words) and states:
            w = words[at]
            nxt = {t for s in states if (t := self.word[s].get(w)) is not None} | {self.any[s] for s in states if self.any[s] is not None}
            states = frozenset().union(*(self.closed[s] for s in nxt)) if nxt else frozenset()
            at += 1
            if states:
                reach = max(reach, *(self.done[s] for s in states))
                if self.end in states:
                    best = at
        return best, 1.0 if best is not None else reach / max(1, self.done[self.end])


class Scanner:
    def __init__(self, base: dict[str, str] = BASE, templates: list[tuple[str, str]] = TEMPLATES) -> None:
        self.base = [(Automaton(p), label) for p, label in base.items()]
        self.templates = [(Automaton(t), label) for label, t in templates]
        self.starts: dict[bytes, list[tuple[Automaton, str, bool]]] = {}
        for kind, group in ((True, self.base), (False, self.templates)):
            for a, label in group:
                for w in a.starts:
                    self.starts.setdefault(w, []).append((a, label, kind))

    def scan(self, text: str | None) -> dict:
        folded = (text or "").encode().translate(_FOLD)
        words = folded.split()
        out = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base": set(), "labels": set(), "score": 0.0, "spans": []}
        # a text that lacks a mandatory word of a template cannot match it
        live = {id(a) for a, _ in (*self.base, *self.templates) if all(w in folded for w in a.mandatory)}
        if not live:
            return out
        begins = {w for w, group in self.starts.items() if w in folded and any(id(a) in live for a, _, _ in group)}
        for i in [i for i, w in enumerate(words) if w in begins]:
            for a, label, is_base in self.starts[words[i]]:
                if id(a) not in live:
                    continue
                end, score = a.match(words, i)
                out["score"] = max(out["score"], score if not is_base or end is not None else 0.0)
                if end is None:
                    continue
                out["labels"].add(label)
                if is_base:
                    out["n_base"] += 1
                    out["base"].add(label)
                    out["first_word"] = i if out["first_word"] is None else out["first_word"]
                    out["last_word"] = i
                else:
                    out["spans"].append((label, i, end))
        return out


def scan(docs: DataFrame, base: dict[str, str] = BASE, templates: list[tuple[str, str]] = TEMPLATES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """License labels of every row.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and
    spans (label, first word, end word of each template match). ``score`` is 1 where
    wording matches in full, else the largest share of a template's mandatory words that
    a text, having all of them, shows in order from a start. Of the matches from one word the longest counts; templates that
    overlap are all reported. Null and empty texts have no words,
    no labels and score 0. Rows that repeat are scanned alike; texts are taken whole; an
    empty table gives an empty result; other columns are ignored.
    """
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    holder: list[Scanner] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not holder:
            holder.append(Scanner(base, templates))
        got = [holder[0].scan(t) for t in batch.column(1).to_pylist()]
        span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
        cols = [batch.column(0), *(pa.array([g[c] for g in got], pa.int64()) for c in names[1:5]), *(pa.array([",".join(sorted(g[c])) for g in got], pa.string()) for c in ("base", "labels")), pa.array([g["score"] for g in got], pa.float64())]
        cols.append(pa.array([[{"label": a, "first": b, "end": c} for a, b, c in g["spans"]] for g in got], span))
        return pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,end:long>>"
    return map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), run, schema)
