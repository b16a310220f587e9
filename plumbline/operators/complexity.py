"""Cognitive complexity of functions, graded in tiers with caps, and a project's typical values."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.operators.functions import _masked

# Words that nest, each costs 1 and the depth it stands at.
NESTING = {
    "javascript": ("if", "for", "while", "do", "catch", "switch"),
    "python": ("if", "for", "while", "except"),
    "go": ("if", "for", "switch", "select"),
    "rust": ("if", "for", "while", "loop", "match"),
}
NESTING["typescript"] = NESTING["javascript"]
# Tiers as (severity, over, cap, confidence), the first that fits; limits of the typical values.
TIERS = [("error", 15, 30, 0.9), ("warning", 10, 30, 0.75), ("info", 6, 20, 0.5)]
ROLLED_UP, SYSTEMIC_P90, SYSTEMIC_MEDIAN = 0.2, 10, 6

_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|=>|&&|\|\||\?\.|\?\?|\n|[^\s\w]")
_OPERATOR = frozenset("+-*/%=<>!&|^~?:,.([{") | {"=>", "&&", "||"}


def _braced(text: str, language: str) -> int:
    """One pass over tokens of a language with braces.

    ``level`` is the depth of controls. A control's head and body stand one deeper; what follows ``else`` stands as deep as its ``if``, in Go
    one deeper. Each open bracket keeps the level to return to; a body without braces is kept in ``bare`` of the bracket it stands in and
    ends with its statement.
    """
    go, rust, nesting = language == "go", language == "rust", frozenset(NESTING[language])
    score = level = 0
    frames: list[dict] = [{"kind": "", "level": 0, "bare": []}]
    head: dict | None = None  # a control whose body has not begun
    ended: list[int] = []  # levels of ifs that have just ended, the innermost first
    last, doing = "", False
    tokens = [m[0] for m in _TOKEN.finditer(text)]

    def finish() -> None:
        """A statement ends: so do all bodies without braces around it."""
        nonlocal level
        bare = frames[-1]["bare"]
        while bare:
            kind, at = bare.pop()
            level = at
            if kind == "if":
                ended.append(at)

    for n, t in enumerate(tokens):
        if t == "\n":
            follows = next((x for x in tokens[n + 1 : n + 200] if x != "\n"), "")
            if frames[-1]["bare"] and head is None and last and last not in _OPERATOR and last not in ("else", "do", ")") and follows[:1] not in (".", "?", "+", "-", "*", "&", "|", ")", ",", "{"):
                finish()
            continue
        if head is not None and head["at"] == len(frames) - 1 and (t == "{" or (not go and not rust and head["closed"] and t not in "([")):
            kind, begin = head["kind"], head["level"]
            head = None
            level = begin + (0 if kind == "else" else 1)
            if t == "{":
                frames.append({"kind": kind, "level": begin, "bare": []})
                last, ended = t, []
                continue
            frames[-1]["bare"].append((kind, begin))
        if t == "else" and (ended or last == "}"):
            at = ended[0] if ended else level
            ended = ended[1:]
            if not go:
                score += 1
            level = at + 1 if go else at
            after = next((x for x in tokens[n + 1 : n + 200] if x != "\n"), "")
            if after == "if":
                frames[-1]["bare"].append(("else", at))  # the if's end is the end of both
            else:
                head = {"kind": "else", "level": level, "at": len(frames) - 1, "closed": True, "back": at}
        elif t == "if" and frames[-1]["kind"] == "match" and not frames[-1].get("arm"):
            pass  # the guard of an arm
        elif t in nesting and last != "." and not (t == "while" and doing):
            if t != "for" or not rust or last not in (">",):
                score += 1 + level
                head = {"kind": t, "level": level, "at": len(frames) - 1, "closed": t in ("do",)}
                level += 1
            ended = []
        elif t == "while" and doing:
            doing = False
        elif t in "([{" and t:
            frames.append({"kind": "", "level": level, "bare": []})
        elif t in ")]}" and t:
            if len(frames) > 1:
                finish()
                f = frames.pop()
                level = f["level"]
                if t == "}":
                    ended = []
                    if f["kind"] == "if":
                        ended = [f["level"]]
                    doing = f["kind"] == "do"
                    if f["kind"] and frames[-1]["bare"]:
                        follows = next((x for x in tokens[n + 1 : n + 200] if x != "\n"), "")
                        if follows != "else" or f["kind"] != "if":
                            kept = ended
                            finish()
                            ended = kept + ended if follows == "else" else ended
                if head is not None and head["at"] == len(frames) - 1 and t == ")":
                    head["closed"] = True
                    level = head["level"] + 1
        elif t == ";":
            if head is None or head["at"] != len(frames) - 1:
                ended = []
                finish()
        elif t in ("&&", "||"):
            if not (rust and t == "||" and (last in _OPERATOR or last in ("", "move", "return"))):
                score += 1
        elif t == "case" and not rust and last != ".":
            score += 1
        elif t == "default" and go and last != ".":
            score += 1
        elif t == "=>" and rust and frames[-1]["kind"] == "match":
            score += 1
            frames[-1]["arm"] = True
        elif t == "?" and not go and not rust:
            after = next((x for x in tokens[n + 1 : n + 200] if x != "\n"), "")
            if after not in (":", ")", ",", ".", "?", "="):
                score += 1
        if t in (",", "}"):
            frames[-1]["arm"] = False
        if t not in (";", "}") and t != "else":
            ended = [] if t not in ")" else ended
        last = t
    return score


_WORD = re.compile(r"[A-Za-z_]\w*|[()\[\]{}:]|\n")


def _indented(text: str) -> int:
    """Python: blocks by indentation; what an elif or else holds stands as deep as its if. Lists, dicts and sets by comprehension nest."""
    made, opened = [], []  # for each bracket: does a comprehension stand directly in it
    for w in _WORD.findall(text):
        if w in "([{":
            opened.append(len(made))
            made.append(False)
        elif w in ")]}" and opened:
            opened.pop()
        elif w == "for" and opened:
            made[opened[-1]] = True
    score = number = 0
    blocks: list[tuple[int, int]] = []  # (indentation of the head, depth of what it holds)
    brackets: list[int] = []  # depth that each open bracket adds
    depth_of: dict[int, int] = {}  # depth of the last head at an indentation
    inside = 0
    for line in text.split("\n"):
        if not line.strip():
            continue
        words = _WORD.findall(line)
        if not brackets:
            indent = len(line.expandtabs(8)) - len(line.expandtabs(8).lstrip())
            while blocks and blocks[-1][0] >= indent:
                blocks.pop()
            inside = blocks[-1][1] if blocks else 0
            at = 1 if words[:1] == ["async"] else 0
            first = words[at] if len(words) > at else ""
            if first in ("if", "for", "while", "except"):
                score += 1 + inside
                depth_of[indent] = inside
                inside += 1
            elif first in ("elif", "else"):
                inside = depth_of.get(indent, inside)
                score += first == "elif"
            if first in ("if", "for", "while", "except", "elif", "else"):
                blocks.append((indent, inside))
                words = words[at + 1 :]
        for w in words:
            if w in "([{":
                nests = w != "(" and made[number]
                score += 1 + inside + sum(brackets) if nests else 0
                brackets.append(int(nests))
                number += 1
            elif w in ")]}":
                if brackets:
                    brackets.pop()
            elif w in ("and", "or", "else"):  # else: x if c else y
                score += 1
    return score


def score_of(body: str, language: str) -> int | None:
    if language not in NESTING:
        return None
    # no digit tells one score from another: short bodies that are alike but for their numbers are looked at once
    alike = _NUMBER.sub("0", body)
    return (_alike_score if len(alike) <= ALIKE_CHARS else _score)(alike, language)


def _score(body: str, language: str) -> int:
    text = _masked(body, language)
    return _indented(text) if language == "python" else _braced(text, language)


#: Characters of a body that is kept with its score.
ALIKE_CHARS = 2000
_NUMBER = re.compile("[0-9]+")
_alike_score = lru_cache(8192)(_score)


@F.pandas_udf(T.IntegerType())
def cognitive(body: pd.Series, language: pd.Series) -> pd.Series:
    """The score of a body: 1 for each break in its flow, and for nesting ones the depth besides."""
    return pd.Series([None if b is None else score_of(b, lang) for b, lang in zip(body, language, strict=True)], dtype="Int32")


def graded(rows: DataFrame, score: str = "complexity") -> DataFrame:
    """``rows`` with ``severity`` and ``confidence`` of the first tier that their score is over; others go."""
    over = lambda i: F.coalesce(*(F.when(F.col(score) > limit, F.lit(t[i])) for t in TIERS for limit in (t[1],)))
    return rows.withColumn("severity", over(0)).withColumn("confidence", over(3)).where("severity is not null")


def report(rows: DataFrame, key: Column | None = None, score: str = "complexity") -> DataFrame:
    """severity, rank, name, path, line, complexity, confidence, rolled_up, lowest: the worst of each tier up to its cap, and one row for the rest.

    ``rows`` has path, name, start_line and the score; ties go by path and line. The rest of a tier is counted in ``rolled_up`` with its
    lowest score and a confidence less by .2, .3 at least.
    """
    tier = graded(rows, score)
    order = Window.partitionBy("severity").orderBy(F.desc(score), "path", "start_line", "name")
    cap = F.coalesce(*(F.when(F.col("severity") == s, F.lit(c)) for s, _, c, _ in TIERS))
    top = tier.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(c for _, _, c, _ in TIERS)).where(F.col("rank") <= cap)
    # the rest are counted, not sorted: all of the tier less those that are shown
    counted = tier.groupBy("severity", "confidence", F.col(score).alias("s")).agg(F.count("*").alias("n"))
    shown = top.groupBy("severity", F.col(score).alias("s")).agg(F.count("*").alias("m"))
    left = counted.join(shown, ["severity", "s"], "left").withColumn("n", F.col("n") - F.coalesce("m", F.lit(0))).where("n > 0")
    rest = left.groupBy("severity", "confidence").agg(F.sum("n").alias("rolled_up"), F.max("s").alias(score), F.min("s").alias("lowest"))
    rest = rest.select("severity", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line"), score, F.round(F.greatest(F.lit(0.3), F.col("confidence") - ROLLED_UP), 2).alias("confidence"), "rolled_up", "lowest")
    top = top.select("severity", "rank", "name", "path", F.col("start_line").alias("line"), score, "confidence", F.lit(None).cast("long").alias("rolled_up"), F.lit(None).cast("int").alias("lowest"))
    return top.unionByName(rest)


def typical(rows: DataFrame, keys: list[str], score: str = "complexity") -> DataFrame:
    """keys, functions, median, p90, max, severity: values at the places n div 2 and floor(.9 n) - 1 of the sorted scores.

    Scores are counted first, so a project is never sorted: each of its scores is one row. ``severity`` is warning where the ninetieth percentile is over 10, else info where the
    median is over 6, else null.
    """
    counted = rows.groupBy(*keys, F.col(score).alias("s")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("s")
    placed = counted.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("s")))
    total = F.col("total")
    out = placed.groupBy(*keys).agg(F.first("total").alias("functions"), at(F.floor(total / 2)).alias("median"), at(F.greatest(F.lit(0), F.floor(total * 9 / 10) - 1)).alias("p90"), F.max("s").alias("max"))
    return out.withColumn("severity", F.when(F.col("p90") > SYSTEMIC_P90, "warning").when(F.col("median") > SYSTEMIC_MEDIAN, "info"))
