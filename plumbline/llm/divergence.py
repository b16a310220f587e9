"""Quality rules by distribution divergence, in DataFrame functions alone.

One pass over the texts counts, in each row, the base figures, a character-class
histogram and a histogram over common words. The language references are the
histograms of all rows of each language, summed, and drawn to those of all rows by the
weight of PRIOR_ROWS rows, so that a language of a few rows is no reference of its own. A row is
compared with every reference by the Jensen-Shannon distance (base 2, so 0 to 1) of both
histograms; the language nearest by their sum counts for both. Short texts are not judged by
a histogram: their distances are noise.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialise

# Frequent function words of each language.
COMMON_WORDS = {
    "de": "der die das und in von zu mit den ist auf für nicht ein eine dem des sich als auch an es".split(),
    "en": "the of and to in is that for it with as was on be at by this are or an not from have".split(),
    "es": "de la que el en y los se del las un por con no una su para es al lo como más".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par sur au pas ne il elle".split(),
}
CLASSES = ("lower", "space", "upper", "digit", "symbol", "punct", "other")
BLANK = r"[\x20\x09-\x0D]+"
#: Average rows of the whole table that each language's reference holds besides its own.
PRIOR_ROWS = 0.5
REFERENCE = "array<struct<lang:string,chars:array<double>,words:map<string,double>,total:double>>"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column, width: int = 8) -> Column:
    """How many words stand in a window of ``width`` words that the array holds twice or more."""
    n = F.size(words) - (width - 1)
    windows = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, width)))

    def covered(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            beside = lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"])
            kept = F.filter(s, lambda e, i: F.coalesce(F.when(i > 0, beside(e, i)).otherwise(F.get(s, i + 1)["h"] == e["h"]), F.lit(False)))
            return F.array_sort(F.transform(kept, lambda e: e["i"]))

        def union(p: Column) -> Column:
            gaps = F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        return bind(bind(order, places), union)

    checked = bind(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(n < 2, F.lit(0).cast("long")).otherwise(checked)


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def measure(docs: DataFrame, common: dict[str, list[str]] = COMMON_WORDS, text: str = "text") -> DataFrame:
    """Adds ``n_words``, the base figures, ``classes`` (counts in the order of CLASSES),
    and ``common`` (array of word, n) to every row."""
    t = F.coalesce(F.col(text), F.lit(""))
    # each step works on what the one before left, so that only the first reads the whole text
    steps = docs.withColumn("__t", t)
    steps = steps.withColumn("__r1", F.regexp_replace("__t", "[a-z]+", "")).withColumn("__r2", F.regexp_replace("__r1", BLANK, ""))
    steps = steps.withColumn("__r3", F.regexp_replace("__r2", "[A-Z]+", "")).withColumn("__r4", F.regexp_replace("__r3", "[0-9]+", ""))
    steps = steps.withColumn("__r5", F.translate("__r4", "#*$%&|<>", "")).withColumn("__r6", F.regexp_replace("__r5", r"[\x00-\x7F]+", ""))
    size = lambda c: F.length(c).cast("long")
    names = ["__t", "__r1", "__r2", "__r3", "__r4", "__r5", "__r6"]
    left = [size(a) - size(b) for a, b in zip(names, names[1:], strict=False)] + [size("__r6")]
    listed = sorted({w for words in common.values() for w in words})
    plain = F.split(F.lower(F.translate("__t", ".,;:!?", "      ")), BLANK)
    found = F.filter(plain, lambda w: w.isin(listed))
    histogram = bind(found, lambda f: F.transform(F.array_distinct(f), lambda w: F.struct(w.alias("word"), F.size(F.filter(f, lambda x: x == w)).alias("n"))))
    words = F.filter(F.split("__t", BLANK), lambda w: w != "")
    pair = bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("repeat")))
    return steps.select(
        *docs.columns,
        pair.alias("__pair"),
        (size("__t") - (size("__r1") - size("__r2"))).alias("word_chars"),
        (size("__r4") - size("__r5")).alias("n_symbols"),
        _dup_lines(F.col("__t")).alias("n_dup_lines"),
        F.array(*left).alias("classes"),
        histogram.alias("common"),
    ).withColumns({"n_words": F.col("__pair.n"), "n_repeat_words": F.col("__pair.repeat")}).drop("__pair")


def references(measured: DataFrame, lang: str = "lang") -> list[dict]:
    """References: lang, shares of CLASSES, shares of common words and their sum, over all rows of each language.

    One entry for each language, or one for all rows where none is named: as many as there are languages.
    """
    sums = [F.count("*").alias("n"), F.sum("n_words").alias("words"), *(F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(CLASSES)))]
    rows = [r.asDict() for r in measured.groupBy(lang).agg(*sums).collect()]
    counted = measured.select(lang, F.explode("common").alias("e")).groupBy(lang, F.col("e.word").alias("word")).agg(F.sum("e.n").alias("n")).collect()
    n = sum(r["n"] for r in rows)
    if not n:
        return []
    names = [f"c{i}" for i in range(len(CLASSES))]
    every = {c: sum(r[c] for r in rows) / n for c in (*names, "words")}  # of an average row
    every_word: dict[str, float] = {}
    own_words: dict[str | None, dict[str, float]] = {}
    for r in counted:
        every_word[r["word"]] = every_word.get(r["word"], 0.0) + r["n"] / n
        own_words.setdefault(r[lang], {})[r["word"]] = r["n"]
    out = []
    for r in sorted((r for r in rows if r[lang] is not None), key=lambda r: r[lang]) or [{lang: ""} | dict.fromkeys((*names, "words"), 0)]:
        chars = [r[c] + PRIOR_ROWS * every[c] for c in names]
        words = max(1.0, r["words"] + PRIOR_ROWS * every["words"])
        own = own_words.get(r[lang], {})
        shares = {w: (own.get(w, 0) + PRIOR_ROWS * m) / words for w, m in sorted(every_word.items())}
        out.append({"lang": r[lang], "chars": [c / max(1.0, sum(chars)) for c in chars], "words": shares, "total": sum(shares.values())})
    return out


def _part(p: Column, q: Column) -> Column:
    """Half a bin's share of the Jensen-Shannon divergence of p and q."""
    one = lambda a: F.when(a > 0, a * F.log2(2 * a / (p + q))).otherwise(0.0)
    return 0.5 * (one(p) + one(q))


def _word_divergence(ref: Column) -> Column:
    """Divergence of a row's common words from the shares of a language; all other words are one bin."""
    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))

    def step(a: Column, e: Column) -> Column:
        q = F.coalesce(F.try_element_at(ref["words"], e["word"]), F.lit(0.0))
        p = e["n"] / F.greatest(F.col("n_words"), F.lit(1))
        return F.struct((a["d"] + _part(p, q)).alias("d"), (a["p"] + p).alias("p"), (a["q"] + q).alias("q"))

    # common words that the text lacks add half their share each
    rest = lambda x: F.greatest(1.0 - x, F.lit(0.0))
    return bind(F.aggregate("common", zero, step), lambda s: s["d"] + 0.5 * F.greatest(ref["total"] - s["q"], F.lit(0.0)) + _part(rest(s["p"]), rest(ref["total"])))


def distances(measured: DataFrame, refs: list[dict]) -> DataFrame:
    """Adds ``nearest_lang``, ``char_distance`` and ``word_distance``: to the reference that is nearest by their sum, the
    first in order at a tie (null without any)."""
    table = F.from_json(F.lit(json.dumps(refs)), REFERENCE)
    total = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    share = F.transform("classes", lambda c: c / F.greatest(total, F.lit(1)))
    root = lambda d: F.sqrt(F.greatest(d, F.lit(0.0)))
    parts = bind(share, lambda p: F.transform(table, lambda r: F.struct(root(F.aggregate(F.zip_with(p, r["chars"], _part), F.lit(0.0), lambda a, x: a + x)).alias("c"), root(_word_divergence(r)).alias("w"), r["lang"].alias("lang"))))
    near = F.array_min(F.transform(parts, lambda d: F.struct((d["c"] + d["w"]).alias("sum"), d["lang"].alias("lang"), d["c"].alias("c"), d["w"].alias("w"))))
    return measured.withColumn("__near", near).withColumns({"nearest_lang": F.col("__near.lang"), "char_distance": F.col("__near.c"), "word_distance": F.col("__near.w")}).drop("__near")


def quality(docs: DataFrame, char_limit: float = 0.25, word_limit: float = 0.2, min_chars: int = 200, min_words: int = 40, word_noise: float = 1.0, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Base figures, distances and verdict of every row.

    ``base_failed``: under 20 words, or over 30 % of the words in repeated windows.
    ``kept`` is false if the base failed, or if a distance to the nearest language
    reference is over its limit, which for words is ``word_limit`` plus ``word_noise`` / sqrt(n_words), as short
    texts are farther from any reference by chance; texts below ``min_chars`` or ``min_words`` are not
    judged by that histogram. Null and empty texts have no words and fail the base. Rows without a language
    join no language's reference but that of all rows; rows are judged by their text alone. Ties between
    references go to the first language in order. Rows that repeat are judged alike; an empty table gives
    an empty result; other columns are ignored. Texts are taken whole.
    """
    rows = materialise(measure(docs.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))).drop("text"))
    refs = references(rows)
    judged = distances(rows, refs)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    total = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    far = F.coalesce((total >= min_chars) & (F.col("char_distance") > char_limit), F.lit(False)) | F.coalesce((F.col("n_words") >= min_words) & (F.col("word_distance") > word_limit + word_noise / F.sqrt("n_words")), F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~far).alias("kept"), F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"), "nearest_lang")
