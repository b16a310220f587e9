"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept and
returns the columns of ``documents``, but for the last, which returns token counts.

All stages take the same odd rows in the same way. A null text counts as empty; texts are
taken whole, however long; rows may repeat and keys may be null or repeat. An empty table gives
an empty table. Other columns than those of ``documents``, whatever their names, are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import piece_bpe, pigeonhole, simhash_vp, suffix_dedup, toxic_neighbours
from plumbline.llm.common import held_out, materialise, release, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go.

    The model learns from the labelled rows of ``docs`` that are not held out. Texts without a
    known word score the share of toxic rows, so they stay where less than half are toxic; equal texts fare alike.
    """
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    model = toxic_neighbours.fit(docs, labels)
    return toxic_neighbours.score(docs, model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


#: Repeated keys up to which they are broadcast.
FEW_KEYS = 100_000


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a key ``rid`` that no two rows share, and (rid, doc_id) of the rows whose ``doc_id`` could not be it.

    Rows with a null or repeated doc_id get numbers below all others; only these rows are written.
    """
    again = materialise(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    few = again.count() <= FEW_KEYS
    again = F.broadcast(again) if few else again
    low = docs.agg(F.least(F.lit(0), F.min("doc_id")).alias("low")).first()[0] or 0
    odd = docs.where("doc_id is null").unionByName(docs.join(again, "doc_id", "left_semi").select(*docs.columns))
    odd = materialise(odd.select(*COLUMNS, (F.lit(low) - 1 - F.monotonically_increasing_id()).alias("rid")))
    plain = docs.where("doc_id is not null").join(again, "doc_id", "left_anti").select(*COLUMNS, F.col("doc_id").cast("long").alias("rid"))
    rows = plain.unionByName(odd)
    return (rows if few else materialise(rows)), odd.select("rid", F.col("doc_id").alias("own"), F.lit(True).alias("odd"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest doc_id, nulls last.

    Rows are told apart even where doc_id is null or repeats: of whole rows that repeat one stays. Texts without a
    word form one group.
    """
    rows, odd = _numbered(docs)
    groups = materialise(simhash_vp.near_copies(rows, similarity=0.8, shingle=5, key="rid").withColumnRenamed("doc_id", "rid"))
    named = groups.join(odd, "rid", "left").select("component_id", "rid", F.when(F.col("odd"), F.col("own")).otherwise(F.col("rid")).alias("own"))
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull().alias("none"), "own", "rid")).alias("first"))
    gone = groups.select("rid").join(first.select(F.col("first.rid").alias("rid")), "rid", "left_anti")
    return rows.join(gone.hint("merge"), "rid", "left_anti").select(*COLUMNS)  # one plan for every size


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of strings of STRING_BYTES bytes or more go from the texts; emptied documents go.

    The place of the smallest doc_id (nulls first) and offset counts as the first. Texts that lose nothing stay as they
    are, null ones as empty.
    """
    kept = suffix_dedup.dedup_substrings(docs, STRING_BYTES, keep_first=True, keep=("lang", "source"))
    left = kept.where("n_removed = 0 or length(trim(kept)) > 0")
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; empty texts hold none, and an empty benchmark removes nothing."""
    return pigeonhole.leaks(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of every text that is left; an empty text has the end id alone."""
    import public_tokenizers

    return piece_bpe.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), full=False)


#: Repeated strings have this many bytes at least: about fifty words.
STRING_BYTES = 250

STAGES = [("toxicity", toxicity), ("simhash_dedup", simhash_dedup), ("suffix_array_dedup", suffix_array_dedup), ("decontaminate", decontaminate), ("tokenize", tokenize)]
#: The stages after the first are iterative or need byte-level tables, so no SQL gives the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again, and what it wrote besides is deleted."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        mark = written()
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialise(docs)
            release(spark, max(0, mark - (number > 1)), written() - 1)
    return docs
