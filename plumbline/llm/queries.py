"""Queries over the driver's tables, one for each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import divergence, hard_negatives, html_consensus, langid, lexical_search, licences, piece_bpe, pigeonhole, simhash_vp, slots, suffix_dedup, token_offsets, toxic_neighbours
from plumbline.llm.common import held_out, table


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.quality(table(spark, sf_dir, "documents"))


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.shard(table(spark, sf_dir, "documents"), 16)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_offsets.count(table(spark, sf_dir, "documents"), _public("byte_bpe_50k.tiktoken"), ("text", "source"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~held_out("doc_id", 4, 2))
    out = langid.predict(docs, model)
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pigeonhole.leaks(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxic_neighbours.fit(docs, labels.where(~held_out("doc_id", 5, 0)))
    out = toxic_neighbours.score(docs, model)
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted", F.to_json("evidence").alias("evidence"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode(table(spark, sf_dir, "documents"), _public("piece_bpe_32k.model"), full=False)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vp.near_duplicates(table(spark, sf_dir, "documents"), radius=4, shingle=4)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"), 400, keep_first=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept").alias("text"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.round("score", 6).alias("score"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_consensus.main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", "n_chars")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


OP12_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
  select a.vec_id as anchor_id, v.vec_id as other_id, a.label = v.label as same, cast(list_inner_product(a.q, v.q) as bigint) as score
  from v as a join v on a.vec_id % 100 = 0 and a.vec_id <> v.vec_id
), positives as (
  select anchor_id, other_id as positive_id, score as positive_score
  from scored where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
), ranked as (
  select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id) as rank, other_id as negative_id, positive_score, score as negative_score
  from positives p join scored s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from ranked where rank <= 10
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
with term as (
  select doc_id, unnest({_TERMS.format('text')}) as term from documents
), doc as (
  select doc_id, count(*) as n from term group by doc_id
), total as (
  select count(*) as docs, cast(sum(n) as bigint) as terms from doc
), asked as (
  select distinct item_id, term from (select item_id, unnest({_TERMS.format('text')}) as term from benchmark)
), posting as (
  select doc_id, term, count(*) as tf from term where term in (select term from asked) group by doc_id, term
), weight as (
  select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from posting, total group by term, docs
), impact as (
  select p.doc_id, p.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) as score
  from posting p join weight using (term) join doc using (doc_id), total
), scored as (
  select item_id, doc_id, cast(sum(score) as bigint) as score from asked join impact using (term) group by item_id, doc_id having sum(score) > 0
)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
from scored qualify rank <= 10
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_divergence, op2_virtual_slots, op3_token_counts, op4_language, op5_decontamination, op6_toxicity, op7_sentencepiece, op8_simhash, op9_suffix_dedup, op10_licences, op11_html_text, op12_hard_negatives, op13_ranked_search)}
ORACLES: dict[str, str] = {"op12_hard_negatives": OP12_SQL, "op13_ranked_search": OP13_SQL}
