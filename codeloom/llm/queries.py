"""The ten registered queries, their SQL, and the pipeline's query."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, chat, embedding, fingerprint, html, jaccard, language, licenses, packing, toxicity
from codeloom.llm.common import held_out, stash, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, F.col("doc_id"), packing.tokens(spark, F.col("text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "digest", "license_id", "notices", "n_notice_lines")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Learned from the labelled documents outside the held-out fifth, a bounded sample of them."""
    marks = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = marks.count()
    # about twice the sample at most: a bounded table, so it may be broadcast to the documents
    marks = marks.where(toxicity.hash_unit(F.col("doc_id"), F.lit("sample")) < toxicity.SAMPLE / max(total, 1))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(marks), "doc_id")
    labelled = stash(docs.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")), "sample")
    return toxicity.fit(labelled.select("text", "toxic", F.col("doc_id").alias("key")), sample=10**12)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity_model(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", bpe.codec_columns(spark, path, public_tokenizers.PATTERN, F.col("text")).alias("c")).select("doc_id", "c.*")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pages.select("page_id", "url", html.extract(F.col("html")).alias("m")).select("page_id", "url", "m.*")


def language_dictionaries(spark: SparkSession, sf_dir: str) -> dict[str, bytes]:
    docs = table(spark, sf_dir, "documents").where(~held_out(F.col("doc_id")))
    return language.fit(docs.select("text", "lang", F.col("doc_id").alias("key")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionaries = language_dictionaries(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    named = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language.identify(dictionaries, F.col("text")).alias("l"))
    return named.select("doc_id", "held_out", F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"), F.col("l.rejected").alias("rejected"))


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_segments(chat.neighbours(table(spark, sf_dir, "conversations")))


def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``op10_preference_format`` assembled: a row for each pair, masks as text."""
    pairs = chat.assemble(op10_preference_format(spark, sf_dir))
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["length"].cast("string"), x["loss"].cast("string"))), ",")
    return pairs.select("pair_id", "prompt", "chosen", "rejected", *(said(c).alias(c) for c in ("chosen_mask", "rejected_mask")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_license_scan, op3_embedding_near_dedup, op4_toxicity, op5_order_minhash, op6_byte_bpe, op7_ngram_jaccard, op8_html_extraction, op9_language_id, op10_preference_format, preference_pairs)}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": licenses.sql(), "op3_embedding_near_dedup": embedding.SQL, "op7_ngram_jaccard": jaccard.SQL, "op10_preference_format": chat.SQL, "preference_pairs": chat.PAIRS_SQL}
