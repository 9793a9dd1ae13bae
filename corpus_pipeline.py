"""Corpus pipeline: language ID, toxicity, near-duplicate removal, packing. Part of subpackage ``llm``.

Each stage takes (spark, docs, sf_dir); ``run`` writes what a stage returns as Parquet in the shared folder and reads
it back as the next stage's documents. All stages but the last return the columns of ``documents``. Column names that begin
with two underscores are the stages' own. A document without text has no language and goes at the first stage; an empty
table stays empty; repeated rows stay up to the third stage, which keeps one of each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import jaccard, language, packing, queries, toxicity
from codeloom.llm.common import stash, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart; those without letters, or between two languages, go."""
    dictionaries = queries.language_dictionaries(spark, sf_dir)
    judged = docs.withColumn("__judged", language.identify(dictionaries, F.col("text")))
    return judged.where(~F.col("__judged.rejected")).drop("__judged")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half."""
    model = queries.toxicity_model(spark, sf_dir)
    return docs.withColumn("__score", toxicity.score(model, F.col("text"))).where(F.col("__score") < 0.5).drop("__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of links: the first by id. Of rows that repeat an id and its text one stays, too;
    documents without an id stay."""
    found = stash(jaccard.join(docs), "classes")
    hashed = docs.withColumn("__hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    key = (F.col("doc_id") == F.col("__id")) & (F.col("__hash") == F.col("__text"))
    named = found.where("doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text"), "kept")
    left = hashed.join(named.where("not kept").select("__id", "__text").distinct(), key, "left_anti")
    repeated = named.where("kept").groupBy("__id", "__text").agg(F.count("*").alias("n")).where("n > 1").select("__id", "__text")
    if not repeated.isEmpty():
        ones = left.join(repeated, key, "left_semi").dropDuplicates(["doc_id", "__hash"])
        left = left.join(repeated, key, "left_anti").unionByName(ones)
    return left.drop("__hash")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, in bins."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return packing.pack(docs, F.col("doc_id"), packing.tokens(spark, F.col("text"), path, public_tokenizers.PATTERN))


STAGES = [("language_id", language_id), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("best_fit_packing", best_fit_packing)]

#: Compression, boosted trees and best fit cannot be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
