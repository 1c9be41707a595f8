"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, decontaminate, imatch, mixing, pii, quality, simhash, suffix_dedup, url_filter, warc
from .common import table

#: fixed values: the url rules as (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of a page: the quality label of the document of its number."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return url_filter.judge(table(spark, sf_dir, "pages"), outcomes, RULES)


def op2_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts are written as numbers once; the model learns from those that are not held out."""
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), brown.held_out(F.col("doc_id"))
    words, counts = brown.vocabulary(docs.where(~held))
    codes = brown.coded(docs, words)
    model = brown.clustered(codes.where(~held), words)
    return brown.score_coded(codes, model, counts).select(
        "doc_id", brown.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), texts=False).drop("kept")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found_table(table(spark, sf_dir, "documents"))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table, texts and all, mixed to target weights by row count to the power 0.7."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("y"))
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_url_reputation, op2_brown_lm, op3_suffix_dedup, op4_simhash, op5_pii, op6_imatch, op7_warc, op8_decontaminate, op9_mix, op10_quality)}
