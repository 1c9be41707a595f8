"""A corpus pipeline: five stages, each over all that the one before kept.

Every stage is written as Parquet in the shared folder and read again as the next
one's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontaminate, mixing, pii, quality, simhash
from brindle.llm.common import fresh, keep, named, table
from brindle.shipping import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.3 go.

    A null text is scored as an empty one; repeated rows are scored each, and a null doc_id is one of them. Without
    labels of two classes every score is the share of label 1, or 0.5, so all stay or all go.
    """
    labels = table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("y"))
    (score,) = fresh(docs, "_quality")
    return quality.score(docs, quality.fit(docs, labels), score).where(F.col(score) >= 0.3).select(named(docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, linked by fingerprints or by four fifths of the five-word shingles: that with the smallest doc_id.

    A null doc_id comes last; of texts that share the doc_id that with the smallest hash stays, and of
    rows alike in both, any one. Null and empty texts are one component.
    """
    ship(spark)
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document of which a twentieth of the words or more lies in benchmark windows goes; from others the hit words are cut, and n_chars follows the text.

    Null and empty texts are clean. Without benchmark items all stay as they are.
    """
    found = decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"), drop_from=0.05)
    return _sized(found, docs)


def _sized(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, n_chars as the texts have; a null text keeps what it had."""
    return found.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")).select(named(docs.columns))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows the text. Null texts stay null; repeated rows are searched each."""
    ship(spark)
    return _sized(pii.redact(docs), docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are replicated towards weights by row count to the power 0.7, and shuffled; copy and shuffle_key are added. A null source is a source of its own."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs


#: SQL can't express the classifier, the fingerprints or the extraction; the tests hold the stages against brute force.
ORACLE_SQL = None
