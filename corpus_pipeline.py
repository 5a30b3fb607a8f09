"""The corpus pipeline: quality classifier, quality rules, near duplicates, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the
next stage's documents. All stages but the last return the columns of ``documents``, whatever they are. A decision is
made per row by the document's id; rows without an id are judged by the stages that read single texts and are left
alone by those that compare documents (near duplicates, benchmark matches).

Cases: a null or empty text is a document without words, which the first two stages reject; very long texts are read
whole; of documents that are alike the smallest id stays, and of rows that repeat both id and text one; an empty table
gives empty tables of the same columns at every stage; further columns travel along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import read_table
from quayside.llm.compression_bands import within_bands
from quayside.llm.curve_packing import pack_along_curve
from quayside.llm.latent_decontamination import contaminated
from quayside.llm.ordinal_quality import of_quality, ratings_of
from quayside.llm.simhash_bytes import near_duplicates
from quayside.storage import materialise


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is not in ``rejected(doc_id)``; rows without an id stay.

    The ids are written first: Spark then knows how few they are, and the texts are not shuffled for them.
    """
    key = _free(docs, "rejected_id")
    named = materialise(rejected.where("doc_id is not null").select(F.col("doc_id").alias(key)).distinct(), "pipeline-rejected")
    return docs.join(named, docs["doc_id"].cast("long") == named[key], "left_anti")


def _once(docs: DataFrame) -> DataFrame:
    """Rows that repeat both id and text once; only ids that repeat are shuffled with their texts."""
    key, number, digest = (_free(docs, x) for x in ("repeated_id", "times", "digest"))
    repeated = materialise(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(key)).agg(
        F.count(F.lit(1)).alias(number)).where(F.col(number) > 1).select(key), "pipeline-repeated")
    again = docs["doc_id"] == repeated[key]
    single = docs.join(repeated, again, "left_anti")
    several = docs.join(repeated, again, "left_semi").withColumn(digest, F.sha2(F.coalesce("text", F.lit("")), 256))
    return single.unionByName(several.dropDuplicates(["doc_id", digest]).drop(digest))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability of a sound grade is high enough."""
    return of_quality(docs, ratings_of(read_table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the compression bands that pass the base rules."""
    return within_bands(docs)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id. An id that names several texts goes only if all of
    them are copies of others."""
    groups = materialise(near_duplicates(docs), "pipeline-groups")
    stays = F.max(F.col("doc_id") == F.col("component_id"))
    return _without(_once(docs), groups.groupBy("doc_id").agg(stays.alias("stays")).where("not stays"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return _without(docs, contaminated(docs, read_table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full training sequences."""
    return pack_along_curve(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicate_removal),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Fitted weights, compressed sizes, hashes and merges have no SQL form: tests compare with brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{number}")
    return docs
