"""Registered queries of the operators, one per operator, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quayside.llm.common import read_table
from quayside.llm.compression_bands import compression_bands
from quayside.llm.curve_packing import pack_along_curve
from quayside.llm.feast_whitening import whitened_embeddings
from quayside.llm.katz import katz_scores
from quayside.llm.latent_decontamination import contaminated
from quayside.llm.ordinal_quality import ordinal_quality, ratings_of
from quayside.llm.simhash_bytes import near_duplicates
from quayside.llm.splitter_shards import ORACLE as SHARDS_SQL
from quayside.llm.splitter_shards import sharded
from quayside.llm.string_kernel import toxicity
from quayside.llm.temporal_lists import ORACLE as TEMPORAL_LISTS_SQL
from quayside.llm.temporal_lists import dated_captures, dated_entries, judge_captures
from quayside.llm.token_counts import token_counts
from quayside.llm.trie_variants import ORACLE as VARIANTS_SQL
from quayside.llm.trie_variants import spelling_variants
from quayside.llm.zip_warc import round_trip


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal_quality(read_table(spark, sf_dir, "documents"), ratings_of(read_table(spark, sf_dir, "labels")))


def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(read_table(spark, sf_dir, "documents"))


def op3_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(read_table(spark, sf_dir, "documents"))


def op4_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))


def op5_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_simhash_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_along_curve(read_table(spark, sf_dir, "documents"))


def op8_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return judge_captures(dated_captures(pages), dated_entries(read_table(spark, sf_dir, "events"), pages))


def op11_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_embeddings(read_table(spark, sf_dir, "embeddings"))


def op12_trie_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"))


def op13_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_ordinal_quality, op2_compression_bands, op3_katz_backoff, op4_whole_token_counts, op5_string_kernel, op6_simhash_bytes, op7_curve_packing, op8_zip_warc, op9_latent_decontamination,
        op10_temporal_lists, op11_feast_whitening, op12_trie_variants, op13_splitter_shards)
}
ORACLES: dict[str, str] = {"op10_temporal_lists": TEMPORAL_LISTS_SQL, "op12_trie_variants": VARIANTS_SQL, "op13_splitter_shards": SHARDS_SQL}
