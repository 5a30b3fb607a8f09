"""Portal tables derived from the driver tables by column expressions only (no subsets)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Labels of the visibility numbers.
VISIBILITIES = ((1, "Public"), (2, "Private"), (3, "Internal"), (4, "Personal"))


class Portal:
    """Tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def datasets(self) -> DataFrame:
        whole = F.floor("o_totalprice").cast("bigint").cast("string")
        kind = F.col("o_orderkey") % 8
        size = (
            F.when(kind == 0, F.concat(whole, F.lit(" B")))
            .when(kind == 1, F.concat(whole, F.lit(" KB")))
            .when(kind == 2, F.concat(whole, F.lit(".5 MB")))
            .when(kind == 3, F.concat(F.lit("  "), whole, F.lit("   gb ")))
            .when(kind == 4, F.concat(whole, F.lit(" TB")))
            .when(kind == 5, F.lit("unknown"))
            .when(kind == 6, F.concat(whole, F.lit(" PB"))))
        key = F.col("o_orderkey")
        return self.raw("orders").select(
            key.alias("id"),
            F.concat(F.lit("Dataset "), key, F.lit(" "), "o_orderpriority").alias("name"),
            F.when(F.col("o_orderstatus") != "P", F.concat(
                F.lit("status "), "o_orderstatus", F.lit(" priority "), "o_orderpriority")).alias("description"),
            size.alias("size_text"),
            (key % 4 + 1).cast("int").alias("visibility"),
            F.col("o_custkey").alias("owner_id"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("licence_id"),
            (key % 7).cast("bigint").alias("site_id"),
            F.when(key % 6 != 0, (key % 5).cast("int")).alias("energy_type_id"),
            F.when(key % 10 != 0, F.col("o_orderdate")).alias("updated_at"),
            (key % 3 != 0).alias("allow_api"), (key % 5 != 0).alias("allow_download"),
            (key % 2 == 0).alias("anonymised"), (key % 3 == 1).alias("time_series"),
            (key % 11 == 0).alias("locked"),
            F.when(key % 4 == 1, key).alias("event_logs_id"), F.when(key % 9 == 0, key).alias("context_id"))

    def users(self) -> DataFrame:
        key = F.col("c_custkey")
        first, last = F.substring_index("c_name", "#", 1), F.substring_index("c_name", "#", -1)
        host = F.when(key % 13 == 0, F.lit("other.org")).otherwise(
            F.concat(F.lit("nation"), "c_nationkey", F.lit(".org")))
        return self.raw("customer").select(
            key.alias("id"), first.alias("first_name"), last.alias("last_name"),
            F.lower(F.concat(first, F.lit("."), last, F.lit("@"), host)).alias("email"),
            F.col("c_nationkey").alias("org_id"), (key % 4 + 1).cast("int").alias("role_id"),
            (key % 10 != 0).alias("active"))

    def organisations(self) -> DataFrame:
        nations = self.raw("nation").select(
            F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"),
            (F.col("n_nationkey") % 6 != 0).alias("active"))
        regions = self.raw("region").select(
            (F.col("r_regionkey") + 100).cast("int").alias("id"), F.col("r_name").alias("name"),
            F.lit(True).alias("active"))
        return nations.unionByName(regions)

    def domains(self) -> DataFrame:
        key = F.col("n_nationkey")
        used = self.raw("nation").select(
            key.alias("id"), key.alias("org_id"), F.concat(F.lit("nation"), key, F.lit(".org")).alias("domain"),
            (key % 7 != 0).alias("active"))
        unused = self.raw("nation").select(
            (key + 1000).cast("int").alias("id"), key.alias("org_id"),
            F.concat(F.lit("unused"), key, F.lit(".org")).alias("domain"), F.lit(True).alias("active"))
        return used.unionByName(unused)

    def requests(self) -> DataFrame:
        key = F.col("s_suppkey")
        start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        return self.raw("supplier").select(
            key.alias("id"), F.substring_index("s_name", "#", 1).alias("first_name"),
            F.substring_index("s_name", "#", -1).alias("last_name"),
            F.concat(F.lit("s"), key, F.lit("@NATION"), "s_nationkey", F.lit(".org")).alias("email"),
            F.col("s_nationkey").alias("org_id"), (key % 3 + 1).cast("int").alias("status_id"),
            (key % 2 == 0).alias("email_verified"),
            (start + F.make_dt_interval(hours=key.cast("int"))).alias("created_at"))

    def licences(self) -> DataFrame:
        return self.raw("orders").select(
            F.substring("o_orderpriority", 1, 1).cast("int").alias("id"),
            F.col("o_orderpriority").alias("label")).distinct().withColumn("active", F.col("id") != 4)

    def sites(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 3 != 0).alias("active"))

    def energy_types(self) -> DataFrame:
        return self.raw("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("label"))

    def visibilities(self) -> DataFrame:
        rows = ", ".join(f"({i}, '{label}')" for i, label in VISIBILITIES)
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS v(id, label)")

    def devices(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("manufacturer"),
            F.col("p_type").alias("model"), F.col("p_size").alias("capacity"), (F.col("p_size") > 10).alias("active"))

    def bridge(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("dataset_id"), F.col("l_partkey").alias("device_id")).distinct()

    def section_parts(self) -> dict[str, DataFrame]:
        """The three section tables, still apart."""
        key = F.col("o_orderkey")
        orders = self.raw("orders")
        code = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lpad((key % 100).cast("string"), 2, "0"))
        status = F.when(key % 5 == 0, F.lit("pending")).when(key % 5 == 1, F.lit("failed")).when(
            key % 5 == 2, F.lit("completed"))

        def part(kind: str, label, present) -> DataFrame:
            # A section that a dataset does not have is no row of the section table.
            return orders.filter(present).select(
                key.alias("dataset_id"), label.alias("label"), code.alias("code"),
                F.concat(F.lit(kind + "."), F.lit("T_"), key).alias("table_name"),
                (key % 2 == 0).alias("index_enabled"), F.lit("ts").alias("index_time"),
                F.when(key % 3 == 0, F.lit("sensor")).alias("index_id"),
                F.when(key % 4 == 0, F.lit("value")).alias("index_include"),
                F.when(key % 2 == 0, F.concat(F.lit("IX_T_"), key, F.lit("_time"))).alias("index_name"),
                status.alias("index_status"))

        label = F.concat("o_orderstatus", F.lit(" "), "o_orderpriority")
        return {
            "donnees": part("donnees", label, F.lit(True)),
            "donnees_event_logs": part("donnees_event_logs", F.concat(F.lit(" Events "), label, F.lit(" ")), key % 4 == 1),
            "donnees_contexte_environnemental": part(
                "donnees_contexte_environnemental", F.concat(F.lit("Context "), label), key % 9 == 0),
        }

    def sections(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [
            df.withColumn("section_type", F.lit(kind)) for kind, df in self.section_parts().items()])

    def access_log(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"), F.floor(F.col("value") * 30).cast("bigint").alias("dataset_id"),
            F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id"),
            F.when(F.col("event_id") % 3 != 0, F.col("user_id") % 20).alias("token_id"),
            F.col("ts").alias("accessed_at"), F.floor(F.col("value") * 1000).cast("bigint").alias("bytes"))

    def tokens(self) -> DataFrame:
        key = F.col("c_custkey")
        start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        created = start + F.make_dt_interval(mins=(key % 2000).cast("int"))
        return self.raw("customer").select(
            key.alias("id"), (key % 50).alias("user_id"), F.concat(F.lit("token "), key).alias("label"),
            created.alias("created_at"),
            F.when(key % 4 == 0, created + F.make_dt_interval(hours=F.lit(1))).alias("revoked_at"))

    def replace_sessions(self) -> DataFrame:
        key = F.col("o_orderkey")
        created = F.col("o_orderdate") + F.make_dt_interval(hours=(key % 48).cast("int"))
        return self.raw("orders").select(
            F.concat(F.lit("job-"), F.lpad(key.cast("string"), 12, "0")).alias("id"), key.alias("dataset_id"),
            F.when(key % 6 != 0, F.col("o_custkey")).alias("user_id"), F.concat(F.lit("T_"), key).alias("table_name"),
            (key % 5).cast("int").alias("status"), created.alias("created_at"))

    def files(self) -> DataFrame:
        key = F.col("doc_id")
        return self.raw("documents").select(
            key.alias("id"), F.concat(F.lit("Document "), key).alias("name"),
            F.concat("source", F.lit("/"), key, F.lit(".txt")).alias("original_name"),
            F.octet_length("text").cast("bigint").alias("size_bytes"), F.sha2("text", 256).alias("sha256"),
            (key % 4 + 1).cast("int").alias("visibility"), (key % 150).alias("owner_id"),
            (key % 5 + 1).cast("int").alias("licence_id"), F.lit(0).cast("bigint").alias("downloads"))

    def downloads(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("file_id"), F.col("ts").alias("at"))

    def messages(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("content"),
            F.col("o_orderdate").alias("updated_at"))
