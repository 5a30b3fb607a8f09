"""Catalogue tables: listing, preview, lookup, publishing and removal."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside import types as L
from quayside.errors import RequestError
from quayside.functions.text import IDENTIFIER_PATTERN, SECTIONS
from quayside.storage import delete_path

PREVIEW_ROWS = 10


def quoted(name: str) -> str:
    """``schema.table`` as a quoted identifier."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split(".", 1))


def text_literal(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def describe_columns(df: DataFrame) -> DataFrame:
    """Name, SQL type, logical type and category of each column, in order."""
    rows = [
        (i, f.name, L.sql_name(f.dataType), L.logical_of(f.dataType), L.type_category(L.sql_name(f.dataType)))
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows, "ordinal int, column_name string, data_type string, logical_type string, category string")


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``path, size_bytes, sha256`` (lower-case hex) of the content of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def preview(df: DataFrame, order: Sequence[str] = (), n: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows with every cell as text, NULL as the empty text."""
    rows = df.orderBy(*order).limit(n) if order else df.limit(n)
    return rows.select(*[
        F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def split_name(stored: str, fallback_schema: str, known: Sequence[str] = SECTIONS) -> tuple[str, str]:
    """Schema and table of a stored name; a name without a known schema gets the fallback."""
    if not stored or not stored.strip():
        raise RequestError("a table name is required")
    parts = [p for p in stored.split(".", 1) if p]
    if len(parts) == 2 and parts[0].lower() in [s.lower() for s in known]:
        return parts[0], parts[1]
    return fallback_schema, stored.strip()


def resolve_table(sections: DataFrame, name: str) -> DataFrame:
    """Section records whose table has this name, any case, with or without its schema."""
    wanted = name.strip().upper()
    stored = F.upper("table_name")
    bare = F.upper(F.regexp_replace("table_name", r"^(?i)(" + "|".join(SECTIONS) + r")\.", ""))
    return sections.filter((stored == wanted) | (bare == wanted))


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(quoted(name))


def table_location(spark: SparkSession, name: str) -> str:
    rows = spark.sql(f"DESCRIBE EXTENDED {quoted(name)}").filter("col_name = 'Location'").head()
    if rows is None:
        raise RequestError(f"{name} has no location")
    return rows["data_type"]


def table_properties(spark: SparkSession, name: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {quoted(name)}").collect()}


def create_external(spark: SparkSession, name: str, path: str, schema: T.StructType,
                    properties: dict[str, str] | None = None) -> None:
    """Register Parquet data at ``path``; only the catalogue is touched."""
    columns = ", ".join(
        f"{_column(f.name)} {f.dataType.simpleString()}" +
        (f" COMMENT 'max_length={f.metadata['max_length']}'" if "max_length" in f.metadata else "")
        for f in schema.fields)
    extra = ""
    if properties:
        extra = " TBLPROPERTIES (" + ", ".join(f"{text_literal(k)} = {text_literal(v)}" for k, v in properties.items()) + ")"
    spark.sql(f"CREATE TABLE {quoted(name)} ({columns}) USING parquet "
              f"OPTIONS (recursiveFileLookup 'true') LOCATION {text_literal(path)}{extra}")


def _column(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def point_to(spark: SparkSession, name: str, path: str) -> None:
    """Let a table read another folder: one catalogue step, readers see the old or the new content."""
    spark.sql(f"ALTER TABLE {quoted(name)} SET LOCATION {text_literal(path)}")
    spark.catalog.refreshTable(quoted(name))


def publish(spark: SparkSession, name: str, path: str, schema: T.StructType,
            properties: dict[str, str] | None = None, purge: bool = False) -> None:
    """Make finished data visible under ``name``, replacing an older table of that name.

    A table of the same columns is pointed to the new folder, so that readers never miss it. Other columns need a
    new catalogue entry. ``purge`` deletes the older folder afterwards.
    """
    if "." in name:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {quoted(name.split('.', 1)[0])}")
    older = table_location(spark, name) if table_exists(spark, name) else None
    same = older is not None and [(f.name, f.dataType) for f in spark.table(quoted(name)).schema] == [
        (f.name, f.dataType) for f in schema] and (properties or {}).items() <= table_properties(spark, name).items()
    if same:
        point_to(spark, name, path)
    else:
        drop_table_if_exists(spark, name)
        create_external(spark, name, path, schema, properties)
    if purge and older and older.rstrip("/") != path.rstrip("/"):
        delete_path(spark, older)


def drop_table_if_exists(spark: SparkSession, name: str, purge: bool = False) -> bool:
    """Remove a table; ``purge`` also deletes the files of an external table."""
    if not table_exists(spark, name):
        return False
    path = table_location(spark, name) if purge else None
    spark.sql(f"DROP TABLE IF EXISTS {quoted(name)}")
    if path:
        delete_path(spark, path)
    return True


def check_identifier(name: str) -> str:
    if not re.fullmatch(IDENTIFIER_PATTERN.strip("^$"), name):
        raise RequestError("the table name contains unsupported characters")
    return name
