"""Connected components of an edge table by alternating star steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.storage import delete_path, fresh_path


def _written(edges: DataFrame, path: str) -> tuple[DataFrame, tuple]:
    edges.write.parquet(path)
    rows = edges.sparkSession.read.schema(edges.schema).parquet(path)
    mark = rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return rows, tuple(mark)


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node are linked to the smallest node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.min("a")).alias("m"))
    return both.join(least, both["a"] == least["n"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    links = edges.join(least, edges["a"] == least["n"])
    return links.select(F.explode(F.array(
        F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
    ).select("e.a", "e.b").where("a > b").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``(node, root)`` of every node in ``edges(a, b)``; root is the smallest node it is linked to.

    Self links are ignored; nodes without a link are not returned; edges may repeat and have either direction.
    The rounds grow with the logarithm of the longest path. No edge list reaches the driver.
    """
    spark = edges.sparkSession
    start = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path = fresh_path(spark, label)
    rows, mark = _written(start, path)
    while mark[0]:
        following = fresh_path(spark, label)
        stars, other = _written(_small(_large(rows)), following)
        if other == mark:
            delete_path(spark, following)
            break
        delete_path(spark, path)
        path, rows, mark = following, stars, other
    roots = rows.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return rows.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
