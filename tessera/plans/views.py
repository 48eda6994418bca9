"""Inputs of the reference's operator families, derived from the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges customer to supplier of all order lines, with the least quantity."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    pairs = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), (F.lit(1_000_000) + F.col("l_suppkey")).alias("dst"), F.col("l_quantity").cast("int").cast("long").alias("weight"))
    return pairs.groupBy("src", "dst").agg(F.min("weight").alias("weight"))


TRIPS_SQL = """d AS (SELECT o_custkey AS s, 1000000 + l_suppkey AS t, min(CAST(l_quantity AS BIGINT)) AS w
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
e AS (SELECT s, t, w FROM d UNION ALL SELECT t, s, w FROM d)"""


def points_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").alias("x"))


def points(spark: SparkSession, sf_dir: str, d: int = 4) -> DataFrame:
    values = F.transform(F.slice("embedding", 1, d), lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), values.alias("features"), F.col("label").cast("int").alias("label"))


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.round(F.col("value") * 100).cast("long").alias("value"))


VEC_SQL = "vec AS (SELECT event_id AS idx, CAST(round(value * 100) AS BIGINT) AS value FROM events)"


def mat(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("i"), F.pmod("l_partkey", F.lit(50)).alias("j"), F.col("l_quantity").cast("long").alias("v"))
    return items.groupBy("i", "j").agg(F.sum("v").alias("v"))


MAT_SQL = "mat AS (SELECT l_suppkey AS i, l_partkey % 50 AS j, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2)"
