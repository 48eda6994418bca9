"""Vectors ``(idx, value)`` and matrices in coordinate form ``(i, j, v)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def random_ints(spark: SparkSession, n: int, below: int, seed: int = 42) -> DataFrame:
    """``(idx, value)``: n integers from 0 to below - 1, each a hash of its place, on any partitioning the same."""
    return spark.range(n).select(F.col("id").alias("idx"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(below)).alias("value"))


def vec_add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("idx", F.col("value").alias("a")).join(b.select("idx", F.col("value").alias("b")), "idx").select("idx", (F.col("a") + F.col("b")).alias("value"))


def array_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def grid_index(x: Column, y: Column, z: Column, nx: int, ny: int) -> Column:
    """The linear index of a place in a grid."""
    return x + y * nx + z * (nx * ny)


def grid_place(idx: Column, nx: int, ny: int) -> tuple[Column, Column, Column]:
    return F.pmod(idx, F.lit(nx)), F.pmod(F.floor(idx / nx), F.lit(ny)), F.floor(idx / (nx * ny))


def matvec(mat: DataFrame, x: DataFrame) -> DataFrame:
    """``(i, v)``: each row's products are summed in the task that made them before they are exchanged."""
    joined = mat.join(x.select(F.col("idx").alias("j"), F.col("value").alias("x")), "j")
    return joined.groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(F.col("i").alias("k"), F.col("j").alias("j"), F.col("v").alias("w"))
    left = a.select("i", F.col("j").alias("k"), "v")
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def transpose(mat: DataFrame) -> DataFrame:
    return mat.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def to_rows(mat: DataFrame, columns: int) -> DataFrame:
    """Rows as dense arrays, for a bounded number of columns."""
    values = F.map_from_entries(F.collect_list(F.struct("j", "v")))
    return mat.groupBy("i").agg(values.alias("m")).select("i", F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda j: F.coalesce(F.element_at("m", j.cast("long")), F.lit(0))).alias("row"))


def from_rows(rows: DataFrame) -> DataFrame:
    return rows.select("i", F.posexplode("row").alias("j", "v"))
