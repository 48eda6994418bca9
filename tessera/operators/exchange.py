"""Message exchanges between ranks as table operations, and the placement rules of partitioned programs as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def owner_mod(v: Column, parts: int) -> Column:
    return F.pmod(v, F.lit(parts))


def owner_block(v: Column, n: int, parts: int) -> Column:
    """Contiguous blocks; the first n % parts blocks hold one more."""
    base, more = n // parts, n % parts
    edge = more * (base + 1)
    tail = F.floor((v - edge) / max(base, 1)) + more
    return F.when(v < edge, F.floor(v / (base + 1))).otherwise(tail).cast("long")


def owner_ceil_block(v: Column, n: int, parts: int) -> Column:
    return F.floor(v / -(-n // parts)).cast("long")


def distribution(vertices: DataFrame, owner: Column) -> DataFrame:
    """``(owner, n)``: how many vertices each part holds."""
    return vertices.groupBy(owner.alias("owner")).agg(F.count(F.lit(1)).alias("n"))


def distribution_check(vertices: DataFrame, vertex: str, owner: Column) -> DataFrame:
    """One row ``(owners, held, total, ok)``: whether the owners' counts of distinct vertices add up to all of them."""
    held = vertices.select(vertex, owner.alias("owner")).distinct().groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    one = held.agg(F.count(F.lit(1)).alias("owners"), F.coalesce(F.sum("n"), F.lit(0)).alias("held"))
    total = vertices.select(vertex).distinct().agg(F.count(F.lit(1)).alias("total"))
    return one.crossJoin(total).withColumn("ok", F.col("held") == F.col("total"))


def all_to_all(messages: DataFrame) -> DataFrame:
    """``(dst, received)`` of ``(src, dst, value)``: what each rank receives, in order of the sender."""
    return messages.groupBy("dst").agg(F.transform(F.array_sort(F.collect_list(F.struct("src", "value"))), lambda m: m["value"]).alias("received"))


def all_gather(values: DataFrame) -> DataFrame:
    """``(rank, gathered)`` of ``(rank, value)``: every rank receives all values, in order of rank (one per rank)."""
    gathered = values.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda m: m["value"]).alias("gathered"))
    return values.select("rank").crossJoin(F.broadcast(gathered))


def half_increment(vec: DataFrame, n: int) -> DataFrame:
    """Each of two ranks adds one to its half: every value grows by one, tagged with the rank that did it."""
    return vec.select("idx", (F.col("value") + 1).alias("value"), F.when(F.col("idx") < n // 2, 0).otherwise(1).alias("rank"))


def min_merge(tables: list[DataFrame], key: str, value: str) -> DataFrame:
    """The least value per key over several partial tables."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy(key).agg(F.min(value).alias(value))
