"""Indexed vectors ``(idx, value)``: reductions, prefix sums, ranks, sorting and merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.lineage import cut


def _range_of(column: Column, cuts: list[float]) -> Column:
    """How many of the ascending cuts are less than the value: a tree of comparisons, as deep as the logarithm of their number."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column > cuts[mid], tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(cuts))


def positions(rows: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """rows with their place (from 0) in order of columns that tell them apart.

    They are dealt into ranges of the whole order, so that rows of one value may fill many; each range starts after
    the rows of those before it (one row per range).
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part").orderBy(*order)
    numbered = dealt.withColumn("_at", F.row_number().over(within).cast("long") - 1).join(F.broadcast(starts), "_part")
    return numbered.withColumn(out, F.col("_start") + F.col("_at")).drop("_part", "_start", "_at")


def reduce(vec: DataFrame, how: str = "sum") -> DataFrame:
    """One row: sum, max or min of the values (partial sums per task, then one)."""
    return vec.agg(getattr(F, how)(F.col("value")).alias("value"))


def all_reduce(vec: DataFrame, rank: str, how: str = "sum") -> DataFrame:
    """``(rank, value)``: the reduction of all values, given to each rank."""
    return vec.select(rank).distinct().crossJoin(F.broadcast(reduce(vec, how)))


def prefix_sum(vec: DataFrame, inclusive: bool = True, ranges: int | None = None) -> DataFrame:
    """``(idx, value, prefix)`` in order of idx (unique), without sorting the table in one task.

    Rows are cut into ranges of idx by quantiles; each range is summed up by itself and starts after the sums of the
    ranges before it (one row per range).
    """
    n = ranges or int(vec.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(vec.stat.approxQuantile("idx", [k / n for k in range(1, n)], 0.01))) if n > 1 else []
    part = _range_of(F.col("idx"), cuts)
    dealt = vec.select("idx", "value").withColumn("_part", part)
    sums = dealt.groupBy("_part").agg(F.sum("value").alias("_sum"))
    # one row per range, a bounded number
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return dealt.withColumn("_own", F.coalesce(F.sum("value").over(within), F.lit(0))).join(F.broadcast(starts), "_part").select("idx", "value", (F.col("_start") + F.col("_own")).alias("prefix"))


def prefix_sum_simple(vec: DataFrame) -> DataFrame:
    """The same in a single window: one task; for small tables and as a check."""
    return vec.select("idx", "value", F.sum("value").over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)).alias("prefix"))


def displacements(counts: DataFrame) -> DataFrame:
    """Exclusive starts of consecutive blocks of given counts."""
    return prefix_sum(counts, inclusive=False)


def _smaller(vec: DataFrame) -> DataFrame:
    """``(value, smaller)``: how many rows have a smaller value; a prefix sum over the counts of distinct values."""
    counts = vec.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return prefix_sum(counts.select(F.col("value").alias("idx"), F.col("n").alias("value")), inclusive=False).select(F.col("idx").alias("value"), F.col("prefix").alias("smaller"))


def rank_sort(vec: DataFrame) -> DataFrame:
    """``(idx, value, smaller, position)``: position is the row's place in a stable ascending sort."""
    placed = positions(vec.select("idx", "value"), ["value", "idx"], "position")
    # written, so that the join can split the rows of a frequent value
    return placed.join(cut(_smaller(vec), "smaller"), "value").select("idx", "value", "smaller", "position")


def stable_sort(vec: DataFrame) -> DataFrame:
    """Rows in order of value, then idx: one range exchange, then a sort within each task."""
    return vec.orderBy("value", "idx")


def range_sort(vec: DataFrame, parts: int) -> DataFrame:
    return vec.repartitionByRange(parts, "value", "idx").sortWithinPartitions("value", "idx")


def merge_sorted(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(position, value, source, idx)``: the merge of two sorted lists; equal values keep a before b, and all stay."""
    both = a.select("idx", "value", F.lit(0).alias("source")).unionByName(b.select("idx", "value", F.lit(1).alias("source")))
    return positions(both, ["value", "source", "idx"], "position").select("position", "value", "source", "idx")


def insertion_points(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(idx, value, below)``: for each row of a, how many rows of b are smaller (a running count over both)."""
    tagged = a.select("value", F.lit(0).cast("long").alias("n")).unionByName(b.select("value", F.lit(1).cast("long").alias("n")))
    per_value = tagged.groupBy("value").agg(F.sum("n").alias("n"))
    below = prefix_sum(per_value.select(F.col("value").alias("idx"), F.col("n").alias("value")), inclusive=False)
    return a.join(below.select(F.col("idx").alias("value"), F.col("prefix").alias("below")), "value").select("idx", "value", "below")


def is_sorted(vec: DataFrame, by: str = "idx", column: str = "value") -> DataFrame:
    """One row: whether ``column`` never falls in order of ``by``. Each range is checked by itself, then the seams."""
    n = int(vec.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(vec.stat.approxQuantile(by, [k / n for k in range(1, n)], 0.01))) if n > 1 else []
    part = _range_of(F.col(by), cuts)
    before = F.lag(column).over(Window.partitionBy("_part").orderBy(by))
    ranges = vec.withColumn("_part", part).withColumn("_ok", F.coalesce(before <= F.col(column), F.lit(True)))
    per = ranges.groupBy("_part").agg(F.bool_and("_ok").alias("ok"), F.min_by(column, by).alias("first"), F.max_by(column, by).alias("last"))
    seam = F.coalesce(F.lag("last").over(Window.orderBy("_part")) <= F.col("first"), F.lit(True))
    return per.withColumn("seam", seam).agg(F.coalesce(F.bool_and(F.col("ok") & F.col("seam")), F.lit(True)).alias("sorted"))


def preview(vec: DataFrame, n: int = 10) -> DataFrame:
    return vec.orderBy("idx").limit(n)


def threshold_pick(weights: DataFrame, share: float) -> DataFrame:
    """The first row (by idx) at which the running sum of weights reaches ``share`` of the total."""
    run = cut(prefix_sum(weights), "running")
    total = run.agg(F.sum("value").alias("total"))
    return run.crossJoin(F.broadcast(total)).where(F.col("prefix") >= F.lit(share) * F.col("total")).orderBy("idx").limit(1).select("idx", "value", "prefix")
