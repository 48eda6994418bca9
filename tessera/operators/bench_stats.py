"""Statistics of benchmark runs: reshaping, speedups, efficiency, variation, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Published seconds of a shortest-path run by bucket width (first column) and process count.
PROCS = [1, 2, 4, 8, 16, 32, 64]
GRID = [
    (1, 4.503, 3.515, 3.100, 3.026, 2.939, 3.467, 8.079),
    (5, 4.536, 3.523, 3.091, 2.825, 2.947, 3.399, 8.108),
    (10, 4.530, 3.631, 3.090, 2.908, 3.053, 3.412, 7.903),
    (20, 4.507, 3.536, 3.042, 2.892, 2.990, 3.421, 8.117),
    (30, 4.493, 3.619, 3.121, 2.942, 2.983, 3.434, 7.930),
    (40, 4.500, 3.525, 3.120, 2.938, 2.973, 3.490, 8.353),
    (50, 4.504, 3.538, 3.186, 2.965, 3.000, 3.420, 7.992),
    (60, 4.507, 3.516, 3.185, 2.928, 2.916, 3.583, 8.651),
    (70, 4.498, 3.455, 3.096, 2.877, 2.971, 3.563, 8.428),
    (80, 4.536, 3.459, 3.064, 3.042, 2.922, 4.855, 8.156),
    (90, 4.505, 3.440, 3.259, 3.032, 2.945, 3.570, 8.059),
    (100, 4.511, 3.543, 3.148, 2.955, 2.964, 3.376, 8.425),
]


def wide_grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GRID, "delta int, " + ", ".join(f"p{p} double" for p in PROCS))


def melt(wide: DataFrame, key: str = "delta") -> DataFrame:
    """``(delta, p, seconds)`` of columns p1, p2, ..."""
    long = wide.unpivot([key], [c for c in wide.columns if c != key], "name", "seconds")
    return long.select(key, F.substring("name", 2, 9).cast("int").alias("p"), "seconds")


def speedups(long: DataFrame) -> DataFrame:
    """speedup and efficiency against the least p of each delta."""
    first = F.first("seconds").over(Window.partitionBy("delta").orderBy("p"))
    return long.withColumn("speedup", first / F.col("seconds")).withColumn("efficiency", F.col("speedup") / F.col("p"))


def overhead(long: DataFrame) -> DataFrame:
    """Time spent beyond one process's: p * seconds minus the seconds of the least p."""
    first = F.first("seconds").over(Window.partitionBy("delta").orderBy("p"))
    return long.withColumn("overhead", F.col("seconds") * F.col("p") - first)


def best_p(long: DataFrame) -> DataFrame:
    """The fastest p of each delta, the smaller on ties."""
    return long.groupBy("delta").agg(F.min(F.struct("seconds", "p")).alias("b")).select("delta", "b.p", "b.seconds")


def variation(long: DataFrame) -> DataFrame:
    """Mean, sample deviation, coefficient of variation (percent) and quartiles of each p."""
    out = long.groupBy("p").agg(F.avg("seconds").alias("mean"), F.stddev_samp("seconds").alias("std"), F.percentile("seconds", F.lit(0.25)).alias("q1"), F.percentile("seconds", F.lit(0.5)).alias("median"), F.percentile("seconds", F.lit(0.75)).alias("q3"))
    return out.withColumn("cv", F.col("std") / F.col("mean") * 100)


def improvement(long: DataFrame) -> DataFrame:
    """``(p, next_p, improvement)``: mean percentage saved from each p to the next."""
    order = Window.partitionBy("delta").orderBy("p")
    steps = long.withColumn("next_p", F.lead("p").over(order)).withColumn("then", F.lead("seconds").over(order)).where("next_p is not null")
    return steps.groupBy("p", "next_p").agg(F.avg((F.col("seconds") - F.col("then")) / F.col("seconds") * 100).alias("improvement"))


def column_means(long: DataFrame) -> DataFrame:
    """Mean seconds per p, with the speedup and efficiency of the means."""
    means = long.groupBy("p").agg(F.avg("seconds").alias("seconds"))
    return speedups(means.withColumn("delta", F.lit(0))).drop("delta")


def share(part: str, whole: str):
    """A percentage, as for transfer overheads."""
    return F.col(part) / F.col(whole) * 100


def stage_speedups(timings: DataFrame, base: str) -> DataFrame:
    """``(size, stage, impl, seconds)`` with the speedup against implementation ``base``."""
    b = timings.where(F.col("impl") == base).select("size", "stage", F.col("seconds").alias("_base"))
    return timings.join(b, ["size", "stage"]).withColumn("speedup", F.col("_base") / F.col("seconds")).drop("_base")


def overlay(traces: dict[str, DataFrame]) -> DataFrame:
    """Convergence curves of several implementations side by side: iteration and one column each."""
    both = None
    for name, t in traces.items():
        one = t.select("iteration", F.lit(name).alias("impl"), "log_likelihood")
        both = one if both is None else both.unionByName(one)
    return both.groupBy("iteration").pivot("impl", list(traces)).agg(F.first("log_likelihood"))


def derived_metrics(runs: DataFrame) -> DataFrame:
    """runs(edges, relaxations, buckets, vertices, seconds, processes, base_seconds) with rates and ratios."""
    return runs.select(
        "*",
        (F.col("edges") / F.col("seconds")).alias("edges_per_second"),
        (F.col("relaxations") / F.col("edges")).alias("intensity"),
        (F.col("vertices") / F.col("buckets")).alias("compression"),
        (F.col("base_seconds") / F.col("seconds")).alias("speedup"),
        (F.col("base_seconds") / F.col("seconds") / F.col("processes")).alias("efficiency"),
    )


def deltas(trace: DataFrame, value: str = "log_likelihood") -> DataFrame:
    """The change from one iteration to the next. A trace is one small table (an entry per round)."""
    return trace.withColumn("delta", F.col(value) - F.lag(value).over(Window.orderBy("iteration")))


def streak(trace: DataFrame, tolerance: float, patience: int = 3) -> DataFrame:
    """Whether the last ``patience`` changes were all below the tolerance."""
    small = F.coalesce((F.abs(F.col("delta")) < tolerance).cast("int"), F.lit(0))
    window = Window.orderBy("iteration").rowsBetween(-(patience - 1), 0)
    return deltas(trace).withColumn("converged", F.sum(small).over(window) == patience)


def histogram(values: DataFrame, column: str, bins: int) -> DataFrame:
    """``(bin, low, n, density)`` of equal-width bins, the last one closed on the right; empty bins included."""
    ends = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    counts = values.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = values.sparkSession.range(bins).withColumnRenamed("id", "bin").crossJoin(F.broadcast(ends))
    n = F.coalesce("n", F.lit(0))
    return frame.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), n.alias("n"), F.when(width > 0, n / (F.col("total") * width)).alias("density"))


def run_log(timings: DataFrame) -> DataFrame:
    """Slowest and mean rank of each run of ``(procs, run, rank, seconds)``."""
    return timings.groupBy("procs", "run").agg(F.max("seconds").alias("slowest"), F.avg("seconds").alias("mean"))


def compare_timings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two reports ``(stage, seconds)`` side by side: ``(stage, a, b, speedup)``, null where one lacks the stage."""
    both = a.select("stage", F.col("seconds").alias("a")).join(b.select("stage", F.col("seconds").alias("b")), "stage", "full_outer")
    return both.withColumn("speedup", F.when(F.col("b") > 0, F.col("a") / F.col("b")))


def timing_summary(timings: DataFrame) -> DataFrame:
    """Totals, means and shares of ``(stage, seq, seconds)``."""
    total = timings.agg(F.sum("seconds").alias("_all"))
    per = timings.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("total"), F.avg("seconds").alias("mean"))
    return per.crossJoin(F.broadcast(total)).select("stage", "n", "total", "mean", (F.col("total") / F.col("_all") * 100).alias("pct"))
