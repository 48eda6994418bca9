"""Graphs as edge tables ``(src, dst, weight)``: shapes, breadth-first levels, shortest paths, result comparison.

Unreachable vertices have no row in a level or distance table and NULL in dense output. The iterative operators run one
join, one minimum per vertex and one write to the shared folder per round; the edges are written once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.lineage import cut, cut_watched, discard

# ---- shapes


def undirect(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
    return edges.unionByName(back)


def collapse(edges: DataFrame) -> DataFrame:
    """One edge per ordered pair, the lightest."""
    return edges.groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def reject_edges(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(edges whose ends lie in 0..n-1, the others)."""
    good = F.col("src").between(0, n - 1) & F.col("dst").between(0, n - 1)
    return edges.where(good), edges.where(~good)


def edge_class(weight: Column, delta: float) -> Column:
    """light up to delta, heavy beyond."""
    return F.when(weight <= delta, "light").otherwise("heavy")


def bucket(dist: Column, delta: float) -> Column:
    return F.floor(dist / F.lit(delta)).cast("long")


def adjacency(edges: DataFrame) -> DataFrame:
    """``(src, neighbours)``: sorted distinct neighbours. For graphs whose vertices have bounded degree."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


def weighted_adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "weight"))).alias("neighbours"))


def adjacency_matrix(edges: DataFrame, n: int) -> DataFrame:
    """The 0/1 matrix of a tiny graph, one column per vertex."""
    return edges.groupBy("src").pivot("dst", list(range(n))).agg(F.lit(1)).na.fill(0).orderBy("src")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("vertex")).agg(F.count(F.lit(1)).alias("degree"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row: vertices, directed edges, degree and weight ranges, density."""
    d = degrees(edges).agg(F.count(F.lit(1)).alias("vertices"), F.sum("degree").alias("edges"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.round(F.avg("degree"), 6).alias("avg_degree"))
    w = edges.agg(F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"), F.round(F.avg("weight"), 6).alias("avg_weight"))
    return d.crossJoin(w).withColumn("density", F.round(F.col("edges") / (F.col("vertices") * (F.col("vertices") - 1)), 9))


# ---- iteration

#: Levels that a search reads as tables of their own.
TABLES = 8


def _checked(edges: DataFrame) -> DataFrame:
    typed = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("long").alias("weight"))
    edges, seen = cut_watched(typed, "edges", least=F.min("weight"))
    if seen["least"] is not None and seen["least"] < 0:
        raise ValueError("weights must not be negative")
    return edges


def _start(edges: DataFrame, source: int, name: str) -> DataFrame:
    spark = edges.sparkSession
    return spark.range(1).select(F.lit(source).cast("long").alias("vertex"), F.lit(0).cast("long").alias(name))


def bfs_levels(edges: DataFrame, source: int) -> DataFrame:
    """``(vertex, level)`` of every vertex that can be reached: frontier, neighbours, minus the visited."""
    pairs = cut(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst").distinct(), "pairs")
    frontier = cut(_start(pairs, source, "level"), "bfs")
    levels, level = [frontier], 0
    while True:
        level += 1
        visited = reduce(DataFrame.unionByName, levels)
        if len(levels) > TABLES:
            # few tables however deep the graph: each is written again once in so many levels
            visited = cut(visited, "bfs")
            levels = [visited]
        reached = frontier.join(pairs, frontier.vertex == pairs.src).select(F.col("dst").alias("vertex")).distinct()
        frontier, seen = cut_watched(reached.join(visited, "vertex", "left_anti").withColumn("level", F.lit(level).cast("long")), "bfs", n=F.count(F.lit(1)))
        if not seen["n"]:
            return visited
        levels.append(frontier)


def _relax(dist: DataFrame, frontier: DataFrame, edges: DataFrame, **watch: Column) -> tuple[DataFrame, dict]:
    """``(vertex, dist, improved)`` after offering the frontier's distances along the edges, and the watched aggregates."""
    offers = frontier.select("vertex", "dist").join(edges, F.col("vertex") == F.col("src")).select(F.col("dst").alias("vertex"), (F.col("dist") + F.col("weight")).alias("offer")).groupBy("vertex").agg(F.min("offer").alias("offer"))
    joined = dist.select("vertex", "dist").join(offers, "vertex", "full_outer")
    better = F.col("offer").isNotNull() & (F.col("dist").isNull() | (F.col("offer") < F.col("dist")))
    out = cut_watched(joined.select("vertex", F.when(better, F.col("offer")).otherwise(F.col("dist")).alias("dist"), better.alias("improved")), "dist", **watch)
    discard(dist)
    return out


def sssp(edges: DataFrame, source: int, delta: int | None = None) -> DataFrame:
    """``(vertex, dist)`` of every vertex that can be reached.

    Without delta every improved vertex offers its distance in the next round. With delta, vertices wait in buckets of
    that width: light edges of the least bucket are relaxed until it is stable, then its heavy edges once. The result
    does not depend on delta.
    """
    if delta is not None and delta <= 0:
        raise ValueError("delta must be positive")
    edges = _checked(edges)
    dist = _start(edges, source, "dist").withColumn("improved", F.lit(True))
    n_of = lambda condition: F.count(F.when(condition, 1))
    if delta is None:
        seen = {"n": 1}
        while seen["n"]:
            dist, seen = _relax(dist, dist.where("improved"), edges, n=n_of(F.col("improved")))
        return dist.select("vertex", "dist")
    light, heavy = edges.where(F.col("weight") <= delta), edges.where(F.col("weight") > delta)
    place = bucket(F.col("dist"), delta)
    now = 0
    while now is not None:
        inside = place == now
        dist, seen = _relax(dist, dist.where(inside), light, n=n_of(inside & F.col("improved")))
        while seen["n"]:
            dist, seen = _relax(dist, dist.where(inside & F.col("improved")), light, n=n_of(inside & F.col("improved")))
        dist, seen = _relax(dist, dist.where(inside), heavy, then=F.min(F.when(place > now, place)))
        now = seen["then"]
    return dist.select("vertex", "dist")


# ---- results


def dense(dist: DataFrame, max_id: int, value: str = "dist") -> DataFrame:
    """All vertices 0..max_id; NULL where there is no value."""
    return dist.sparkSession.range(max_id + 1).withColumnRenamed("id", "vertex").join(dist.select("vertex", value), "vertex", "left")


def render(dist: DataFrame, value: str = "dist") -> DataFrame:
    """``(vertex, line)``: ``To v: d``, or INF."""
    return dist.select("vertex", F.format_string("To %d: %s", F.col("vertex"), F.coalesce(F.col(value).cast("string"), F.lit("INF"))).alias("line"))


def diff_distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(vertex, a, b, kind)`` where two distance tables disagree: missing in b, extra in b, or mismatch."""
    left, right = a.select("vertex", F.col("dist").alias("a"), F.lit(True).alias("in_a")), b.select("vertex", F.col("dist").alias("b"), F.lit(True).alias("in_b"))
    kind = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").when(~F.col("a").eqNullSafe(F.col("b")), "mismatch")
    return left.join(right, "vertex", "full_outer").select("vertex", "a", "b", kind.alias("kind")).where("kind is not null")


def work_counts(edges: DataFrame, dist: DataFrame, delta: int) -> DataFrame:
    """One row: buckets that hold vertices, vertices, light and heavy edges that leave them."""
    classed = dist.join(edges, dist.vertex == edges.src).agg(F.sum((F.col("weight") <= delta).cast("long")).alias("light"), F.sum((F.col("weight") > delta).cast("long")).alias("heavy"))
    return dist.agg(F.countDistinct(bucket(F.col("dist"), delta)).alias("buckets"), F.count(F.lit(1)).alias("vertices")).crossJoin(classed)


# ---- generators


def random_graph(spark, n: int, probability: float, seed: int = 42) -> DataFrame:
    """G(n, p) with u < v and weights 1..100: every pair is decided by a hash, so the graph does not depend on partitioning.

    All pairs are the feature here; the ids are generated, not read.
    """
    ids = spark.range(n)
    pairs = ids.select(F.col("id").alias("src")).select("src", F.explode(F.sequence(F.col("src") + 1, F.greatest(F.lit(n - 1), F.col("src") + 1))).alias("dst")).where(F.col("dst") < n)
    unit = F.shiftrightunsigned(F.xxhash64("src", "dst", F.lit(seed)), 11) / F.lit(float(1 << 53))
    return pairs.where(unit < probability).withColumn("weight", F.pmod(F.xxhash64("dst", "src", F.lit(seed + 1)), F.lit(100)) + 1)
