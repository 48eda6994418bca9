"""The queries of the reference's operators on the driver's tables, with the DuckDB SQL that says the same.

Doubles are rounded (6 digits, log likelihoods 4), counts are long, on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.gaussian import normal_logpdf, normal_pdf
from tessera.lineage import scratch_dir
from tessera.operators import bench_stats, evaluate, exchange, gmm, graph, linalg, scan
from tessera.plans import experiment, views
from tessera.plans.views import MAT_SQL, TRIPS_SQL, VEC_SQL
from tessera.sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c).cast("double"), digits).alias(c) if c in columns else F.col(c) for c in df.columns])


# ---- vectors


@query(f"WITH {VEC_SQL} SELECT a.idx, a.value + b.value AS value FROM vec a JOIN (SELECT idx, value * 3 AS value FROM vec) b USING (idx)")
def vec_add(spark, sf):
    v = views.vec(spark, sf)
    return linalg.vec_add(v, v.select("idx", (F.col("value") * 3).alias("value")))


@query(f"WITH {VEC_SQL} SELECT idx, idx % 16 AS x, (idx // 16) % 8 AS y, idx // 128 AS z, (idx % 16) + ((idx // 16) % 8) * 16 + (idx // 128) * 128 AS linear, value + idx AS value FROM vec")
def vec_add_3d_index(spark, sf):
    x, y, z = linalg.grid_place(F.col("idx"), 16, 8)
    v = views.vec(spark, sf).select("idx", x.alias("x"), y.alias("y"), z.alias("z"), "value")
    return v.select("idx", "x", "y", "z", linalg.grid_index(F.col("x"), F.col("y"), F.col("z"), 16, 8).alias("linear"), (F.col("value") + F.col("idx")).alias("value"))


@query("SELECT vec_id AS id, list_transform(range(1, 65), lambda i: round(CAST(embedding[i] AS DOUBLE) + CAST(embedding[65 - i] AS DOUBLE), 6))[7] AS seventh, round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) + CAST(embedding[65 - i] AS DOUBLE))), 6) AS total FROM embeddings")
def array_add(spark, sf):
    p = views.points(spark, sf, 64).withColumn("s", linalg.array_add(F.col("features"), F.reverse("features")))
    return p.select("id", F.round(F.get("s", 6), 6).alias("seventh"), F.round(F.aggregate("s", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query(f"WITH {VEC_SQL} SELECT CAST(sum(value) AS BIGINT) AS value FROM vec")
def reduce_sum(spark, sf):
    return scan.reduce(views.vec(spark, sf), "sum")


@query(f"WITH {VEC_SQL} SELECT max(value) AS value FROM vec")
def reduce_max(spark, sf):
    return scan.reduce(views.vec(spark, sf), "max")


@query(f"WITH {VEC_SQL} SELECT DISTINCT idx % 8 AS rank, (SELECT CAST(sum(value) AS BIGINT) FROM vec) AS value FROM vec")
def allreduce_sum(spark, sf):
    return scan.all_reduce(views.vec(spark, sf).withColumn("rank", F.pmod("idx", F.lit(8))), "rank")


@query(f"WITH {VEC_SQL} SELECT idx, value, CAST(sum(value) OVER (ORDER BY idx) AS BIGINT) AS prefix FROM vec")
def prefix_sum_inclusive(spark, sf):
    return scan.prefix_sum(views.vec(spark, sf))


@query(f"WITH {VEC_SQL} SELECT idx, value, CAST(coalesce(sum(value) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prefix FROM vec")
def prefix_sum_exclusive(spark, sf):
    return scan.prefix_sum(views.vec(spark, sf), inclusive=False)


@query("WITH c AS (SELECT user_id AS idx, count(*) AS value FROM events GROUP BY 1) SELECT idx, value, CAST(coalesce(sum(value) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prefix FROM c")
def displacements(spark, sf):
    return scan.displacements(views.table(spark, sf, "events").groupBy(F.col("user_id").alias("idx")).agg(F.count(F.lit(1)).alias("value")))


@query(f"WITH {VEC_SQL} SELECT idx, value, rank() OVER (ORDER BY value) - 1 AS smaller, row_number() OVER (ORDER BY value, idx) - 1 AS position FROM vec")
def rank_sort(spark, sf):
    return scan.rank_sort(views.vec(spark, sf))


@query(f"WITH {VEC_SQL} SELECT idx, value FROM vec ORDER BY value, idx")
def merge_sort(spark, sf):
    return scan.stable_sort(views.vec(spark, sf))


@query(f"WITH {VEC_SQL}, s AS (SELECT value, idx, idx % 2 AS source FROM vec) SELECT row_number() OVER (ORDER BY value, source, idx) - 1 AS position, value, CAST(source AS INT) AS source, idx FROM s")
def merge_sorted_lists(spark, sf):
    v = views.vec(spark, sf)
    return scan.merge_sorted(v.where("idx % 2 = 0"), v.where("idx % 2 = 1"))


@query(f"WITH {VEC_SQL}, b AS (SELECT value FROM vec WHERE idx % 2 = 1), c AS (SELECT value, count(*) AS n FROM b GROUP BY 1), v AS (SELECT DISTINCT value FROM vec), r AS (SELECT v.value, CAST(coalesce(sum(c.n) OVER (ORDER BY v.value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS below FROM v LEFT JOIN c USING (value)) SELECT idx, value, below FROM vec JOIN r USING (value) WHERE idx % 2 = 0")
def insertion_points(spark, sf):
    v = views.vec(spark, sf)
    return scan.insertion_points(v.where("idx % 2 = 0"), v.where("idx % 2 = 1"))


@query("SELECT true AS by_key, (SELECT bool_and(ok) FROM (SELECT coalesce(lag(round(value * 100)) OVER (ORDER BY event_id) <= round(value * 100), true) AS ok FROM events)) AS by_value")
def sorted_check(spark, sf):
    v = views.vec(spark, sf)
    keys = scan.is_sorted(v.select("idx", F.col("idx").alias("value"))).withColumnRenamed("sorted", "by_key")
    return keys.crossJoin(scan.is_sorted(v).withColumnRenamed("sorted", "by_value"))


@query(f"WITH {VEC_SQL} SELECT idx, value FROM vec ORDER BY idx LIMIT 10")
def top10_preview(spark, sf):
    return scan.preview(views.vec(spark, sf))


@query(f"WITH {VEC_SQL}, r AS (SELECT idx, value, CAST(sum(value) OVER (ORDER BY idx) AS BIGINT) AS prefix FROM vec) SELECT idx, value, prefix FROM r WHERE prefix >= 0.37 * (SELECT sum(value) FROM vec) ORDER BY idx LIMIT 1")
def kmeanspp_threshold_pick(spark, sf):
    return scan.threshold_pick(views.vec(spark, sf), 0.37)


# ---- matrices


@query(f"WITH {MAT_SQL} SELECT i, CAST(sum(v * (j + 1)) AS BIGINT) AS v FROM mat GROUP BY 1")
def matvec(spark, sf):
    return linalg.matvec(views.mat(spark, sf), spark.range(50).select(F.col("id").alias("idx"), (F.col("id") + 1).alias("value")))


@query(f"WITH {MAT_SQL} SELECT a.j AS i, b.j AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM mat a JOIN mat b ON a.i = b.i GROUP BY 1, 2")
def matmul(spark, sf):
    m = views.mat(spark, sf)
    return linalg.matmul(linalg.transpose(m), m)


@query(f"WITH {MAT_SQL}, r AS (SELECT i, j, v FROM mat) SELECT i, CAST(j AS INT) AS j, v FROM r UNION ALL SELECT i.i, CAST(j.j AS INT), 0 FROM (SELECT DISTINCT i FROM r) i, (SELECT unnest(range(0, 50)) AS j) j WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.i = i.i AND r.j = j.j)")
def matrix_rows_roundtrip(spark, sf):
    return linalg.from_rows(linalg.to_rows(views.mat(spark, sf), 50))


# ---- graph shapes and exchanges


@query(f"WITH {TRIPS_SQL} SELECT s AS src, t AS dst, w AS weight FROM e")
def edge_undirect(spark, sf):
    return graph.undirect(views.trips(spark, sf))


@query(f"WITH {TRIPS_SQL} SELECT s AS src, string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) AS neighbours FROM (SELECT DISTINCT s, t FROM e) GROUP BY 1")
def adjacency_list(spark, sf):
    a = graph.adjacency(graph.undirect(views.trips(spark, sf)))
    return a.select("src", F.concat_ws(",", F.transform("neighbours", lambda v: v.cast("string"))).alias("neighbours"))


@query(f"WITH {TRIPS_SQL}, g AS (SELECT s, count(*) AS n FROM e GROUP BY 1), a AS (SELECT count(*) AS vertices, CAST(sum(n) AS BIGINT) AS edges, min(n) AS min_degree, max(n) AS max_degree, round(avg(n), 6) AS avg_degree FROM g), b AS (SELECT min(w) AS min_weight, max(w) AS max_weight, round(avg(w), 6) AS avg_weight FROM e) SELECT *, round(edges / (vertices * (vertices - 1)), 9) AS density FROM a, b")
def degree_stats(spark, sf):
    return graph.graph_stats(graph.undirect(views.trips(spark, sf)))


@query(f"WITH {TRIPS_SQL} SELECT CASE WHEN w <= 20 THEN 'light' ELSE 'heavy' END AS class, count(*) AS n FROM e GROUP BY 1")
def edge_class_counts(spark, sf):
    e = graph.undirect(views.trips(spark, sf))
    return e.groupBy(graph.edge_class(F.col("weight"), 20).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TRIPS_SQL} SELECT s BETWEEN 0 AND 1000049 AND t BETWEEN 0 AND 1000049 AS kept, count(*) AS n FROM e GROUP BY 1")
def edge_reject_filter(spark, sf):
    good, bad = graph.reject_edges(graph.undirect(views.trips(spark, sf)), 1_000_050)
    count = lambda df, kept: df.groupBy(F.lit(kept).alias("kept")).agg(F.count(F.lit(1)).alias("n"))
    return count(good, True).unionByName(count(bad, False))


@query("SELECT o_custkey AS src, min(o_orderkey) AS dst, CAST(count(*) AS BIGINT) AS copies FROM orders GROUP BY o_custkey, o_orderkey % 3")
def duplicate_edge_collapse(spark, sf):
    o = views.table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), F.pmod("o_orderkey", F.lit(3)).alias("k"), F.col("o_orderkey").alias("weight"))
    n = o.groupBy("src", "k").agg(F.count(F.lit(1)).alias("copies"))
    least = graph.collapse(o.withColumnRenamed("k", "dst")).withColumnRenamed("dst", "k")
    return least.join(n, ["src", "k"]).select("src", F.col("weight").alias("dst"), "copies")


@query("SELECT c_custkey % 7 AS owner, count(*) AS n FROM customer GROUP BY 1")
def partition_mod_counts(spark, sf):
    return exchange.distribution(views.table(spark, sf, "customer"), exchange.owner_mod(F.col("c_custkey"), 7))


@query("SELECT c_custkey AS v, CASE WHEN c_custkey < (200000 % 7) * (200000 // 7 + 1) THEN c_custkey // (200000 // 7 + 1) ELSE (c_custkey - (200000 % 7) * (200000 // 7 + 1)) // (200000 // 7) + 200000 % 7 END AS block, c_custkey // ((200000 + 6) // 7) AS ceil_block FROM customer")
def partition_block_owner(spark, sf):
    c = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("v"))
    return c.select("v", exchange.owner_block(F.col("v"), 200_000, 7).alias("block"), exchange.owner_ceil_block(F.col("v"), 200_000, 7).alias("ceil_block"))


@query("WITH m AS (SELECT r.n_nationkey AS src, c.n_nationkey AS dst, r.n_nationkey * 10 + c.n_nationkey AS value FROM nation r JOIN nation c ON r.n_regionkey = c.n_regionkey) SELECT CAST(dst AS BIGINT) AS dst, string_agg(CAST(value AS VARCHAR), ',' ORDER BY src) AS received FROM m GROUP BY 1")
def alltoall_transpose(spark, sf):
    n = views.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    m = n.select(F.col("n_nationkey").cast("long").alias("src"), "n_regionkey").join(n.select(F.col("n_nationkey").cast("long").alias("dst"), "n_regionkey"), "n_regionkey")
    out = exchange.all_to_all(m.select("src", "dst", (F.col("src") * 10 + F.col("dst")).alias("value")))
    return out.select("dst", F.concat_ws(",", F.transform("received", lambda v: v.cast("string"))).alias("received"))


@query("SELECT n_nationkey AS rank, (SELECT string_agg(n_name, ',' ORDER BY n_nationkey) FROM nation) AS gathered FROM nation")
def allgather(spark, sf):
    out = exchange.all_gather(views.table(spark, sf, "nation").select(F.col("n_nationkey").alias("rank"), F.col("n_name").alias("value")))
    return out.select("rank", F.concat_ws(",", "gathered").alias("gathered"))


@query(f"WITH {VEC_SQL}, n AS (SELECT count(*) AS n FROM vec) SELECT idx, value + 1 AS value, CASE WHEN idx < n // 2 THEN 0 ELSE 1 END AS rank FROM vec, n")
def half_increment(spark, sf):
    v = views.vec(spark, sf)
    return exchange.half_increment(v, v.count())


@query("SELECT k, min(v) AS v FROM (SELECT o_custkey AS k, o_orderkey AS v FROM orders UNION ALL SELECT c_custkey, 1000 FROM customer) GROUP BY 1")
def min_merge(spark, sf):
    a = views.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    b = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit(1000).cast("long").alias("v"))
    return exchange.min_merge([a, b], "k", "v")


# ---- levels and distances

_SSSP = """sp(v, d) USING KEY (v) AS (
  SELECT (SELECT min(s) FROM e) AS v, CAST(0 AS BIGINT) AS d
  UNION
  SELECT e.t, min(sp.d + {w}) FROM sp JOIN e ON sp.v = e.s LEFT JOIN recurring.sp r ON r.v = e.t
  WHERE r.d IS NULL OR sp.d + {w} < r.d GROUP BY e.t)"""
_BFS_SQL = f"WITH RECURSIVE {TRIPS_SQL}, {_SSSP.format(w='1')}"
_SSSP_SQL = f"WITH RECURSIVE {TRIPS_SQL}, {_SSSP.format(w='e.w')}"


def _graph(spark, sf) -> tuple[DataFrame, int]:
    e = graph.undirect(views.trips(spark, sf))
    return e, e.agg(F.min("src")).first()[0]


@query(f"{_BFS_SQL} SELECT v AS vertex, d AS level FROM sp")
def bfs_levels(spark, sf):
    return graph.bfs_levels(*_graph(spark, sf))


@query(f"{_BFS_SQL} SELECT d AS level, count(*) AS n FROM sp GROUP BY 1")
def bfs_level_histogram(spark, sf):
    return graph.bfs_levels(*_graph(spark, sf)).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_SSSP_SQL} SELECT v AS vertex, d AS dist FROM sp")
def sssp_distances(spark, sf):
    return graph.sssp(*_graph(spark, sf))


@query(f"{_SSSP_SQL} SELECT v AS vertex, d AS dist FROM sp")
def sssp_delta_stepping(spark, sf):
    return graph.sssp(*_graph(spark, sf), delta=50)


_DIRECTED_SQL = f"WITH RECURSIVE {TRIPS_SQL}, f AS (SELECT s, t, w FROM d UNION ALL SELECT t, s + 1, w FROM d), {_SSSP.format(w='f.w').replace(' e ', ' f ').replace('e.', 'f.').replace('FROM e)', 'FROM f)')}"


@query(f"{_DIRECTED_SQL} SELECT v AS vertex, d AS dist FROM sp")
def sssp_directed(spark, sf):
    t = views.trips(spark, sf)
    e = t.unionByName(t.select(F.col("dst").alias("src"), (F.col("src") + 1).alias("dst"), "weight"))
    return graph.sssp(e, e.agg(F.min("src")).first()[0])


@query(f"{_SSSP_SQL} SELECT d // 20 AS bucket, count(*) AS n FROM sp GROUP BY 1")
def sssp_bucket_histogram(spark, sf):
    return graph.sssp(*_graph(spark, sf)).groupBy(graph.bucket(F.col("dist"), 20).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_SSSP_SQL} SELECT g.i AS vertex, 'To ' || g.i || ': ' || coalesce(CAST(sp.d AS VARCHAR), 'INF') AS line FROM (SELECT unnest(range(0, (SELECT max(s) + 1 FROM e WHERE s < 1000000))) AS i) g LEFT JOIN sp ON sp.v = g.i")
def sssp_inf_render(spark, sf):
    e, source = _graph(spark, sf)
    top = e.where("src < 1000000").agg(F.max("src")).first()[0]
    return graph.render(graph.dense(graph.sssp(e, source), top))


@query(f"{_SSSP_SQL}, c AS (SELECT count(DISTINCT d // 20) AS buckets, count(*) AS vertices FROM sp), k AS (SELECT CAST(sum(CASE WHEN w <= 20 THEN 1 ELSE 0 END) AS BIGINT) AS light, CAST(sum(CASE WHEN w > 20 THEN 1 ELSE 0 END) AS BIGINT) AS heavy FROM sp JOIN e ON e.s = sp.v) SELECT * FROM c, k")
def sssp_work_counts(spark, sf):
    e, source = _graph(spark, sf)
    return graph.work_counts(e, graph.sssp(e, source), 20)


@query("WITH a AS (SELECT o_custkey AS v, min(o_orderkey) AS d FROM orders GROUP BY 1), b AS (SELECT c_custkey AS v, c_custkey * 2 AS d FROM customer) SELECT coalesce(a.v, b.v) AS vertex, a.d AS a, b.d AS b, CASE WHEN b.v IS NULL THEN 'missing' WHEN a.v IS NULL THEN 'extra' ELSE 'mismatch' END AS kind FROM a FULL OUTER JOIN b ON a.v = b.v WHERE a.v IS NULL OR b.v IS NULL OR a.d IS DISTINCT FROM b.d")
def distance_diff(spark, sf):
    a = views.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("vertex")).agg(F.min("o_orderkey").alias("dist"))
    b = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("vertex"), (F.col("c_custkey") * 2).alias("dist"))
    return graph.diff_distances(a, b)


# ---- one-dimensional mixtures

_W, _M, _S = (0.5, 0.5), (20.0, 100.0), (20.0, 50.0)
_ROUNDS = 3


def _em1d_sql(tail: str) -> str:
    out = ["x AS (SELECT event_id AS id, value AS x FROM events)", f"p0 AS (SELECT * FROM (VALUES {', '.join(f'({k}, {w}::DOUBLE, {m}::DOUBLE, {s}::DOUBLE)' for k, (w, m, s) in enumerate(zip(_W, _M, _S, strict=True)))}) t(k, w, m, sd))"]
    dense = "w * exp(-0.5 * pow((x - m) / sd, 2)) / (sd * sqrt(2 * pi()))"
    for i in range(_ROUNDS):
        out.append(f"r{i} AS (SELECT id, x, k, {dense} / sum({dense}) OVER (PARTITION BY id) AS r FROM x, p{i})")
        out.append(f"m{i} AS (SELECT k, sum(r) AS nk, sum(r * x) / sum(r) AS m FROM r{i} GROUP BY k)")
        out.append(f"p{i + 1} AS (SELECT r.k, any_value(m.nk) / (SELECT count(*) FROM x) AS w, any_value(m.m) AS m, sqrt(sum(r.r * pow(r.x - m.m, 2)) / any_value(m.nk)) AS sd FROM r{i} r JOIN m{i} m ON r.k = m.k GROUP BY r.k)")
        out.append(f"l{i} AS (SELECT {i} AS iteration, sum(ln(f)) AS ll FROM (SELECT sum({dense}) AS f FROM x, p{i + 1} GROUP BY id))")
    return f"WITH {', '.join(out)} {tail}"


def _em1d(spark, sf):
    return gmm.fit_1d(views.points_1d(spark, sf), _W, _M, _S, _ROUNDS)


@query(_em1d_sql(f"SELECT k AS component, round(w, 6) AS weight, round(m, 6) AS mean, round(sd, 6) AS std FROM p{_ROUNDS}"))
def em1d_params(spark, sf):
    params, _ = _em1d(spark, sf)
    return rounded(spark.createDataFrame([(k, *p) for k, p in enumerate(params)], "component int, weight double, mean double, std double"), "weight", "mean", "std")


@query(_em1d_sql(" UNION ALL ".join(f"SELECT iteration, round(ll, 4) AS log_likelihood FROM l{i}" for i in range(_ROUNDS))))
def em1d_loglik(spark, sf):
    _, trace = _em1d(spark, sf)
    return rounded(spark.createDataFrame(list(enumerate(trace)), "iteration int, log_likelihood double"), "log_likelihood", digits=4)


@query("WITH g AS (SELECT unnest(range(0, 1000)) AS i), p AS (SELECT * FROM (VALUES (0.3::DOUBLE, 0::DOUBLE, 1::DOUBLE), (0.3, 5, 1), (0.3, 10, 1), (0.1, 3, 0.5)) t(w, m, sd)), x AS (SELECT i, -5 + i * (20::DOUBLE / 999) AS x FROM g) SELECT i, round(any_value(x), 6) AS x, round(sum(w * exp(-0.5 * pow((x - m) / sd, 2)) / (sd * sqrt(2 * pi()))), 6) AS density FROM x, p GROUP BY i")
def em1d_density(spark, sf):
    return rounded(gmm.density_grid(spark, [(0.3, 0, 1), (0.3, 5, 1), (0.3, 10, 1), (0.1, 3, 0.5)], -5, 15), "x", "density")


@query("SELECT event_id AS id, round(exp(-0.5 * pow((value - 50) / 45, 2)) / (45 * sqrt(2 * pi())), 9) AS pdf, round(-0.5 * pow((value - 50) / 45, 2) - ln(45 * sqrt(2 * pi())), 6) AS logpdf FROM events")
def normal_density(spark, sf):
    x = F.col("x")
    return views.points_1d(spark, sf).select("id", F.round(normal_pdf(x, 50, 45), 9).alias("pdf"), F.round(normal_logpdf(x, 50, 45), 6).alias("logpdf"))


# ---- mixtures in two dimensions against SQL, in more without

_MEANS = (-0.1, 0.0, 0.1)


def _start(d: int) -> gmm.Mixture:
    import numpy as np

    return gmm.Mixture.manual(np.array([[m] * d for m in _MEANS]), None, np.array([0.02 * np.eye(d)] * 3))


def _em2d_sql(rounds: int, tail: str) -> str:
    out = ["x AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings)", f"p0 AS (SELECT * FROM (VALUES {', '.join(f'({k}, {1 / 3!r}::DOUBLE, {m}::DOUBLE, {m}::DOUBLE, 0.02::DOUBLE, 0::DOUBLE, 0.02::DOUBLE)' for k, m in enumerate(_MEANS))}) t(k, w, mx, my, a, b, c))"]
    for i in range(rounds + 1):
        out.append(f"f{i} AS (SELECT id, x, y, k, w * exp(-0.5 * (c * pow(x - mx, 2) - 2 * b * (x - mx) * (y - my) + a * pow(y - my, 2)) / (a * c - b * b)) / (2 * pi() * sqrt(a * c - b * b)) AS f FROM x, p{i})")
        out.append(f"r{i} AS (SELECT id, x, y, k, f / sum(f) OVER (PARTITION BY id) AS r FROM f{i})")
        out.append(f"l{i} AS (SELECT {i} AS iteration, sum(ln(f)) AS ll FROM (SELECT sum(f) AS f FROM f{i} GROUP BY id))")
        out.append(f"m{i} AS (SELECT k, sum(r) AS nk, sum(r * x) / sum(r) AS mx, sum(r * y) / sum(r) AS my FROM r{i} GROUP BY k)")
        out.append(f"p{i + 1} AS (SELECT r.k, any_value(nk) / (SELECT count(*) FROM x) AS w, any_value(mx) AS mx, any_value(my) AS my, sum(r * pow(x - mx, 2)) / any_value(nk) + 1e-6 AS a, sum(r * (x - mx) * (y - my)) / any_value(nk) AS b, sum(r * pow(y - my, 2)) / any_value(nk) + 1e-6 AS c FROM r{i} r JOIN m{i} m ON r.k = m.k GROUP BY r.k)")
    return f"WITH {', '.join(out)} {tail}"


@query(_em2d_sql(0, "SELECT id, k AS component, round(r, 6) AS share FROM r0"))
def gmm_estep(spark, sf):
    r = gmm.responsibilities(views.points(spark, sf, 2), _start(2))
    return rounded(r.select("id", F.posexplode("resp").alias("component", "share")), "share")


@query(_em2d_sql(0, "SELECT k AS component, round(w, 6) AS weight, round(mx, 6) AS mean_x, round(my, 6) AS mean_y, round(a, 6) AS cov_xx, round(b, 6) AS cov_xy, round(c, 6) AS cov_yy FROM p1"))
def gmm_mstep(spark, sf):
    t = gmm.fit(views.points(spark, sf, 2), _start(2), 1).model.table(spark)
    out = t.select("component", "weight", F.get("mean", 0).alias("mean_x"), F.get("mean", 1).alias("mean_y"), F.expr("cov[0][0]").alias("cov_xx"), F.expr("cov[0][1]").alias("cov_xy"), F.expr("cov[1][1]").alias("cov_yy"))
    return rounded(out, *out.columns[1:])


@query(_em2d_sql(2, " UNION ALL ".join(f"SELECT iteration, round(ll, 4) AS log_likelihood FROM l{i}" for i in range(3))))
def gmm_loglik_trace(spark, sf):
    return rounded(gmm.fit(views.points(spark, sf, 2), _start(2), 3).trace_table(spark), "log_likelihood", digits=4)


@query(_em2d_sql(2, "SELECT id, CAST(arg_max(k, f) AS INT) AS pred FROM f2 GROUP BY id"))
def gmm_predict(spark, sf):
    p = views.points(spark, sf, 2)
    return gmm.predict(p, gmm.fit(p, _start(2), 2).model).select("id", "pred")


@query()
def gmm_fit_4d(spark, sf):
    return gmm.fit(views.points(spark, sf, 4), _start(4), 3).history_table(spark)


@query()
def gmm_fit_arrow_16d(spark, sf):
    return gmm.fit(views.points(spark, sf, 16), _start(16), 3).trace_table(spark)


@query()
def gmm_fit_best(spark, sf):
    return gmm.fit_best(views.points(spark, sf, 2), 3, 3, (1, 2)).trace_table(spark)


@query()
def gmm_init_plus_plus(spark, sf):
    return gmm.init_plus_plus(views.points(spark, sf, 4), 5, 7).table(spark)


@query("SELECT i.i - 1 AS i, j.j - 1 AS j, round(covar_samp(CAST(embedding[i.i] AS DOUBLE), CAST(embedding[j.j] AS DOUBLE)), 6) AS cov FROM embeddings, (SELECT unnest([1, 2, 3, 4]) AS i) i, (SELECT unnest([1, 2, 3, 4]) AS j) j GROUP BY i.i, j.j")
def pooled_covariance(spark, sf):
    return rounded(gmm.pooled_covariance(views.points(spark, sf, 4), 4), "cov")


@query("WITH x AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings) SELECT id, round((a - (SELECT avg(a) FROM x)) / (SELECT stddev_pop(a) FROM x), 6) AS x, round((b - (SELECT avg(b) FROM x)) / (SELECT stddev_pop(b) FROM x), 6) AS y FROM x")
def standardize(spark, sf):
    s = gmm.standardised(views.points(spark, sf, 2), 2)
    return rounded(s.select("id", F.get("features", 0).alias("x"), F.get("features", 1).alias("y")), "x", "y")


# ---- agreement of clusterings

#: A fixed rule in place of a fitted model: the sign pattern of the first three components, shifted.
_PRED_SQL = "c AS (SELECT vec_id AS id, CAST(CASE WHEN embedding[1] > 0 THEN 4 ELSE 0 END + CASE WHEN embedding[2] > 0 THEN 2 ELSE 0 END + CASE WHEN embedding[3] > 0 THEN 1 ELSE 0 END AS INT) AS pred, CAST(label AS INT) AS label FROM embeddings)"


def _clusterings(spark, sf) -> DataFrame:
    p = views.points(spark, sf, 3)
    bit = lambda i, v: F.when(F.get("features", i) > 0, v).otherwise(0)
    return p.select("id", (bit(0, 4) + bit(1, 2) + bit(2, 1)).alias("pred"), "label", "features")


@query(f"WITH {_PRED_SQL} SELECT pred, label, count(*) AS n FROM c GROUP BY 1, 2")
def contingency(spark, sf):
    return evaluate.contingency(_clusterings(spark, sf))


@query(f"WITH {_PRED_SQL} SELECT pred, count(*) AS n FROM c GROUP BY 1")
def cluster_sizes(spark, sf):
    return evaluate.cluster_sizes(_clusterings(spark, sf))


@query(f"WITH {_PRED_SQL}, t AS (SELECT pred, label, count(*) AS n FROM c GROUP BY 1, 2), m AS (SELECT max(n) AS m, sum(n) AS s FROM t GROUP BY pred) SELECT round(sum(m) / sum(s), 6) AS purity FROM m")
def purity(spark, sf):
    return rounded(evaluate.purity(_clusterings(spark, sf)), "purity")


@query(f"WITH {_PRED_SQL}, t AS (SELECT pred, label, count(*) AS n FROM c GROUP BY 1, 2) SELECT label, pred FROM t QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, pred) = 1")
def majority_map(spark, sf):
    return evaluate.majority_map(_clusterings(spark, sf))


@query(f"WITH {_PRED_SQL}, t AS (SELECT pred, label, count(*) AS n FROM c GROUP BY 1, 2), m AS (SELECT label, pred FROM t QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, pred) = 1), b AS (SELECT pred, max(label) AS l FROM m GROUP BY 1) SELECT id, label, coalesce(l, c.pred) AS pred FROM c LEFT JOIN b ON b.pred = c.pred")
def relabelled(spark, sf):
    return evaluate.relabelled(_clusterings(spark, sf).drop("features"))


@query(f"WITH {_PRED_SQL}, l AS (SELECT label AS k, count(*) AS t FROM c GROUP BY 1), s AS (SELECT pred AS k, count(*) AS s FROM c GROUP BY 1), h AS (SELECT label AS k, count(*) AS h FROM c WHERE pred = label GROUP BY 1), q AS (SELECT coalesce(h, 0) / (coalesce(s, 0) + 1e-9) AS p, coalesce(h, 0) / (t + 1e-9) AS r FROM l LEFT JOIN s USING (k) LEFT JOIN h USING (k)) SELECT (SELECT round(1 - avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) FROM c) AS mcr, round(avg(2 * p * r / (p + r + 1e-9)), 6) AS macro_f1 FROM q")
def mcr_f1(spark, sf):
    return rounded(evaluate.misclassification(_clusterings(spark, sf)), "mcr", "macro_f1")


@query(f"WITH {_PRED_SQL}, t AS (SELECT pred, label, CAST(count(*) AS DOUBLE) AS n FROM c GROUP BY 1, 2), i AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) AS n FROM t), a AS (SELECT sum(s * (s - 1) / 2) AS a FROM (SELECT sum(n) AS s FROM t GROUP BY pred)), b AS (SELECT sum(s * (s - 1) / 2) AS b FROM (SELECT sum(n) AS s FROM t GROUP BY label)) SELECT round((i - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) AS ari FROM i, a, b")
def ari(spark, sf):
    return rounded(evaluate.ari(_clusterings(spark, sf)), "ari")


@query(f"WITH {_PRED_SQL}, t AS (SELECT pred, label, CAST(count(*) AS DOUBLE) AS n FROM c GROUP BY 1, 2), z AS (SELECT CAST(count(*) AS DOUBLE) AS z FROM c), p AS (SELECT pred, sum(n) AS np FROM t GROUP BY 1), l AS (SELECT label, sum(n) AS nl FROM t GROUP BY 1), mi AS (SELECT sum(n / z * ln(n * z / (np * nl))) AS mi FROM t JOIN p USING (pred) JOIN l USING (label), z), hp AS (SELECT -sum(np / z * ln(np / z)) AS hp FROM p, z), hl AS (SELECT -sum(nl / z * ln(nl / z)) AS hl FROM l, z) SELECT round(2 * mi / (hp + hl), 6) AS nmi FROM mi, hp, hl")
def nmi(spark, sf):
    return rounded(evaluate.nmi(_clusterings(spark, sf)), "nmi")


@query(f"WITH {_PRED_SQL}, x AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS d FROM embeddings), g AS (SELECT pred, count(*) AS n, avg(a) AS a, avg(b) AS b, avg(d) AS d, var_pop(a) + var_pop(b) + var_pop(d) AS s FROM x JOIN c USING (id) GROUP BY 1), m AS (SELECT avg(a) AS a, avg(b) AS b, avg(d) AS d FROM x) SELECT round((sum(n * (pow(g.a - m.a, 2) + pow(g.b - m.b, 2) + pow(g.d - m.d, 2))) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))), 4) AS calinski_harabasz FROM g, m")
def calinski_harabasz(spark, sf):
    return rounded(evaluate.calinski_harabasz(_clusterings(spark, sf), 3), "calinski_harabasz", digits=4)


@query(f"WITH {_PRED_SQL}, x AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS d FROM embeddings), y AS (SELECT * FROM x JOIN c USING (id)), f AS (SELECT p.id, p.pred AS p, q.pred AS q, avg(sqrt(pow(p.a - q.a, 2) + pow(p.b - q.b, 2) + pow(p.d - q.d, 2))) AS m FROM y p, y q WHERE p.id <> q.id GROUP BY 1, 2, 3), s AS (SELECT id, max(CASE WHEN p = q THEN m END) AS a, min(CASE WHEN p <> q THEN m END) AS b FROM f GROUP BY 1) SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s")
def silhouette(spark, sf):
    return rounded(evaluate.silhouette(_clusterings(spark, sf), 3), "silhouette")


@query(f"WITH {_PRED_SQL} SELECT round(100 * avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM c")
def agreement_pct(spark, sf):
    return rounded(evaluate.agreement(_clusterings(spark, sf)), "agreement")


@query()
def hungarian_mapping(spark, sf):
    return spark.createDataFrame(sorted(evaluate.best_mapping(_clusterings(spark, sf), 10).items()), "pred int, label int")


@query("WITH g AS (SELECT label AS k, avg(CAST(embedding[1] AS DOUBLE)) AS a, avg(CAST(embedding[2] AS DOUBLE)) AS b, count(*) AS n FROM embeddings GROUP BY 1), z AS (SELECT count(*) AS z FROM embeddings), p AS (SELECT l.k, r.k AS m, sqrt(pow(l.a + 0.01 - r.a, 2) + pow(l.b - r.b, 2)) AS dist, abs(l.n - r.n) / z AS w FROM g l, g r, z) SELECT CAST(k AS INT) AS component, CAST(m AS INT) AS match, round(dist, 6) AS distance, 0.0::DOUBLE AS cov_distance, round(w, 6) AS weight_diff FROM p QUALIFY row_number() OVER (PARTITION BY k ORDER BY dist, m) = 1")
def model_match(spark, sf):
    p = views.points(spark, sf, 2)
    n = p.agg(F.count(F.lit(1)).alias("n"))
    per = p.groupBy(F.col("label").alias("component")).agg(F.count(F.lit(1)).alias("c"), F.array(F.avg(F.get("features", 0)), F.avg(F.get("features", 1))).alias("mean")).crossJoin(F.broadcast(n))
    b = per.select("component", (F.col("c") / F.col("n")).alias("weight"), "mean", F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("cov"))
    a = b.withColumn("mean", F.array(F.get("mean", 0) + 0.01, F.get("mean", 1)))
    return rounded(gmm.match_components(a, b), "distance", "cov_distance", "weight_diff")


# ---- benchmark statistics

_GRID_SQL = "g AS (SELECT * FROM (VALUES " + ", ".join(f"({d}, {p}, {s}::DOUBLE)" for d, *row in bench_stats.GRID for p, s in zip(bench_stats.PROCS, row, strict=True)) + ") t(delta, p, seconds))"


def _long(spark):
    return bench_stats.melt(bench_stats.wide_grid(spark))


@query(f"WITH {_GRID_SQL} SELECT delta, p, seconds FROM g")
def bench_melt(spark, sf):
    return _long(spark)


@query(f"WITH {_GRID_SQL}, f AS (SELECT *, first_value(seconds) OVER (PARTITION BY delta ORDER BY p) AS t FROM g) SELECT delta, p, seconds, round(t / seconds, 6) AS speedup, round(t / seconds / p, 6) AS efficiency FROM f")
def bench_speedup(spark, sf):
    return rounded(bench_stats.speedups(_long(spark)), "speedup", "efficiency")


@query(f"WITH {_GRID_SQL} SELECT delta, p, seconds, round(seconds * p - first_value(seconds) OVER (PARTITION BY delta ORDER BY p), 6) AS overhead FROM g")
def bench_overhead(spark, sf):
    return rounded(bench_stats.overhead(_long(spark)), "overhead")


@query(f"WITH {_GRID_SQL} SELECT delta, p, seconds FROM g QUALIFY row_number() OVER (PARTITION BY delta ORDER BY seconds, p) = 1")
def bench_best_p(spark, sf):
    return bench_stats.best_p(_long(spark))


@query(f"WITH {_GRID_SQL} SELECT p, round(avg(seconds), 6) AS mean, round(stddev_samp(seconds), 6) AS std, round(quantile_cont(seconds, 0.25), 6) AS q1, round(quantile_cont(seconds, 0.5), 6) AS median, round(quantile_cont(seconds, 0.75), 6) AS q3, round(stddev_samp(seconds) / avg(seconds) * 100, 6) AS cv FROM g GROUP BY 1")
def bench_cv(spark, sf):
    return rounded(bench_stats.variation(_long(spark)), "mean", "std", "q1", "median", "q3", "cv")


@query(f"WITH {_GRID_SQL}, n AS (SELECT *, lead(p) OVER w AS next_p, lead(seconds) OVER w AS t FROM g WINDOW w AS (PARTITION BY delta ORDER BY p)) SELECT p, next_p, round(avg((seconds - t) / seconds * 100), 6) AS improvement FROM n WHERE next_p IS NOT NULL GROUP BY 1, 2")
def bench_improvement(spark, sf):
    return rounded(bench_stats.improvement(_long(spark)), "improvement")


@query(f"WITH {_GRID_SQL}, m AS (SELECT p, avg(seconds) AS s FROM g GROUP BY 1), f AS (SELECT *, (SELECT s FROM m WHERE p = 1) AS t FROM m) SELECT p, round(s, 6) AS seconds, round(t / s, 6) AS speedup, round(t / s / p, 6) AS efficiency FROM f")
def bench_means(spark, sf):
    return rounded(bench_stats.column_means(_long(spark)), "seconds", "speedup", "efficiency")


@query("WITH t AS (SELECT l_linenumber AS size, l_returnflag AS stage, l_linestatus AS impl, avg(l_quantity) AS s FROM lineitem GROUP BY 1, 2, 3) SELECT t.size, t.stage, t.impl, round(t.s, 6) AS seconds, round(b.s / t.s, 6) AS speedup FROM t JOIN t b ON t.size = b.size AND t.stage = b.stage AND b.impl = 'O'")
def stage_speedups(spark, sf):
    t = views.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("size"), F.col("l_returnflag").alias("stage"), F.col("l_linestatus").alias("impl")).agg(F.avg("l_quantity").alias("seconds"))
    return rounded(bench_stats.stage_speedups(t, "O"), "seconds", "speedup")


@query("SELECT p_size AS iteration, round(avg(CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END), 4) AS even, round(avg(CASE WHEN p_partkey % 2 = 1 THEN p_retailprice END), 4) AS odd FROM part GROUP BY 1")
def convergence_overlay(spark, sf):
    part = views.table(spark, sf, "part")
    one = lambda r: part.where(F.pmod("p_partkey", F.lit(2)) == r).groupBy(F.col("p_size").alias("iteration")).agg(F.round(F.avg("p_retailprice"), 4).alias("log_likelihood"))
    return bench_stats.overlay({"even": one(0), "odd": one(1)})


_TRACE = [-51204.02, -50649.68, -50645.68, -50645.67, -50645.66, -50645.655, -50640.0, -50639.999]
_TRACE_SQL = "t AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {v}::DOUBLE)" for i, v in enumerate(_TRACE)) + ") t(iteration, log_likelihood)), d AS (SELECT *, log_likelihood - lag(log_likelihood) OVER (ORDER BY iteration) AS delta FROM t)"


def _trace(spark):
    return spark.createDataFrame(list(enumerate(_TRACE)), "iteration int, log_likelihood double")


@query(f"WITH {_TRACE_SQL} SELECT iteration, log_likelihood, round(delta, 6) AS delta FROM d")
def convergence_delta(spark, sf):
    return rounded(bench_stats.deltas(_trace(spark)), "delta")


@query(f"WITH {_TRACE_SQL} SELECT iteration, log_likelihood, round(delta, 6) AS delta, sum(CASE WHEN coalesce(abs(delta) < 0.05, false) THEN 1 ELSE 0 END) OVER (ORDER BY iteration ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS converged FROM d")
def convergence_streak(spark, sf):
    return rounded(bench_stats.streak(_trace(spark), 0.05), "delta")


@query("WITH e AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS total FROM events), b AS (SELECT CAST(least(floor((value - lo) / ((hi - lo) / 100)), 99) AS BIGINT) AS bin, count(*) AS n FROM events, e GROUP BY 1), f AS (SELECT unnest(range(0, 100)) AS bin) SELECT f.bin, round(lo + f.bin * ((hi - lo) / 100), 6) AS low, coalesce(n, 0) AS n, round(coalesce(n, 0) / (total * ((hi - lo) / 100)), 6) AS density FROM f CROSS JOIN e LEFT JOIN b ON b.bin = f.bin")
def histogram_100(spark, sf):
    h = bench_stats.histogram(views.points_1d(spark, sf), "x", 100)
    return rounded(h.withColumn("n", F.col("n").cast("long")), "low", "density")


_REPORT = ["Total Time: 12.5 seconds (100%)", "E-step: 1.8357e-05 seconds (0.5%)", "M-step: 0 seconds (0%)", "Load data: 3 seconds", "no number here", "Threads: many"]


@query("SELECT * FROM (VALUES ('Total Time', 12.5::DOUBLE, 100::DOUBLE), ('E-step', 1.8357e-05, 0.5), ('M-step', 0, 0), ('Load data', 3, NULL)) t(stage, seconds, pct)")
def timing_parse(spark, sf):
    return io.timing_lines(spark.createDataFrame([(line,) for line in _REPORT], "value string"))


@query("SELECT o_orderstatus AS stage, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders) * 100, 6) AS pct FROM orders GROUP BY 1")
def timing_summary(spark, sf):
    t = views.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("stage"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("seconds"))
    return rounded(rounded(bench_stats.timing_summary(t), "total", digits=2), "mean", "pct")


@query("SELECT l_suppkey % 4 AS procs, CAST(l_linenumber AS INT) AS run, round(max(l_extendedprice), 6) AS slowest, round(avg(l_extendedprice), 6) AS mean FROM lineitem GROUP BY 1, 2")
def rank_log_summary(spark, sf):
    t = views.table(spark, sf, "lineitem").select(F.pmod("l_suppkey", F.lit(4)).alias("procs"), F.col("l_linenumber").alias("run"), F.col("l_suppkey").alias("rank"), F.col("l_extendedprice").alias("seconds"))
    return rounded(bench_stats.run_log(t), "slowest", "mean")


@query("SELECT o_orderkey % 5 AS k, round(sum(l_quantity) / sum(l_extendedprice), 9) AS edges_per_second, round(sum(l_tax) / sum(l_quantity), 6) AS intensity, round(count(*) / count(DISTINCT o_custkey), 6) AS compression, round(sum(o_totalprice) / sum(l_extendedprice), 6) AS speedup, round(sum(o_totalprice) / sum(l_extendedprice) / 4, 6) AS efficiency FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def derived_metrics(spark, sf):
    j = views.table(spark, sf, "lineitem").join(views.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    runs = j.groupBy(F.pmod("o_orderkey", F.lit(5)).alias("k")).agg(F.sum("l_quantity").alias("edges"), F.sum("l_tax").alias("relaxations"), F.countDistinct("o_custkey").alias("buckets"), F.count(F.lit(1)).alias("vertices"), F.sum("l_extendedprice").alias("seconds"), F.lit(4).alias("processes"), F.sum("o_totalprice").alias("base_seconds"))
    out = bench_stats.derived_metrics(runs).select("k", "edges_per_second", "intensity", "compression", "speedup", "efficiency")
    return rounded(rounded(out, "edges_per_second", digits=9), "intensity", "compression", "speedup", "efficiency")


@query("SELECT * FROM (VALUES (0, 0.25::DOUBLE, '0.5 -1.5'), (1, 0.75, '2.0 3.25')) t(component, weight, mean), (VALUES ('1.0 0.25 0.25 2.0')) c(cov)")
def model_roundtrip(spark, sf):
    model = spark.createDataFrame([(0, 0.25, [0.5, -1.5], [[1.0, 0.25], [0.25, 2.0]]), (1, 0.75, [2.0, 3.25], [[1.0, 0.25], [0.25, 2.0]])], "component int, weight double, mean array<double>, cov array<array<double>>")
    back = io.model_lines(io.model_of_lines(io.model_lines(model).withColumn("Mean", F.concat(F.lit("  "), F.col("Mean")))))
    return back.select(F.col("Component").alias("component"), F.col("Weight").alias("weight"), F.col("Mean").alias("mean"), F.col("Covariance").alias("cov"))


# ---- sources and sinks: written to the shared folder and read back


def _place(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


@query(f"WITH {TRIPS_SQL} SELECT s AS src, t AS dst, w AS weight FROM e")
def io_weighted_edges(spark, sf):
    io.write_edges(views.trips(spark, sf), path := _place(spark, "edges"))
    return io.read_edges(spark, path, directed=False)


@query(f"WITH {TRIPS_SQL} SELECT s AS src, t AS dst, CAST(1 AS BIGINT) AS weight FROM d")
def io_unweighted_edges(spark, sf):
    lines = views.trips(spark, sf).select(F.concat_ws(" ", "src", "dst").alias("value"))
    junk = spark.createDataFrame([("# comment",), ("",), ("one two",), ("5",), (f"1 {1 << 40}",), ("-1 2",)], "value string")
    lines.unionByName(junk).write.text(path := _place(spark, "pairs"))
    return io.read_edges(spark, path, weighted=False, n=1 << 40)


@query("SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT, 4::BIGINT), (1, 2, 1)) t(src, dst, weight)")
def io_inline_edges(spark, sf):
    return io.inline_edges(spark, [(0, 1, 4), (1, 2)])


@query("WITH d AS (SELECT c_custkey AS vertex, CASE WHEN c_custkey % 3 > 0 THEN c_custkey * 2 END AS dist FROM customer) SELECT vertex, dist FROM d")
def io_distances(spark, sf):
    d = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("vertex"), F.when(F.pmod("c_custkey", F.lit(3)) > 0, F.col("c_custkey") * 2).alias("dist"))
    io.write_distances(d, path := _place(spark, "distances"))
    return io.read_distances(spark, path)


@query("SELECT CAST(vec_id AS DOUBLE) AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings")
def io_features(spark, sf):
    io.write_features(views.points(spark, sf, 2), path := _place(spark, "features"), 2)
    return io.read_features(spark, path, ["id", "x", "y"]).select(*[F.get("features", i).alias(c) for i, c in enumerate(("id", "x", "y"))])


@query("SELECT vec_id AS id, CAST(label AS INT) AS label FROM embeddings")
def io_labels(spark, sf):
    io.write_labels(views.points(spark, sf, 1), path := _place(spark, "labels"))
    return io.read_labels(spark, path)


@query("SELECT vec_id AS index, CAST(label AS INT) AS predicted_cluster FROM embeddings")
def io_predictions(spark, sf):
    io.write_predictions(views.points(spark, sf, 1).withColumnRenamed("label", "pred"), path := _place(spark, "predictions"))
    return io.read_predictions(spark, path)


@query("SELECT event_id AS id, value AS x FROM events")
def io_dataset(spark, sf):
    io.save_dataset(views.points_1d(spark, sf), path := _place(spark, "dataset"))
    return io.load_dataset(spark, path)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {v}::DOUBLE)" for i, v in enumerate(_TRACE)) + ") t(iteration, log_likelihood)")
def io_trace(spark, sf):
    io.write_trace(_trace(spark), path := _place(spark, "trace"))
    return io.read_trace(spark, path)


@query("SELECT o_orderstatus AS stage, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS seconds, round(100.0 * count(*) / (SELECT count(*) FROM orders), 3) AS pct FROM orders GROUP BY 1")
def io_timing(spark, sf):
    o = views.table(spark, sf, "orders")
    n = o.count()
    t = o.groupBy(F.col("o_orderstatus").alias("stage")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.lit(100.0) * F.count(F.lit(1)) / n, 3).alias("pct"))
    io.write_timing(t, path := _place(spark, "timing"))
    return io.read_timing(spark, path)


@query("SELECT 1 AS procs, l_linenumber AS run, CAST(l_suppkey AS INT) AS rank, max(l_quantity) AS seconds FROM lineitem GROUP BY 2, 3")
def io_rank_log(spark, sf):
    t = views.table(spark, sf, "lineitem").groupBy(F.lit(1).alias("procs"), F.col("l_linenumber").alias("run"), F.col("l_suppkey").cast("int").alias("rank")).agg(F.max("l_quantity").alias("seconds"))
    io.write_rank_log(t, path := _place(spark, "ranks"))
    return io.read_rank_log(spark, path)


@query("SELECT n_nationkey AS rank, n_name AS value FROM nation")
def io_messages(spark, sf):
    rows = views.table(spark, sf, "nation").select(F.col("n_nationkey").alias("rank"), F.col("n_name").alias("value"))
    io.write_messages(rows.coalesce(1), path := _place(spark, "messages"))
    return io.read_messages(spark, path)


# ---- generators and small analyses


@query()
def random_graph(spark, sf):
    return graph.random_graph(spark, 200, 0.05)


@query()
def synthetic_mixture(spark, sf):
    return gmm.synthetic(spark, _start(3), 2000)


@query("SELECT l_returnflag AS flag, round(sum(l_tax * l_extendedprice) / sum(l_extendedprice) * 100, 6) AS pct FROM lineitem GROUP BY 1")
def transfer_overhead(spark, sf):
    t = views.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.sum(F.col("l_tax") * F.col("l_extendedprice")).alias("moved"), F.sum("l_extendedprice").alias("total"))
    return t.select("flag", F.round(bench_stats.share("moved", "total"), 6).alias("pct"))


@query("WITH t AS (SELECT l_linenumber AS procs, l_suppkey % 8 AS rank, max(l_quantity) AS s FROM lineitem GROUP BY 1, 2) SELECT CAST(procs AS INT) AS procs, CAST(rank AS INT) AS rank, CAST(s AS DOUBLE) AS seconds FROM t")
def io_rank_blocks(spark, sf):
    t = views.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("procs"), F.lit(0).alias("run"), F.pmod("l_suppkey", F.lit(8)).cast("int").alias("rank")).agg(F.max("l_quantity").cast("double").alias("seconds"))
    io.write_rank_blocks(t, path := _place(spark, "blocks"))
    return io.read_rank_blocks(spark, path).drop("run")


_REPORT_SQL = "SELECT 'Orders ' || o_orderstatus AS metric, CAST(count(*) AS DOUBLE) AS value, 'rows' AS unit FROM orders GROUP BY o_orderstatus UNION ALL SELECT CAST(s_nationkey AS VARCHAR) || ' | ' || CAST(count(*) AS VARCHAR), CAST(min(s_suppkey) AS DOUBLE), 'bucket' FROM supplier GROUP BY s_nationkey"


@query(_REPORT_SQL)
def io_report(spark, sf):
    metrics = views.table(spark, sf, "orders").groupBy(F.concat(F.lit("Orders "), "o_orderstatus").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("unit", F.lit("rows"))
    buckets = views.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("size"), F.min("s_suppkey").cast("double").alias("seconds"))
    io.write_report(metrics, buckets, path := _place(spark, "report"))
    back, rows = io.read_report(spark, path)
    return back.unionByName(rows.select(F.concat_ws(" | ", "bucket", "size").alias("metric"), F.col("seconds").alias("value"), F.lit("bucket").alias("unit")))


@query("WITH t AS (SELECT o_orderpriority AS stage, o_orderstatus AS s, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2), a AS (SELECT stage, v FROM t WHERE s = 'F'), b AS (SELECT stage, v FROM t WHERE s = 'O') SELECT coalesce(a.stage, b.stage) AS stage, round(a.v, 2) AS a, round(b.v, 2) AS b, round(a.v / b.v, 6) AS speedup FROM a FULL OUTER JOIN b ON a.stage = b.stage")
def timing_compare(spark, sf):
    t = views.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("stage"), "o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("seconds"))
    one = lambda s: t.where(F.col("o_orderstatus") == s)
    return rounded(rounded(bench_stats.compare_timings(one("F"), one("O")), "a", "b", digits=2), "speedup")


@query("SELECT count(DISTINCT c_custkey % 7) AS owners, CAST(count(DISTINCT c_custkey) AS BIGINT) AS held, count(DISTINCT c_custkey) AS total, true AS ok FROM customer")
def partition_check(spark, sf):
    return exchange.distribution_check(views.table(spark, sf, "customer"), "c_custkey", exchange.owner_mod(F.col("c_custkey"), 7))


@query("WITH f AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings), l AS (SELECT vec_id AS id, CAST(label AS INT) AS label FROM embeddings WHERE vec_id % 3 > 0), p AS (SELECT vec_id + 5 AS id, CAST(label AS INT) AS pred FROM embeddings) SELECT id, round(x, 6) AS x, label, pred, concat_ws(',', CASE WHEN x IS NULL THEN 'features' END, CASE WHEN label IS NULL THEN 'label' END, CASE WHEN pred IS NULL THEN 'pred' END) AS lacks FROM f FULL OUTER JOIN l USING (id) FULL OUTER JOIN p USING (id)")
def assembled_rows(spark, sf):
    p = views.points(spark, sf, 1)
    preds = p.select((F.col("id") + 5).alias("id"), F.col("label").alias("pred"))
    out = evaluate.assembled(p, p.where(F.pmod("id", F.lit(3)) > 0), preds)
    return rounded(out.select("id", F.get("features", 0).alias("x"), "label", "pred", "lacks"), "x")


@query("SELECT * FROM " + ", ".join(f"({ORACLE_SQL[name]}) t_{name}" for name in ("agreement_pct", "purity", "mcr_f1", "ari", "nmi", "calinski_harabasz")))
def evaluation_bundle(spark, sf):
    out = evaluate.bundle(_clusterings(spark, sf), 3)
    return rounded(rounded(out, "agreement", "purity", "mcr", "macro_f1", "ari", "nmi"), "calinski_harabasz", digits=4)


@query("SELECT CAST(n_nationkey AS BIGINT) AS src, " + ", ".join(f'CAST(n_regionkey = {i} AS INT) AS "{i}"' for i in range(5)) + " FROM nation")
def adjacency_matrix(spark, sf):
    n = views.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"))
    return graph.adjacency_matrix(n, 5)


@query("SELECT CAST(100000 AS BIGINT) AS n, CAST(100000 AS BIGINT) AS places, true AS inside, true AS spread")
def random_ints_law(spark, sf):
    v = linalg.random_ints(spark, 100_000, 1000)
    share = F.abs(F.avg("value") - 499.5) < 5
    return v.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("idx").alias("places"), ((F.min("value") >= 0) & (F.max("value") < 1000)).alias("inside"), share.alias("spread"))


@query()
def gmm_experiment(spark, sf):
    return experiment.run(spark, _start(2), 2000, 3, _place(spark, "experiment"))


@query(f"WITH {TRIPS_SQL}, x AS (SELECT s, t, min(w) AS w FROM e GROUP BY 1, 2) SELECT s AS src, string_agg(t || ':' || w, ',' ORDER BY t) AS neighbours FROM x GROUP BY 1")
def weighted_adjacency(spark, sf):
    e = graph.collapse(graph.undirect(views.trips(spark, sf)))
    return graph.weighted_adjacency(e).select("src", F.concat_ws(",", F.transform("neighbours", lambda v: F.concat_ws(":", v["dst"], v["weight"]))).alias("neighbours"))
