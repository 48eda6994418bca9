from tessera.operators import bench_stats, evaluate, exchange, linalg
from tessera.sources import io

BLOCKS = """Execution with 2 processors
 Process 0: 3.5 seconds
 Process 1: 2.25e-01 seconds
Maximum Time: 3.5 seconds
Average Time Per Process: 1.8625 seconds
--------------------------------------------
Execution with 1 processors
 Process 0: 4 seconds
Maximum Time: 4 seconds
Average Time Per Process: 4 seconds
--------------------------------------------
"""

REPORT = """PERFORMANCE METRICS
===================
Graph Information:
  Nodes: 12
  Total Execution Time: 6.5 seconds
  Speedup: 0.75x

  Bucket ID | Size | Processing Time (seconds)
  -----------------------------------------
  0 | 1 | 0.25
  1 | 2 | 3e-1
"""


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_rank_blocks(spark, tmp_path):
    (tmp_path / "log.txt").write_text(BLOCKS)
    got = io.read_rank_blocks(spark, str(tmp_path / "log.txt"))
    assert rows(got.drop("run")) == [(1, 0, 4.0), (2, 0, 3.5), (2, 1, 0.225)]
    assert got.select("run").distinct().count() == 2
    io.write_rank_blocks(got, str(tmp_path / "again"))
    assert rows(io.read_rank_blocks(spark, str(tmp_path / "again")).drop("run")) == rows(got.drop("run"))


def test_report(spark, tmp_path):
    (tmp_path / "r.txt").write_text(REPORT)
    metrics, buckets = io.read_report(spark, str(tmp_path / "r.txt"))
    assert rows(metrics) == [("Nodes", 12.0, ""), ("Speedup", 0.75, "x"), ("Total Execution Time", 6.5, "seconds")]
    assert rows(buckets) == [(0, 1, 0.25), (1, 2, 0.3)]


def test_delta_timings(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Delta,Total,Kernel,Transfer,Buckets,Iterations,Result\n1,6.5,5.5,0.25,0.5,20,NO_MATCH\n")
    assert rows(io.read_delta_timings(spark, str(tmp_path / "t.csv"))) == [(1, 6.5, 5.5, 0.25, 0.5, 20, "NO_MATCH")]


def test_compared_timings(spark):
    a = spark.createDataFrame([("load", 4.0), ("fit", 1.0)], "stage string, seconds double")
    b = spark.createDataFrame([("load", 2.0), ("save", 0.0)], "stage string, seconds double")
    got = {r["stage"]: (r["a"], r["b"], r["speedup"]) for r in bench_stats.compare_timings(a, b).collect()}
    assert got == {"load": (4.0, 2.0, 2.0), "fit": (1.0, None, None), "save": (None, 0.0, None)}


def test_assembled(spark):
    f = spark.createDataFrame([(1, [0.5]), (2, [1.5])], "id long, features array<double>")
    y = spark.createDataFrame([(1, 0), (3, None)], "id long, label int")
    p = spark.createDataFrame([(1, 4)], "id long, pred int")
    got = {r["id"]: r["lacks"] for r in evaluate.assembled(f, y, p).collect()}
    assert got == {1: "", 2: "label,pred", 3: "features,pred"}


def test_distribution_and_random_ints(spark):
    v = linalg.random_ints(spark, 500, 10)
    assert rows(v) == rows(linalg.random_ints(spark, 500, 10).repartition(3)) and {r["value"] for r in v.collect()} == set(range(10))
    one = exchange.distribution_check(v, "idx", exchange.owner_mod(v["idx"], 4)).first()
    assert (one["owners"], one["held"], one["total"], one["ok"]) == (4, 500, 500, True)
