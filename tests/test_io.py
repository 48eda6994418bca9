from tessera.operators import graph
from tessera.sources import io


def test_distances(spark, tmp_path):
    d = spark.createDataFrame([(0, 0), (1, None), (2, 7)], "vertex long, dist long")
    io.write_distances(d, str(tmp_path / "d"))
    back = io.read_distances(spark, str(tmp_path / "d"))
    assert graph.diff_distances(d, back).isEmpty() and back.count() == 3


def test_features_labels_and_predictions(spark, tmp_path):
    p = spark.createDataFrame([(0, [1.5, 2.0], 1), (1, [-3.0, 0.25], 0)], "id long, features array<double>, label int")
    io.write_features(p, str(tmp_path / "x"), 2)
    io.write_labels(p, str(tmp_path / "l"))
    io.write_predictions(p.withColumnRenamed("label", "pred"), str(tmp_path / "p"))
    x = io.read_features(spark, str(tmp_path / "x"), ["id", "x", "y"])
    assert sorted(map(list, (r["features"] for r in x.collect()))) == [[0.0, 1.5, 2.0], [1.0, -3.0, 0.25]]
    assert {tuple(r) for r in io.read_labels(spark, str(tmp_path / "l")).collect()} == {(0, 1), (1, 0)}
    assert {tuple(r) for r in io.read_predictions(spark, str(tmp_path / "p")).collect()} == {(0, 1), (1, 0)}


def test_model_and_trace(spark, tmp_path):
    m = spark.createDataFrame([(0, 0.5, [1.0, -2.0], [[1.0, 0.5], [0.5, 3.0]])], "component int, weight double, mean array<double>, cov array<array<double>>")
    io.write_model(m, str(tmp_path / "m"))
    assert io.read_model(spark, str(tmp_path / "m")).collect() == m.collect()
    t = spark.createDataFrame([(0, -2.97613e6), (1, -2.72053e6)], "iteration int, log_likelihood double")
    io.write_trace(t, str(tmp_path / "t"))
    assert sorted(io.read_trace(spark, str(tmp_path / "t")).collect()) == sorted(t.collect())


def test_messages(spark, tmp_path):
    rows = spark.createDataFrame([(r, f"hello from {r}") for r in (2, 0, 1)], "rank int, value string")
    io.write_messages(rows.coalesce(1), str(tmp_path / "w"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "w")).collect()) == [f"hello from {r}" for r in range(3)]
    (tmp_path / "one.txt").write_text("abcdefgh")
    assert [(r["rank"], r["value"]) for r in io.read_messages(spark, str(tmp_path / "one.txt"), 3).collect()] == [(0, "abc"), (1, "def"), (2, "gh")]


def test_timing(spark, tmp_path):
    (tmp_path / "t.txt").write_text("Total: 2 seconds (100%)\nE step: 1.8357e-05 seconds (0.9%)\nnothing\n")
    assert {tuple(r) for r in io.read_timing(spark, str(tmp_path / "t.txt")).collect()} == {("Total", 2.0, 100.0), ("E step", 1.8357e-05, 0.9)}
