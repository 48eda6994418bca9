import math
import random

import numpy as np

from tessera.operators import evaluate


def brute(rows, d):
    """The definition; rows of one id have one mean for each of its clusters."""
    rows = [r for r in rows if r[0] is not None]
    whole = [r for r in rows if r[1] is not None and r[2] is not None and len(r[2]) >= d and None not in r[2][:d]]
    sums = {}
    for i, p, x in whole:
        for j, q, y in whole:
            if i != j:
                t = sums.setdefault(i, {}).setdefault((p, q), [0.0, 0])
                t[0] += math.dist(x[:d], y[:d])
                t[1] += 1
    out = []
    for i in {r[0] for r in rows}:
        means = {k: t / n for k, (t, n) in sums.get(i, {}).items()}
        a = max((m for (p, q), m in means.items() if p == q), default=None)
        b = min((m for (p, q), m in means.items() if p != q), default=None)
        out.append(0.0 if a is None or b is None else (b - a) / max(a, b))
    return sum(out) / len(out) if len(out) > 1 else None


def measure(spark, rows, d, **more):
    return evaluate.silhouette(spark.createDataFrame(rows, "id long, pred long, features array<double>").repartition(3), d, **more).first()[0]


def test_copies_repeated_ids_and_missing_values(spark):
    rng = random.Random(3)
    at = [[rng.gauss(c, 1) for _ in range(3)] for c in (0, 0, 1, 3) for _ in range(30)]
    rows = [(i, rng.randrange(4), rng.choice(at)) for i in range(300)] + [(900, 9, [1.0, 2.0, 3.0])]
    odd = [(None, 1, [0.0, 0.0, 0.0]), (901, None, [0.0, 0.0, 0.0]), (902, 2, None), (903, 2, [1.0]), (904, 2, [1.0, None, 2.0]), (5, 1, [4.0, 4.0, 4.0]), (5, 1, [4.0, 4.0, 4.0]), (6, 3, [0.5, 4.0, 1.0])]
    for table in (rows, rows + odd):
        for block in (1 << 17, 50):
            assert abs(measure(spark, table, 3, block=block) - brute(table, 3)) < 1e-12


def test_few_ids(spark):
    assert measure(spark, [(1, 1, [0.0])], 1) is None
    assert measure(spark, [(1, 1, [0.0]), (1, 2, [3.0])], 1) is None
    assert measure(spark, [(1, 1, None), (2, 1, None)], 1) == 0
    assert abs(measure(spark, [(1, 1, [0.0]), (2, 1, [1.0]), (3, 2, [5.0])], 1) - (4 / 5 + 3 / 4) / 3) < 1e-12


def test_points_far_from_zero_and_close_together(spark):
    rng = random.Random(5)
    rows = [(i, i % 4, [1e8 * (i % 4 // 2) + 0.1 * (i % 4) + rng.random() * 0.25, 3e7 + rng.random()]) for i in range(240)]
    assert abs(measure(spark, rows, 2) - brute(rows, 2)) < 1e-9


def test_all_in_one_place_is_not_a_number(spark):
    assert math.isnan(measure(spark, [(i, i % 2, [0.1, 0.7]) for i in range(6)], 2))


def test_what_is_exchanged_grows_with_the_rows(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    store = spark._jsc.sc().statusStore()

    def written(n):
        x = np.random.default_rng(n).normal(size=(n, 2))
        table = spark.createDataFrame([(i, int(v[0] > 0), v.tolist()) for i, v in enumerate(x)], "id long, pred long, features array<double>")
        before = {s.stageId() for s in stages()}
        evaluate.silhouette(table, 2).first()
        return sum(s.shuffleWriteBytes() for s in stages() if s.stageId() not in before)

    def stages():
        spark._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return [found.apply(i) for i in range(found.size())]

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on tables beyond it
    try:
        assert written(32_000) < 2.5 * written(16_000)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
