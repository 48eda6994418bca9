import random

from pyspark.sql import functions as F

from tessera.operators import exchange, linalg, scan


def vec(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "idx long, value long")


def column(df, by, c):
    return [r[c] for r in df.orderBy(by).collect()]


def test_prefix_sums(spark):
    assert column(scan.prefix_sum(vec(spark, range(10))), "idx", "prefix") == [0, 1, 3, 6, 10, 15, 21, 28, 36, 45]
    assert column(scan.prefix_sum(vec(spark, [1] * 15)), "idx", "prefix") == list(range(1, 16))
    assert column(scan.prefix_sum(vec(spark, [3, 1, 2]), inclusive=False), "idx", "prefix") == [0, 3, 4]
    many = [random.Random(1).randint(-50, 50) for _ in range(3000)]
    assert column(scan.prefix_sum(vec(spark, many), ranges=7), "idx", "prefix") == column(scan.prefix_sum_simple(vec(spark, many)), "idx", "prefix")


def test_reduce(spark):
    ones = spark.range(65_536).select(F.lit(1).cast("long").alias("value"))
    assert scan.reduce(ones).first()[0] == 65_536
    ranks = spark.createDataFrame([(r, r + 1) for r in range(4)], "rank long, value long")
    assert {tuple(r) for r in scan.all_reduce(ranks, "rank").collect()} == {(r, 10) for r in range(4)}


def test_ranks_and_merges(spark):
    r = scan.rank_sort(vec(spark, [3, 1, 3, 0]))
    assert column(r, "idx", "smaller") == [2, 1, 2, 0] and column(r, "position", "value") == [0, 1, 3, 3]
    assert column(scan.merge_sorted(vec(spark, [1, 1]), vec(spark, [1])), "position", "value") == [1, 1, 1]
    assert column(scan.merge_sorted(vec(spark, [0]), vec(spark, [1])), "position", "value") == [0, 1]
    assert column(scan.insertion_points(vec(spark, [5, 1]), vec(spark, [0, 4, 5])), "idx", "below") == [2, 1]


def test_sorting_is_an_ordered_permutation(spark):
    many = [random.Random(2).randint(0, 99) for _ in range(500)]
    got = [tuple(r) for r in scan.stable_sort(vec(spark, many)).collect()]
    assert got == sorted(enumerate(many), key=lambda x: (x[1], x[0]))
    assert [tuple(r) for r in scan.range_sort(vec(spark, many), 3).collect()] == got
    assert scan.is_sorted(vec(spark, sorted(many))).first()[0] is True
    assert scan.is_sorted(vec(spark, sorted(many)[:-1] + [-1])).first()[0] is False


def test_products(spark):
    m = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 1, 3)], "i long, j long, v long")
    assert {tuple(r) for r in linalg.matvec(m, vec(spark, [10, 100])).collect()} == {(0, 210), (1, 300)}
    assert {tuple(r) for r in linalg.matmul(m, m).collect()} == {(0, 0, 1), (0, 1, 8), (1, 1, 9)}
    assert column(linalg.vec_add(vec(spark, [1, 2]), vec(spark, [3, 4])), "idx", "value") == [4, 6]


def test_exchanges(spark):
    sent = spark.createDataFrame([(s, d, s * 10 + d) for s in range(4) for d in range(4)], "src long, dst long, value long")
    assert {r["dst"]: list(r["received"]) for r in exchange.all_to_all(sent).collect()} == {d: [d, 10 + d, 20 + d, 30 + d] for d in range(4)}
    assert column(exchange.half_increment(vec(spark, [1] * 10), 10), "idx", "value") == [2] * 10
    n, p = 23, 5
    owners = [r[0] for r in spark.range(n).select(exchange.owner_block(F.col("id"), n, p)).collect()]
    assert owners == sorted(owners) and [owners.count(k) for k in range(p)] == [5, 5, 5, 4, 4]


def test_empty(spark):
    e = vec(spark, []) if False else spark.createDataFrame([], "idx long, value long")
    assert scan.prefix_sum(e).count() == 0 and scan.rank_sort(e).count() == 0 and scan.is_sorted(e).first()[0] is True
