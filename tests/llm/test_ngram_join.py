import random
import re
from collections import Counter

import pytest

from tessera.llm import ngram_join
from tessera.llm.components import components


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and den * n >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed, n=140):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(60)]
    passage = [rng.choice(words) for _ in range(30)]
    bases = [[rng.choice(words) for _ in range(rng.choice([1, 2, 4, 11, 25, 90]))] for _ in range(12)] + [passage * 3]
    out = []
    for i in range(n):
        t = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            t[rng.randrange(len(t))] = rng.choice(words)
        if rng.random() < 0.3:
            t += passage
        out.append((i, rng.choice([" ", "\n", "\t "]).join(t)))
    return out + [(n, None), (n + 1, ""), (n + 2, " \x0b\n"), (n + 3, "É é"), (n + 4, "É É"), (n + 5, "A b"), (n + 6, "a B")]


@pytest.mark.parametrize("seed, k, num, den", [(1, 3, 9, 10), (2, 5, 4, 5)])
def test_components_against_brute_force(spark, seed, k, num, den):
    rows = near_copies(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long").repartition(4)
    got = {r[0]: (r[1], r[2]) for r in ngram_join.jaccard_components(df, k, num, den).collect()}
    assert got == brute(rows, k, num, den)


def test_small_groups_and_many_pivots(spark, monkeypatch):
    for name, value in (("GROUP", 4), ("QUERIES", 3), ("PIVOTS", 1)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = near_copies(7, 90)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in ngram_join.jaccard_components(df, 3, 4, 5).collect()}
    assert got == brute(rows, 3, 4, 5)


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None), (2, "A B C D")], "doc_id long, text string")
    got = Counter(tuple(r) for r in ngram_join.jaccard_components(df, 3, 9, 10).collect())
    assert got == Counter({(1, 2, 1): 2, (None, 2, None): 1, (None, 0, None): 1, (2, 2, 1): 1})
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0


def test_group_union_bound_and_links():
    import numpy as np

    g = ngram_join.Group([(1, np.arange(10, dtype=np.uint64)), (2, np.arange(5, 15, dtype=np.uint64))])
    assert g.links(np.arange(10, dtype=np.uint64), 9, 10) == [1]
    assert g.links(np.arange(100, 110, dtype=np.uint64), 9, 10) == []
    assert g.links(np.arange(15, dtype=np.uint64), 9, 10) == []


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(5, 5), (3, 35), (90, 80)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    joined = {0: 0, 10: 10, 20: 20, 30: 0}
    assert got == {**{i: joined[i // 10 * 10] for i in range(40)}, 80: 80, 90: 80}


def test_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(4)
    text = lambda: " ".join("w%d" % rng.randrange(10**6) for _ in range(60))
    a, b = text(), text()
    near = lambda t: t + " more"
    rows = [(5, a), (5, b), (7, near(a)), (8, near(b)), (9, text()), (9, None), (9, "x y z u"), (11, "x y z u"), (12, "")]
    for order in (rows, rows[::-1], rows[4:] + rows[:4]):
        df = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        got = {(r[0], r[2]) for r in ngram_join.jaccard_components(df, 3, 9, 10).collect()}
        assert got == {(5, 5), (7, 5), (8, 5), (9, 9), (11, 9), (12, 12)}


def test_one_row_of_each_class_stays(spark):
    rng = random.Random(6)
    text = lambda: " ".join("w%d" % rng.randrange(10**6) for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a), (1, b), (2, a + " x"), (3, b), (None, c), (None, c), (None, c + " y"), (4, d), (4, d), (None, d), (None, None), (5, ""), (5, ""), (None, " ")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(*r, "k") for r in order], "doc_id long, text string, component string")
        got = Counter((r["doc_id"], r["text"]) for r in ngram_join.one_of_each(df).collect())
        kept = [k for k in got if k[0] is None and k[1] and k[1].strip()]
        assert len(kept) == 1 and kept[0][1] in (c, c + " y")
        assert got - Counter(kept) == Counter([(1, a), (1, b), (4, d), (None, None), (5, ""), (5, ""), (None, " ")])


def test_a_long_text(spark):
    rng = random.Random(8)
    words = ["w%d" % rng.randrange(10**7) for _ in range(500_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:480_000])), (3, " ".join(words[:300_000]))], "doc_id long, text string")
    assert {r[0]: r[2] for r in ngram_join.jaccard_components(df, 3, 9, 10).collect()} == {1: 1, 2: 1, 3: 3}


def test_sets_are_exchanged_once_and_not_written(spark):
    rng = random.Random(9)
    base = [["w%d" % rng.randrange(10**7) for _ in range(4000)] for _ in range(12)]
    rows = [(i, " ".join(b + ["end"] * (i % 2))) for i, b in enumerate(b for b in base for _ in range(2))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    store, none = spark._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        spark._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        found = store.stageList(None, False, False, none, None)
        return {s.stageId(): s.shuffleWriteBytes() + s.outputBytes() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    got = {r[0]: r[2] for r in ngram_join.jaccard_components(df, 3, 9, 10).collect()}
    assert got == {i: i // 2 * 2 for i in range(24)}
    sets = 24 * 4000 * 8
    assert sum(n for k, n in stages().items() if k not in before) < 3 * sets
