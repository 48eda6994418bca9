import random

import pytest

from tessera.operators import graph
from tessera.sources import io


def levels(df):
    return {r["vertex"]: r["level"] for r in df.collect()}


def dists(df):
    return {r["vertex"]: r["dist"] for r in df.collect()}


CYCLE = [(0, 1), (1, 2), (1, 5), (2, 5), (2, 3), (3, 5), (3, 4), (5, 4)]
FIVE = [(0, 1), (0, 4), (1, 4), (1, 2), (4, 3), (2, 3), (2, 4)]


@pytest.mark.parametrize(
    "edges, source, want",
    [(CYCLE, 0, {0: 0, 1: 1, 2: 2, 5: 2, 3: 3, 4: 3}), (FIVE, 0, {0: 0, 1: 1, 4: 1, 2: 2, 3: 2}), (FIVE, 4, {4: 0, 0: 1, 1: 1, 3: 1, 2: 1})],
)
def test_levels(spark, edges, source, want):
    assert levels(graph.bfs_levels(graph.undirect(io.inline_edges(spark, edges)), source)) == want


def test_rejected_edges(spark):
    edges = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (0, 5), (1, 6), (2, 7), (3, 8), (4, 9)]
    good, bad = graph.reject_edges(io.inline_edges(spark, edges), 5)
    assert bad.count() == 6
    assert levels(graph.bfs_levels(graph.undirect(good), 0)) == {i: i for i in range(5)}


@pytest.mark.parametrize("delta", [None, 1, 5, 20, 1000])
def test_distances_do_not_depend_on_delta(spark, delta):
    edges = io.inline_edges(spark, [(0, 1, 3), (1, 2, 3), (2, 3, 3), (0, 3, 100)])
    assert dists(graph.sssp(edges, 0, delta)) == {0: 0, 1: 3, 2: 6, 3: 9}


def test_random_graph_against_dijkstra(spark):
    import heapq

    rng = random.Random(4)
    edges = [(u, v, rng.randint(0, 30)) for u in range(25) for v in range(u + 1, 25) if rng.random() < 0.12]
    near = {}
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))
    want, heap = {}, [(0, 0)]
    while heap:
        d, u = heapq.heappop(heap)
        if u not in want:
            want[u] = d
            for v, w in near.get(u, []):
                heapq.heappush(heap, (d + w, v))
    both = graph.undirect(io.inline_edges(spark, edges))
    assert dists(graph.sssp(both, 0)) == want
    assert dists(graph.sssp(both, 0, 7)) == want


def test_unreachable_and_rendering(spark):
    d = graph.sssp(graph.undirect(io.inline_edges(spark, [(0, 1), (2, 3)])), 0)
    full = graph.dense(d, 3)
    assert dists(full) == {0: 0, 1: 1, 2: None, 3: None}
    assert {r["line"] for r in graph.render(full).collect()} == {"To 0: 0", "To 1: 1", "To 2: INF", "To 3: INF"}


def test_negative_weights_are_refused(spark):
    with pytest.raises(ValueError):
        graph.sssp(io.inline_edges(spark, [(0, 1, -1)]), 0)


def test_differences(spark):
    a = spark.createDataFrame([(0, 0), (1, 5), (2, None), (3, 7)], "vertex long, dist long")
    b = spark.createDataFrame([(0, 0), (1, 6), (2, None), (4, 1)], "vertex long, dist long")
    assert {(r["vertex"], r["kind"]) for r in graph.diff_distances(a, b).collect()} == {(1, "mismatch"), (3, "missing"), (4, "extra")}


def test_adjacency_of_a_file(spark, tmp_path):
    path = tmp_path / "edges.txt"
    path.write_text("# comment\n0 1\n0 2\n\n0 4\n1 2\n1 3\n2 3\nbad line\n3 4\n2 4")
    e = io.read_edges(spark, str(path), directed=False, weighted=False)
    got = {r["src"]: list(r["neighbours"]) for r in graph.adjacency(e).collect()}
    assert got == {0: [1, 2, 4], 1: [0, 2, 3], 2: [0, 1, 3, 4], 3: [1, 2, 4], 4: [0, 2, 3]} and e.count() == 16


def test_random_graph_is_deterministic(spark):
    a = graph.random_graph(spark, 40, 0.2)
    rows = sorted(map(tuple, a.collect()))
    assert rows == sorted(map(tuple, graph.random_graph(spark, 40, 0.2).repartition(3).collect()))
    assert all(u < v and 1 <= w <= 100 for u, v, w in rows) and 80 < len(rows) < 240
