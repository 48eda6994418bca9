import itertools

import numpy as np

from tessera.operators import evaluate, gmm


def three(spark, n=600):
    return gmm.synthetic(spark, gmm.Mixture.manual([(-10, -10), (0, 10), (10, -10)], None, [0.8 * np.eye(2)] * 3), n).cache()


def numpy_round(x, m, ridge=1e-6):
    k, d = m.means.shape
    lp = np.stack([np.log(m.weights[j]) - 0.5 * np.einsum("na,ab,nb->n", x - m.means[j], np.linalg.inv(m.covs[j]), x - m.means[j]) - 0.5 * np.linalg.slogdet(2 * np.pi * m.covs[j])[1] for j in range(k)], 1)
    lse = np.logaddexp.reduce(lp, 1)
    r = np.exp(lp - lse[:, None])
    nk = r.sum(0)
    means = r.T @ x / nk[:, None]
    covs = np.array([(r[:, j, None] * (x - means[j])).T @ (x - means[j]) / nk[j] + ridge * np.eye(d) for j in range(k)])
    return gmm.Mixture(nk / len(x), means, covs), lse.sum()


def test_round_is_the_two_pass_round(spark):
    p = three(spark)
    shifted = p.selectExpr("id", "transform(features, v -> v + 1000) as features", "label")
    x = np.array([r["features"] for r in shifted.collect()])
    start = gmm.Mixture.manual([(992, 992), (1001, 1008), (1008, 992)], None, [4 * np.eye(2)] * 3)
    want, ll = numpy_round(x, start)
    for arrow in (False, True):
        got = gmm.fit(shifted, start, 1, arrow=arrow)
        assert abs(got.trace[0] - ll) < 1e-6 * abs(ll)
        for a, b in ((got.model.weights, want.weights), (got.model.means, want.means), (got.model.covs, want.covs)):
            np.testing.assert_allclose(a, b, rtol=1e-8, atol=1e-8)


def test_clusters_are_found(spark):
    p = three(spark)
    f = gmm.fit(p, gmm.Mixture.manual([(-8, -8), (1, 8), (8, -8)]), 6)
    assert all(b >= a - 1e-6 for a, b in zip(f.trace, f.trace[1:], strict=False))
    done = gmm.predict(p, f.model)
    assert evaluate.purity(done).first()[0] == 1.0 and abs(f.model.weights - 1 / 3).max() < 0.08
    assert evaluate.ari(done).first()[0] == 1.0 and abs(evaluate.nmi(done).first()[0] - 1) < 1e-12
    assert evaluate.silhouette(done, 2).first()[0] > 0.8


def test_empty_component_takes_all_points(spark):
    p = three(spark, 60)
    m = gmm.fit(p, gmm.Mixture.manual([(0, 0), (1e6, 1e6)], None, [100 * np.eye(2), 1e-3 * np.eye(2)]), 1).model
    np.testing.assert_allclose(m.means[1], m.means[0])
    assert np.isfinite(m.covs).all() and m.weights[1] == 0


def test_one_dimension_never_falls(spark):
    mix = gmm.Mixture.manual([(0,), (5,), (10,), (3,)], [0.3, 0.3, 0.3, 0.1], [[[1]], [[1]], [[1]], [[0.25]]])
    x = gmm.synthetic(spark, mix, 2000).selectExpr("id", "features[0] as x").cache()
    params, trace = gmm.fit_1d(x, [0.25] * 4, [-1, -3, 11, 4], [1, 1, 1, 1], 6)
    assert all(b >= a - 1e-6 for a, b in zip(trace, trace[1:], strict=False)) and abs(sum(p[0] for p in params) - 1) < 1e-9


def test_inits_are_seeded(spark):
    p = three(spark)
    a, b = gmm.init_plus_plus(p, 3, 5), gmm.init_plus_plus(p.repartition(7), 3, 5)
    np.testing.assert_array_equal(a.means, b.means)
    assert len({tuple(m) for m in a.means}) == 3


def test_purity_by_hand(spark):
    rows = spark.createDataFrame([(i, p, q) for i, (p, q) in enumerate(zip([0, 0, 1, 1, 1], [0, 0, 1, 1, 0], strict=True))], "id int, pred int, label int")
    assert evaluate.purity(rows).first()[0] == 0.8


def test_assignment_is_the_best_permutation():
    rng = np.random.default_rng(0)
    for _ in range(60):
        k = int(rng.integers(1, 7))
        cost = rng.integers(-9, 9, (k, k)).astype(float)
        got = evaluate.hungarian(cost)
        assert sorted(got) == list(range(k))
        assert sum(cost[i, c] for i, c in enumerate(got)) == min(sum(cost[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(k)))


def test_stabilised():
    bad = np.array([[1.0, 2.0], [2.0, 1.0]])
    np.linalg.cholesky(gmm.stabilised(bad))
    assert gmm.condition_number(np.diag([4.0, 1.0])) == 4 and gmm.regularised(np.zeros((2, 2)), 0.5)[0, 0] == 0.5
