"""Gaussian mixtures by expectation-maximisation, in one and in many dimensions.

The parameters (K components, small) live on the driver and go into each round's plan as literals; a round is one
aggregation of sufficient statistics over the points, summed in each task before anything is exchanged. Beyond
``INLINE`` terms (K * D * D) the statistics are made per Arrow batch with NumPy instead of in generated code.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.gaussian import argmax, log_sum_exp, mv_logpdf, normal_logpdf, normal_pdf, squared_distance
from tessera.lineage import ship

#: Largest K * D * D whose statistics are generated code.
INLINE = 200


@dataclass
class Mixture:
    """weights (K), means (K, D), covs (K, D, D)."""

    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray

    @staticmethod
    def manual(means, weights=None, covs=None) -> Mixture:
        """Given parameters: weights are normalised (equal if missing), covariances are the identity if missing."""
        means = np.asarray(means, float)
        k, d = means.shape
        w = np.ones(k) if weights is None else np.asarray(weights, float)
        c = np.repeat(np.eye(d)[None], k, 0) if covs is None else np.asarray(covs, float)
        return Mixture(w / w.sum(), means, c)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, float(w), m.tolist(), c.tolist()) for k, (w, m, c) in enumerate(zip(self.weights, self.means, self.covs, strict=True))]
        return spark.createDataFrame(rows, "component int, weight double, mean array<double>, cov array<array<double>>")


def _xs(d: int, column: str = "features") -> list[Column]:
    return [F.get(F.col(column), k) for k in range(d)]


def log_densities(model: Mixture) -> Column:
    """Array of ln(weight * density) per component, of a ``features`` column."""
    xs = _xs(model.means.shape[1])
    tiny = 1e-300
    return F.array(*[mv_logpdf(xs, m, c) + F.lit(math.log(max(w, tiny))) for w, m, c in zip(model.weights, model.means, model.covs, strict=True)])


def responsibilities(points: DataFrame, model: Mixture) -> DataFrame:
    """Points with ``lse`` (log likelihood of the row) and ``resp`` (array of K shares), in log space."""
    logged = points.withColumn("_lp", log_densities(model))
    return logged.withColumn("lse", log_sum_exp(F.col("_lp"))).withColumn("resp", F.transform("_lp", lambda v: F.exp(v - F.col("lse")))).drop("_lp")


def predict(points: DataFrame, model: Mixture) -> DataFrame:
    return points.withColumn("pred", argmax(log_densities(model)))


def _inline_stats(points: DataFrame, model: Mixture, centre: np.ndarray) -> dict:
    k, d = model.means.shape
    rows = responsibilities(points, model)
    rows = rows.select("lse", *[F.get("resp", j).alias(f"r{j}") for j in range(k)], *[(x - F.lit(float(c))).alias(f"x{i}") for i, (x, c) in enumerate(zip(_xs(d), centre, strict=True))])
    aggs = [F.sum("lse").alias("ll"), F.count(F.lit(1)).alias("n")]
    for j in range(k):
        r = F.col(f"r{j}")
        aggs.append(F.sum(r).alias(f"n{j}"))
        for a in range(d):
            aggs.append(F.sum(r * F.col(f"x{a}")).alias(f"s{j}_{a}"))
            aggs += [F.sum(r * F.col(f"x{a}") * F.col(f"x{b}")).alias(f"q{j}_{a}_{b}") for b in range(a + 1)]
    got = rows.agg(*aggs).first().asDict()
    first = np.array([[got[f"s{j}_{a}"] for a in range(d)] for j in range(k)], float)
    second = np.array([[[got[f"q{j}_{max(a, b)}_{min(a, b)}"] for b in range(d)] for a in range(d)] for j in range(k)], float)
    return {"ll": got["ll"], "n": got["n"], "nk": np.array([got[f"n{j}"] for j in range(k)], float), "first": first, "second": second}


def _arrow_stats(points: DataFrame, model: Mixture, centre: np.ndarray) -> dict:
    k, d = model.means.shape
    factors = [np.linalg.inv(np.linalg.cholesky(c)) for c in model.covs]
    consts = [math.log(max(w, 1e-300)) - 0.5 * d * math.log(2 * math.pi) + np.log(np.diag(f)).sum() for w, f in zip(model.weights, factors, strict=True)]
    means = model.means

    def run(batches):
        ll, n, nk, first, second = 0.0, 0, np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d))
        for batch in batches:
            x = np.asarray(batch.column("features").flatten()).reshape(-1, d)
            lp = np.stack([c - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for c, m, f in zip(consts, means, factors, strict=True)], 1)
            top = lp.max(1, keepdims=True)
            lse = top + np.log(np.exp(lp - top).sum(1, keepdims=True))
            r, y = np.exp(lp - lse), x - centre
            ll, n, nk = ll + lse.sum(), n + len(x), nk + r.sum(0)
            first += r.T @ y
            second += np.einsum("nk,na,nb->kab", r, y, y, optimize=True)
        flat = np.concatenate([[ll, n], nk, first.ravel(), second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["at", "v"])

    ship(points.sparkSession)
    rows = points.select("features").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    v = np.array([r["v"] for r in rows])
    return {"ll": v[0], "n": int(v[1]), "nk": v[2 : 2 + k], "first": v[2 + k : 2 + k + k * d].reshape(k, d), "second": v[2 + k + k * d :].reshape(k, d, d)}


def global_mean(points: DataFrame, d: int) -> np.ndarray:
    return np.array(points.agg(*[F.avg(x) for x in _xs(d)]).first(), float)


def pooled_covariance(points: DataFrame, d: int) -> DataFrame:
    """``(i, j, cov)``: sample covariance of the features."""
    xs = _xs(d)
    one = points.agg(*[F.covar_samp(xs[i], xs[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(d)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("cov")) for i in range(d) for j in range(d)])).alias("e")).select("e.*")


def em_round(points: DataFrame, model: Mixture, centre: np.ndarray, ridge: float = 1e-6, arrow: bool | None = None) -> tuple[Mixture, float]:
    """The next parameters, and the log likelihood of the given ones.

    A component without mass gets the mean and covariance of all points.
    """
    k, d = model.means.shape
    use_arrow = k * d * d > INLINE if arrow is None else arrow
    s = (_arrow_stats if use_arrow else _inline_stats)(points, model, centre)
    means, covs = np.zeros((k, d)), np.zeros((k, d, d))
    total1, total2 = s["first"].sum(0) / s["n"], s["second"].sum(0) / s["n"]
    for j in range(k):
        if s["nk"][j] > 1e-12:
            m = s["first"][j] / s["nk"][j]
            c = s["second"][j] / s["nk"][j] - np.outer(m, m)
        else:
            m, c = total1, total2 - np.outer(total1, total1)
        means[j], covs[j] = m + centre, stabilised(c + ridge * np.eye(d))
    return Mixture(s["nk"] / s["n"], means, covs), float(s["ll"])


def stabilised(cov: np.ndarray) -> np.ndarray:
    """cov if it has a Cholesky factor; else with a stronger and stronger ridge; at last isotropic."""
    cov = (cov + cov.T) / 2
    size = max(float(np.trace(cov)) / len(cov), 1e-12)
    for ridge in (0.0, 1e-6, 1e-4, 1e-2):
        try:
            np.linalg.cholesky(cov + ridge * size * np.eye(len(cov)))
            return cov + ridge * size * np.eye(len(cov))
        except np.linalg.LinAlgError:
            continue
    return size * np.eye(len(cov))


def regularised(cov: np.ndarray, least: float) -> np.ndarray:
    """A ridge of ``least`` where the smallest eigenvalue is below it."""
    return cov + least * np.eye(len(cov)) if np.linalg.eigvalsh(cov).min() < least else cov


def condition_number(cov: np.ndarray) -> float:
    s = np.linalg.svd(cov, compute_uv=False)
    return float(s[0] / s[-1]) if s[-1] > 0 else math.inf


@dataclass
class Fit:
    model: Mixture
    trace: list[float]  # log likelihood of the parameters that enter each round
    history: list[Mixture]

    @property
    def best(self) -> float:
        return max(self.trace)

    def trace_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, float(v)) for i, v in enumerate(self.trace)], "iteration int, log_likelihood double")

    def history_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, k, float(m.weights[k]), m.means[k].tolist(), m.covs[k].tolist()) for i, m in enumerate(self.history) for k in range(len(m.weights))]
        return spark.createDataFrame(rows, "iteration int, component int, weight double, mean array<double>, cov array<array<double>>")


def fit(points: DataFrame, model: Mixture, rounds: int, ridge: float = 1e-6, tolerance: float | None = None, patience: int = 3, arrow: bool | None = None) -> Fit:
    """Rounds of EM from given parameters; stops early after ``patience`` changes of the log likelihood below tolerance."""
    centre = global_mean(points, model.means.shape[1])
    out, quiet = Fit(model, [], [model]), 0
    for _ in range(rounds):
        model, ll = em_round(points, model, centre, ridge, arrow)
        quiet = quiet + 1 if tolerance is not None and out.trace and abs(ll - out.trace[-1]) < tolerance else 0
        out.trace.append(ll)
        out.history.append(model)
        out.model = model
        if tolerance is not None and quiet >= patience:
            break
    return out


def hash_rows(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """k rows picked by a hash of their id: the same on any partitioning."""
    return np.array([r["features"] for r in points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k).collect()], float)


def init_random(points: DataFrame, k: int, seed: int) -> Mixture:
    """k distinct rows as means; the pooled covariance plus a seeded ridge between 0.1 and 1."""
    means = hash_rows(points, k, seed)
    d = means.shape[1]
    cov = np.array([[r["cov"] for r in pooled_covariance(points, d).orderBy("i", "j").collect()]], float).reshape(d, d)
    ridges = np.random.default_rng(seed).uniform(0.1, 1, k)
    return Mixture.manual(means, None, [cov + r * np.eye(d) for r in ridges])


def init_plus_plus(points: DataFrame, k: int, seed: int) -> Mixture:
    """k-means++: each next mean is drawn with a chance in proportion to its squared distance from the means so far.

    The draw gives each row the key -ln(u) / distance with u from a hash of its id, and takes the least.
    """
    means = hash_rows(points, 1, seed)
    for step in range(1, k):
        near = F.array_min(F.array(*[squared_distance(F.col("features"), F.array(*[F.lit(float(v)) for v in m])) for m in means]))
        unit = (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed + step)), 11) + 0.5) / F.lit(float(1 << 53))
        key = F.when(near > 0, -F.ln(unit) / near)
        means = np.vstack([means, np.array(points.withColumn("_key", key).orderBy(F.col("_key").asc_nulls_last(), "id").first()["features"], float)])
    d = means.shape[1]
    cov = np.array([r["cov"] for r in pooled_covariance(points, d).orderBy("i", "j").collect()], float).reshape(d, d) + 1e-6 * np.eye(d)
    return Mixture.manual(means, None, [cov] * k)


def fit_best(points: DataFrame, k: int, rounds: int, seeds: Sequence[int], **options) -> Fit:
    """The best of several starts by log likelihood."""
    return max((fit(points, init_random(points, k, s), rounds, **options) for s in seeds), key=lambda f: f.trace[-1])


# ---- one dimension: standard deviations, no ridge, log likelihood after each round


def fit_1d(points: DataFrame, weights, means, stds, rounds: int, tolerance: float | None = None) -> tuple[list[tuple[float, float, float]], list[float]]:
    """((weight, mean, std) per component, log likelihood after each round) of points (id, x)."""
    k = len(weights)
    params = [(float(w), float(m), float(s)) for w, m, s in zip(weights, means, stds, strict=True)]
    centre = float(points.agg(F.avg("x")).first()[0])
    trace: list[float] = []

    def stats(params):
        lp = F.array(*[normal_logpdf(F.col("x"), m, s) + F.lit(math.log(max(w, 1e-300))) for w, m, s in params])
        rows = points.withColumn("_lp", lp).withColumn("_lse", log_sum_exp(F.col("_lp"))).withColumn("_y", F.col("x") - F.lit(centre))
        r = [F.exp(F.get("_lp", j) - F.col("_lse")) for j in range(k)]
        aggs = [F.sum("_lse"), F.count(F.lit(1))]
        for j in range(k):
            aggs += [F.sum(r[j]), F.sum(r[j] * F.col("_y")), F.sum(r[j] * F.col("_y") * F.col("_y"))]
        return list(rows.agg(*aggs).first())

    got = stats(params)
    for _ in range(rounds):
        n = got[1]
        params = []
        for j in range(k):
            nk, s1, s2 = got[2 + 3 * j : 5 + 3 * j]
            m = s1 / nk
            params.append((nk / n, m + centre, math.sqrt(max(s2 / nk - m * m, 1e-300))))
        got = stats(params)
        trace.append(float(got[0]))
        if tolerance is not None and len(trace) > 1 and abs(trace[-1] - trace[-2]) < tolerance:
            break
    return params, trace


def density_grid(spark: SparkSession, params, low: float, high: float, n: int = 1000) -> DataFrame:
    """``(i, x, density)`` of a one-dimensional mixture on n evenly spaced places."""
    x = F.lit(float(low)) + F.col("i") * F.lit((high - low) / (n - 1))
    total = sum((F.lit(float(w)) * normal_pdf(F.col("x"), m, s) for w, m, s in params), F.lit(0.0))
    return spark.range(n).select(F.col("id").alias("i")).withColumn("x", x).withColumn("density", total)


# ---- comparison and data


def match_components(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(component, match, distance, cov_distance, weight_diff)``: for each component of a the nearest mean of b.

    Both have K rows.
    """
    left = a.select("component", F.col("weight").alias("wa"), F.col("mean").alias("ma"), F.flatten("cov").alias("ca"))
    right = b.select(F.col("component").alias("match"), F.col("weight").alias("wb"), F.col("mean").alias("mb"), F.flatten("cov").alias("cb"))
    pairs = left.crossJoin(F.broadcast(right)).withColumn("distance", F.sqrt(squared_distance(F.col("ma"), F.col("mb"))))
    best = F.min(F.struct("distance", "match", F.sqrt(squared_distance(F.col("ca"), F.col("cb"))).alias("cov_distance"), F.abs(F.col("wa") - F.col("wb")).alias("weight_diff"))).alias("b")
    return pairs.groupBy("component").agg(best).select("component", "b.match", "b.distance", "b.cov_distance", "b.weight_diff")


def synthetic(spark: SparkSession, model: Mixture, n: int, seed: int = 42) -> DataFrame:
    """``(id, features, label)``: seeded draws from a mixture of any dimension."""
    k, d = model.means.shape
    steps = np.cumsum(model.weights)
    rows = spark.range(n).withColumn("_u", F.rand(seed))
    label = F.lit(k - 1)
    for j in reversed(range(k - 1)):
        label = F.when(F.col("_u") < F.lit(float(steps[j])), j).otherwise(label)
    rows = rows.withColumn("label", label.cast("int"))
    for a in range(d):
        rows = rows.withColumn(f"_z{a}", F.randn(seed + 1 + a))
    forms = []
    for j in range(k):
        factor = np.linalg.cholesky(model.covs[j])
        forms.append(F.array(*[F.lit(float(model.means[j, a])) + sum((F.lit(float(factor[a, b])) * F.col(f"_z{b}") for b in range(a + 1)), F.lit(0.0)) for a in range(d)]))
    pick = forms[-1]
    for j in reversed(range(k - 1)):
        pick = F.when(F.col("label") == j, forms[j]).otherwise(pick)
    return rows.select("id", pick.alias("features"), "label")


def standardised(points: DataFrame, d: int) -> DataFrame:
    """z scores of every feature (population standard deviation)."""
    xs = _xs(d)
    one = points.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)], *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(xs)])
    return points.crossJoin(F.broadcast(one)).withColumn("features", F.array(*[(x - F.col(f"m{i}")) / F.col(f"s{i}") for i, x in enumerate(xs)])).select(*points.columns)
