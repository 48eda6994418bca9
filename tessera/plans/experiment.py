"""A mixture experiment from end to end: generate, fit, predict, save, evaluate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tessera.operators import evaluate, gmm
from tessera.sources import io


def run(spark: SparkSession, truth: gmm.Mixture, n: int, rounds: int, path: str, seed: int = 42) -> DataFrame:
    """One row of measures; data, labels, predictions, model and trace are left as tables below ``path``.

    The fit starts from the true means, moved by a tenth of each component's deviation.
    """
    d = truth.means.shape[1]
    io.save_dataset(gmm.synthetic(spark, truth, n, seed), f"{path}/data")
    points = io.load_dataset(spark, f"{path}/data")
    moved = truth.means + 0.1 * np.sqrt(np.stack([np.diag(c) for c in truth.covs]))
    fitted = gmm.fit(points, gmm.Mixture.manual(moved, None, truth.covs), rounds)
    found = gmm.predict(points, fitted.model)
    io.write_labels(points, f"{path}/labels")
    io.write_predictions(found, f"{path}/predictions")
    io.write_model(fitted.model.table(spark), f"{path}/model")
    io.write_trace(fitted.trace_table(spark), f"{path}/trace")
    return evaluate.bundle(found, d)
