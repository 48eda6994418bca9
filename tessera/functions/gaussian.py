"""Column expressions for normal densities and log-space sums."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_logpdf(x: Column, mean: float, std: float) -> Column:
    z = (x - F.lit(float(mean))) / F.lit(float(std))
    return F.lit(-0.5) * z * z - F.lit(math.log(std * math.sqrt(2 * math.pi)))


def normal_pdf(x: Column, mean: float, std: float) -> Column:
    return F.exp(normal_logpdf(x, mean, std))


def mv_logpdf(xs: Sequence[Column], mean: np.ndarray, cov: np.ndarray) -> Column:
    """Log density with literal parameters; the precision's triangular factor is made here, once."""
    d = len(xs)
    factor = np.linalg.inv(np.linalg.cholesky(cov))
    centred = [x - F.lit(float(m)) for x, m in zip(xs, mean, strict=True)]
    square = F.lit(0.0)
    for r in range(d):
        row = sum((F.lit(float(factor[r, c])) * centred[c] for c in range(r + 1)), F.lit(0.0))
        square = square + row * row
    const = -0.5 * d * math.log(2 * math.pi) + float(np.log(np.diag(factor)).sum())
    return F.lit(const) - F.lit(0.5) * square


def log_sum_exp(values: Column) -> Column:
    """Of an array column, shifted by its greatest element."""
    top = F.array_max(values)
    return top + F.ln(F.aggregate(F.transform(values, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v))


def argmax(values: Column) -> Column:
    """The 0-based place of the first greatest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
