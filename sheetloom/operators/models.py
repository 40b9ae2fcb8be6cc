"""Small models fitted by sums over the rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import sigmoid


def standardised(rows: DataFrame, features: list[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """rows with features as z-scores, and each feature's mean and deviation."""
    m = rows.agg(*(F.avg(f).alias(f"m{i}") for i, f in enumerate(features)), *(F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features))).first()
    stats = {f: (m[f"m{i}"] or 0.0, m[f"s{i}"] or 1.0) for i, f in enumerate(features)}
    return rows.withColumns({f: (F.col(f) - a) / b for f, (a, b) in stats.items()}), stats


def fit_logistic(rows: DataFrame, features: list[str], gold: str, l2: float = 0.002, steps: int = 8) -> list[float]:
    """Weights (bias first) of a class-balanced ridge logistic model by Newton steps; each step is one pass of sums."""
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.col(gold) == 1).alias("p")).first()
    if not n["p"] or n["p"] == n["n"]:
        return [0.0] * (len(features) + 1)
    weight = F.when(F.col(gold) == 1, n["n"] / (2 * n["p"])).otherwise(n["n"] / (2 * (n["n"] - n["p"])))
    x, w = [F.lit(1.0), *(F.col(f).cast("double") for f in features)], np.zeros(len(features) + 1)
    k = len(x)
    for _ in range(steps):
        z = sum((float(wi) * xi for wi, xi in zip(w, x, strict=True)), F.lit(0.0))
        p = sigmoid(z)
        base = rows.select(*(xi.alias(f"x{i}") for i, xi in enumerate(x)), (weight * (F.col(gold) - p)).alias("e"), (weight * p * (1 - p)).alias("h"))
        s = base.agg(*(F.sum(F.col("e") * F.col(f"x{i}")).alias(f"g{i}") for i in range(k)), *(F.sum(F.col("h") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k))).first()
        grad = np.array([s[f"g{i}"] for i in range(k)]) - l2 * n["n"] * w
        hess = np.array([[s[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + l2 * n["n"] * np.eye(k)
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def score_logistic(rows: DataFrame, features: list[str], weights: list[float]) -> DataFrame:
    z = sum((w * F.col(f) for w, f in zip(weights[1:], features, strict=True)), F.lit(weights[0]))
    return rows.withColumn("score", sigmoid(z))
