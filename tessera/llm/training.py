"""Labelled samples, a linear support vector machine and its calibration, for the classifiers of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the identifier as text, modulo ``folds``; a null identifier has none."""
    return F.crc32(id_col.cast("string")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, may_train: Column, most: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """Texts with a label, ``most`` documents at most, half of them of each class if there are as many; and all training labels by class.

    Only rows where ``may_train`` holds are looked at. The choice follows a hash of the identifier; of several labels
    for one document the largest counts, of several texts the least, so that reruns fit the same model.
    """
    one = labels.where(may_train & F.col(label).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label).cast("int").alias("y")).where("id IS NOT NULL")
    totals = {r.y: r.n for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = (F.xxhash64("id", F.lit(11)), F.col("id"))
    chosen = [one.where(F.col("y") == y).orderBy(*order).limit(max(most // 2, most - totals.get(1 - y, 0))) for y in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # ``most`` rows at most
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(few, "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("id", "text", "y"), totals


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray, passes: int = 12, seed: int = 5) -> np.ndarray:
    """Weights of the L2-regularised hinge-loss model, one dual variable at a time.

    ``rows``: index and value arrays; ``y``: 1 or -1; ``cost``: the upper bound of each dual variable.
    """
    w, alpha = np.zeros(size), np.zeros(len(rows))
    square = np.array([float(v @ v) for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            if not square[i]:
                continue
            at, v = rows[i]
            gradient = y[i] * float(w[at] @ v) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights of the L2-regularised squared-hinge model of few columns, by Newton steps over the rows inside the margin."""
    w = np.zeros(x.shape[1])
    active = np.ones(len(x), bool)
    for _ in range(steps):
        part = x[active] * cost[active, None]
        w = np.linalg.solve(x[active].T @ part + np.eye(x.shape[1]), part.T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 80) -> np.ndarray:
    """Coefficients of the columns of ``x`` and last the constant, by damped Newton steps on the weighted log loss with a small ridge. ``y``: 1 or less."""
    x = np.hstack([x, np.ones((len(x), 1))])
    t, c = (y > 0).astype(float), np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1e-2)
    ridge[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        grad = x.T @ (weight * (p - t)) + ridge * c
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6)
        step = np.linalg.solve(hess, grad)
        size = float(np.abs(step).max())
        c = c - step * min(1.0, 2 / size if size else 1.0)
        if size < 1e-8:
            break
    return c


def calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * margin + b)))."""
    a, b = logistic(margin[:, None], y, weight)
    return float(a), float(b)
