"""Control arms that train: many softmax regressions over the same rows at once.

A row has one label a model (an arm under a seed); a label below 0 keeps the
row out of that model.  Each iteration is one scan that sums the gradients of
all models and brings (models) x (classes) x (features) numbers to the driver,
however many rows there are.  The curvature of the loss is bounded by one
matrix of the features, which is summed once a model, so steps need no line
search; they are accelerated, with a restart where the gradient points back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _rows(batch, features: str, labels: str) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(batch.column(features).to_pylist(), float)
    return np.column_stack([x, np.ones(len(x))]), np.array(batch.column(labels).to_pylist(), np.int64)


def _summed(rows: DataFrame, features: str, labels: str, part, size: int) -> np.ndarray:
    """The sum of ``part(x, y)`` (``size`` numbers) over all batches: one row a task and number, summed before the driver sees it."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                s = part(*_rows(b, features, labels))
                total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["i", "v"])

    out = np.zeros(size)
    for r in rows.select(features, labels).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def fit_models(rows: DataFrame, features: str, labels: str, classes: int, models: int, reg: float = 1e-3, iterations: int = 60, tolerance: float = 1e-5) -> np.ndarray:
    """Weights (models, classes, features + 1; the last is the intercept) of least mean loss plus reg / 2 times the
    squared weights of features scaled to unit spread, intercepts aside: the penalty of Spark ML's regression.

    ``rows``: ``features`` (array of numbers) and ``labels`` (array of ints, one a model); read once an iteration, so it
    should be a written table.
    """
    width = len(rows.select(features).first()[0]) + 1

    def moments(x, y):
        on = y >= 0
        return np.concatenate([(on.T.astype(float) @ x).ravel(), (on.T.astype(float) @ (x * x)).ravel(), *((x * on[:, m : m + 1]).T @ x for m in range(models))], axis=None)

    s = _summed(rows, features, labels, moments, 2 * models * width + models * width * width)
    first, second = s[: models * width].reshape(models, width), s[models * width : 2 * models * width].reshape(models, width)
    gram = s[2 * models * width :].reshape(models, width, width)
    n = np.maximum(first[:, -1], 1)[:, None]
    spread = np.sqrt(np.maximum(second - first**2 / n, 0) / np.maximum(n - 1, 1))
    scale = np.where(spread > 0, spread, 1)
    scale[:, -1] = 1
    penalty = np.full(width, reg)
    penalty[-1] = 1e-9
    # the loss's curvature is at most half of the features' (Böhning), which one inverse a model takes into account
    step = np.linalg.inv(gram / n[:, :, None] / scale[:, :, None] / scale[:, None, :] / 2 + np.stack([np.diag(penalty)] * models))

    w = ahead = np.zeros((models, classes, width))
    pace = np.ones(models)
    for _ in range(iterations):
        plain = ahead / scale[:, None, :]

        def gradient(x, y, plain=plain):
            out = np.zeros((models, classes, width))
            for m in range(models):
                on = y[:, m] >= 0
                z = x[on] @ plain[m].T
                p = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(p)), y[on, m]] -= 1
                out[m] = p.T @ x[on]
            return out.ravel()

        g = _summed(rows, features, labels, gradient, w.size).reshape(w.shape) / n[:, :, None] / scale[:, None, :] + ahead * penalty
        new = ahead - g @ step
        back = ((new - w) * g).sum(axis=(1, 2)) > 0  # the last move went uphill
        pace = np.where(back, 1, pace)
        faster = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        ahead = new + ((pace - 1) / faster)[:, None, None] * (new - w)
        w, pace = new, faster
        if np.abs(g).max() < tolerance:
            break
    return w / scale[:, None, :]


def accuracy_of_models(rows: DataFrame, features: str, truths: str, weights: np.ndarray) -> DataFrame:
    """model, rows, accuracy: ``truths`` has one class a model, below 0 where a row is not asked of it."""
    models = len(weights)

    def count(x, y):
        out = np.zeros((models, 2))
        for m in range(models):
            on = y[:, m] >= 0
            out[m] = on.sum(), ((x[on] @ weights[m].T).argmax(axis=1) == y[on, m]).sum()
        return out.ravel()

    s = _summed(rows, features, truths, count, 2 * models).reshape(models, 2)
    return rows.sparkSession.createDataFrame([(m, int(a), float(b / a) if a else None) for m, (a, b) in enumerate(s.tolist())], "model int, rows long, accuracy double")


def train_arms(rows: DataFrame, features: str, key: str, label: str, classes: int, seeds: list[int], root: str, held: int = 4, **fit) -> DataFrame:
    """arm, seed, value: the accuracy on held-out rows of models that were trained on the real labels and on shuffled ones.

    Under each seed every ``held``-th row by a hash is held out of both arms; the
    shuffled arm's labels are permuted among all rows, and both arms answer to
    the real labels.  ``root`` is a new folder for the labelled rows.
    """
    from fieldlab.operators.dataset import shuffled_labels

    real = F.col(label).cast("int")
    out = rows.where(F.col(label).isNotNull() & F.col(features).isNotNull())
    base, columns = out.select(key, features, real.alias("real")), []
    for seed in seeds:
        control = shuffled_labels(out, key, label, seed).select(key, F.col("control").cast("int").alias(f"c{seed}"))
        base = base.join(control, key)
        away = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(held)) == 0
        columns += [(away, F.col("real")), (away, F.col(f"c{seed}"))]
    labelled = base.select(features, F.array(*(F.when(away, -1).otherwise(c) for away, c in columns)).alias("labels"), F.array(*(F.when(away, F.col("real")).otherwise(-1) for away, _ in columns)).alias("truths"))
    labelled.write.parquet(f"{root}/rows")
    labelled = rows.sparkSession.read.parquet(f"{root}/rows")
    weights = fit_models(labelled, features, "labels", classes, 2 * len(seeds), **fit)
    found = accuracy_of_models(labelled, features, "truths", weights)
    return found.select(F.when(F.col("model") % 2 == 0, "real").otherwise("shuffled").alias("arm"), F.get(F.array(*map(F.lit, seeds)), F.floor(F.col("model") / 2).cast("int")).alias("seed"), F.col("accuracy").alias("value"))
