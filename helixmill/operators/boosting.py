"""Component-wise boosting of a logistic model, and how stable its choice of features is.

A round fits every feature alone to the residuals and moves the model a short step along the best one. All features of all bootstraps of the samples take their round in one pass: tasks add up residuals times features, and the driver moves a coefficient a bootstrap. A bootstrap gives each sample a Poisson weight by a hash of its id, so weights are the same on any partitioning and no sample is copied. Each bootstrap keeps the round of least AIC (deviance plus twice the features in the model) and ends ``patience`` rounds after it.

Defined cases: samples with a missing value or feature are left out; features that do not vary are never chosen; of equally good features the first by name is taken; without both classes there is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.operators import models
from helixmill.operators.transforms import uniform
from helixmill.sources import stores

#: Upper ends of the shares of 0, 1, ... 6 in a Poisson distribution of mean 1; the rest is 7.
POISSON = tuple(float(x) for x in np.cumsum(np.exp(-1) / np.cumprod([1, 1, 2, 3, 4, 5, 6])))


def weighted(data: DataFrame, bootstraps: int, seed: int) -> DataFrame:
    """``data`` (sample_id, label, x) with w: 1 for the table itself, then a weight for each bootstrap."""
    u = lambda b: uniform(seed, "bootstrap", b, F.col("sample_id"))
    draw = lambda b: sum((F.when(u(b) >= end, 1).otherwise(0) for end in POISSON), F.lit(0))
    return data.withColumn("w", F.concat(F.array(F.lit(1)), F.transform(F.sequence(F.lit(1), F.lit(bootstraps)), draw)) if bootstraps else F.array(F.lit(1)))


def paths(long: DataFrame, bootstraps: int = 20, rounds: int = 100, step: float = 0.1, patience: int = 10, seed: int = 1) -> tuple[list[str], np.ndarray]:
    """Features, and the kept coefficients of standardised features, a column for the table itself and for each bootstrap."""
    spark = long.sparkSession
    data, names = models.vectors(long)
    seen = data.agg(Summarizer.metrics("mean", "std").summary(F.col("x")).alias("s"), F.count("*").alias("n"), F.sum("label").alias("y")).first()
    if not 0 < (seen.y or 0) < seen.n:
        raise ValueError("both classes are needed")
    mean, std = seen.s.mean.toArray(), seen.s.std.toArray()
    scale, p, k = np.where(std > 0, std, 1.0), len(names), bootstraps + 1
    path = stores.new_folder(spark, "boosting")
    rows = stores.written(weighted(data, bootstraps, seed).select(F.col("label").alias("y"), vector_to_array("x").alias("x"), "w"), path)

    def total(of) -> np.ndarray:
        def add(batches):
            held = None
            for batch in batches:
                n = batch.num_rows
                x = (batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, p) - mean) / scale
                new = of(x, batch.column(0).to_numpy()[:, None], batch.column(2).flatten().to_numpy().reshape(n, k).astype(float))
                held = new if held is None else held + new
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(held).tobytes()], pa.binary())], ["sums"])

        return sum(np.frombuffer(r.sums).reshape(-1, k) for r in rows.mapInArrow(add, "sums binary").toLocalIterator())  # one task's at a time

    try:
        first = total(lambda x, y, w: np.vstack([(x * x).T @ w, w.sum(0), (w * y).sum(0)]))
        size, n, cases = first[:p], first[p], np.clip(first[p + 1], 0.5, first[p] - 0.5)
        base, beta = np.log(cases / (n - cases)), np.zeros((p, k))
        best, kept, since, open_ = np.full(k, np.inf), beta.copy(), np.zeros(k, int), np.ones(k, bool)
        for _ in range(rounds + 1):

            def residuals(x, y, w, beta=beta):
                eta = base + x @ beta
                left = w * (y - (0.5 + 0.5 * np.tanh(eta / 2)))
                return np.vstack([x.T @ left, (2 * w * np.logaddexp(0.0, np.where(y == 1, -eta, eta))).sum(0)])

            told = total(residuals)
            aic = told[p] + 2 * (beta != 0).sum(0)
            better = open_ & (aic < best - 1e-9)
            best, kept, since = np.where(better, aic, best), np.where(better, beta, kept), np.where(better, 0, since + 1)
            open_ &= since < patience
            if not open_.any():
                break
            gain = np.where(size > 1e-9, told[:p] ** 2 / np.maximum(size, 1e-9), 0.0)
            at = np.round(gain, 9).argmax(0)
            move = np.where(open_ & (gain.max(0) > 0), step * 4 * told[at, np.arange(k)] / np.maximum(size[at, np.arange(k)], 1e-9), 0.0)
            beta = beta.copy()
            beta[at, np.arange(k)] += move
    finally:
        stores.remove(spark, path)
    return names, kept


def stability(long: DataFrame, least: float = 0.5, **more) -> DataFrame:
    """(rank, feature, share, coefficient): features that at least a share ``least`` of the bootstraps choose, with their standardised coefficient in the model of all samples (0 if that lacks them)."""
    names, kept = paths(long, **more)
    share = (kept[:, 1:] != 0).mean(1)
    rows = sorted(((f, float(s), float(c)) for f, s, c in zip(names, share, kept[:, 0], strict=True) if s >= least), key=lambda r: (-round(r[1], 12), -abs(r[2]), r[0]))
    return long.sparkSession.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "rank int, feature string, share double, coefficient double")
