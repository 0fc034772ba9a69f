"""Logistic regression with lasso and elastic-net penalties along a path of penalties, chosen by cross-validation.

All folds' models and a block of penalties take one Newton step a pass: tasks add up weighted Gram matrices of the samples, a model's sums meet in one group, and coordinate descent solves its step there. The driver holds coefficients only. Features are standardised within each model's own training samples, as the penalty asks for; coefficients are for features as given. A step that would raise a model's objective is halved. Features should be some hundreds to thousands: a model's sums are features by features, and ``BYTES`` bounds how many models take part in a pass, not how large one is.

Defined cases: samples with a missing value or feature are left out; a feature that does not vary has coefficient 0; without both classes, or with fewer samples than folds in a class, there is an error. ``fold`` is a Column of sample_id, 0 to ``folds`` - 1; a sample with another or a null fold is in every training part and in no held-out one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.operators import models
from helixmill.sources import stores

#: Bytes of the sums of a pass that a task hands on, samples a partition of the samples' table, and penalties that are fitted together, from the solution of the last one before.
BYTES, ROWS, TOGETHER = 32_000_000, 50_000, 10
#: The least weight of a sample in a step.
LIMIT = 1e-8


@dataclass
class Path:
    """Along ``penalties``: intercepts and coefficients of the model of all samples, mean held-out deviance and its standard error."""

    names: list[str]
    mix: float
    penalties: np.ndarray
    coefficients: np.ndarray
    deviance: np.ndarray
    error: np.ndarray

    @property
    def least(self) -> int:
        return int(self.deviance.argmin())

    @property
    def sparse(self) -> int:
        """The largest penalty within a standard error of the best."""
        return int(np.flatnonzero(self.deviance <= self.deviance[self.least] + self.error[self.least])[0])


class _Samples:
    """Samples as a written table of standardised arrays, and the passes over it."""

    def __init__(self, long: DataFrame, fold, folds: int):
        self.spark, self.folds = long.sparkSession, folds
        data, self.names = models.vectors(long)
        seen = data.agg(Summarizer.metrics("mean", "std").summary(F.col("x")).alias("s"), F.count("*").alias("n"), F.sum("label").alias("y")).first()
        self.n, self.cases = seen.n, seen.y or 0
        if not 0 < self.cases < self.n:
            raise ValueError("both classes are needed")
        self.mean, std = seen.s.mean.toArray(), seen.s.std.toArray()
        self.scale = np.where(std > 0, std, 1.0)
        rows = data.select(F.coalesce(fold, F.lit(-1)).cast("int").alias("fold"), "label", vector_to_array("x").alias("x"))
        self.path = stores.new_folder(self.spark, "penalised")
        self.rows = stores.written(rows.repartition(-(-self.n // ROWS)), self.path)

    def close(self) -> None:
        stores.remove(self.spark, self.path)

    def blocks(self):
        """A function that turns a record batch into (X with a column of ones, labels, folds)."""
        mean, scale = self.mean, self.scale

        def of(batch):
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(mean))
            return np.hstack([np.ones((batch.num_rows, 1)), (x - mean) / scale]), batch.column(1).to_numpy(), batch.column(0).to_numpy()

        return of

    def moments(self) -> np.ndarray:
        """By fold (the last: none) n, sum of labels, and sums of x, x squared and x times label."""
        of, folds, p = self.blocks(), self.folds, len(self.mean)

        def add(batches):
            total = np.zeros((folds + 1, 2 + 3 * p))
            for batch in batches:
                x, y, f = of(batch)
                for k in range(folds + 1):
                    at = f == k if k < folds else (f < 0) | (f >= folds)
                    v, w = x[at, 1:], y[at]
                    total[k] += np.concatenate([[at.sum(), w.sum()], v.sum(0), (v * v).sum(0), w @ v])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        return sum(np.frombuffer(r.sums).reshape(folds + 1, -1) for r in self.rows.mapInArrow(add, "sums binary").toLocalIterator())  # folds by features, one task's at a time

    def pass_over(self, betas: np.ndarray, out: np.ndarray, solve) -> dict[int, tuple]:
        """For each model (a row of ``betas``, whose fold ``out`` is held out) what ``solve(model, n, deviance, gradient target, Gram)`` gives."""
        of, q = self.blocks(), betas.shape[1]
        upper = np.triu_indices(q)

        def add(batches):
            total = np.zeros((len(betas), 2 + q + len(upper[0])))
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    x, y, f = of(batch.slice(at, 2048))
                    eta = x @ betas.T
                    mu = 0.5 + 0.5 * np.tanh(eta / 2)
                    inside = f[:, None] != out[None, :]
                    weight = np.where(inside, np.maximum(mu * (1 - mu), LIMIT), 0.0)
                    target = weight * eta + np.where(inside, y[:, None] - mu, 0.0)
                    loss = 2 * np.where(inside, np.logaddexp(0.0, np.where(y[:, None] == 1, -eta, eta)), 0.0)
                    total[:, 0] += inside.sum(0)
                    total[:, 1] += loss.sum(0)
                    total[:, 2 : 2 + q] += target.T @ x
                    for m in range(len(betas)):
                        total[m, 2 + q :] += (x.T @ (weight[:, m : m + 1] * x))[upper]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(betas), dtype="i4")), pa.array([t.tobytes() for t in total], pa.binary())], ["model", "sums"])

        def step(block: pd.DataFrame) -> pd.DataFrame:
            model, total = int(block["model"].iloc[0]), sum(np.frombuffer(s) for s in block["sums"])
            gram = np.zeros((q, q))
            gram[upper] = total[2 + q :]
            gram = gram + np.triu(gram, 1).T
            return pd.DataFrame({"model": [model], "told": [np.concatenate([[total[0], total[1]], solve(model, total[0], total[1], total[2 : 2 + q], gram)]).tobytes()]})

        got = self.rows.mapInArrow(add, "model int, sums binary").groupBy("model").applyInPandas(step, "model int, told binary").collect()  # coefficients of each model
        return {r.model: np.frombuffer(r.told) for r in got}

    def held_out(self, betas: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By model the samples of its held-out fold, and their deviance."""
        of = self.blocks()

        def add(batches):
            total = np.zeros((2, len(betas)))
            for batch in batches:
                x, y, f = of(batch)
                eta = x @ betas.T
                here = f[:, None] == out[None, :]
                total += [here.sum(0), 2 * np.where(here, np.logaddexp(0.0, np.where(y[:, None] == 1, -eta, eta)), 0.0).sum(0)]
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        n, dev = sum(np.frombuffer(r.sums).reshape(2, -1) for r in self.rows.mapInArrow(add, "sums binary").toLocalIterator())
        return n, dev


def descend(gram: np.ndarray, target: np.ndarray, beta: np.ndarray, lasso: np.ndarray, ridge: np.ndarray, most: int = 2_000, close: float = 1e-16) -> np.ndarray:
    """The minimum of b' G b / 2 - t' b + sum(lasso |b|) + sum(ridge b b) / 2, from ``beta``: sweeps over coordinates find which are other than zero, and these are then solved for together, as far as none changes its sign."""
    beta, left = beta.copy(), target - gram @ beta
    live = np.flatnonzero(np.diag(gram) > 1e-14)
    for _ in range(most):
        moved = 0.0
        for j in live:
            u = left[j] + gram[j, j] * beta[j]
            new = np.sign(u) * max(abs(u) - lasso[j], 0.0) / (gram[j, j] + ridge[j])
            if (d := new - beta[j]) != 0:
                left -= gram[:, j] * d
                beta[j] = new
                moved = max(moved, gram[j, j] * d * d)
        if moved < close:
            break
        on = live[beta[live] != 0]
        while len(on):
            try:
                aim = np.linalg.solve(gram[np.ix_(on, on)] + np.diag(ridge[on]), target[on] - lasso[on] * np.sign(beta[on]))
            except np.linalg.LinAlgError:
                break
            turns = (np.sign(aim) != np.sign(beta[on])) & (lasso[on] > 0)
            if not turns.any():
                beta[on] = aim
                break
            part = np.where(turns, beta[on] / np.where(turns, beta[on] - aim, 1.0), np.inf)
            k = int(part.argmin())  # the first to reach zero on the way stays there
            beta[on] += part[k] * (aim - beta[on])
            beta[on[k]] = 0.0
            on = np.delete(on, k)
        left = target - gram @ beta
    return beta


def penalty_path(long: DataFrame, fold, folds: int = 10, mix: float = 1.0, n_penalties: int = 100, least: float = 1e-4, steps: int = 60) -> Path:
    """The path of ``n_penalties`` penalties from the one that leaves no feature down to ``least`` of it, cut short where the model explains 99.9 % of the deviance. ``mix`` 1 is the lasso, between 0 and 1 the elastic net."""
    samples = _Samples(long, fold, folds)
    try:
        return _path(samples, mix, n_penalties, least, steps)
    finally:
        samples.close()


def _path(samples: _Samples, mix: float, n_penalties: int, least: float, steps: int) -> Path:
    folds, p = samples.folds, len(samples.names)
    m = samples.moments()
    sums = np.vstack([m.sum(0) - m[:folds], m.sum(0)])  # each fold's training part, then all samples
    n, cases = sums[:, 0], sums[:, 1]
    if (cases < 1).any() or (n - cases < 1).any():
        raise ValueError("a fold's training part lacks a class")
    x, xx, xy = (sums[:, 2 + i * p : 2 + (i + 1) * p] for i in range(3))
    spread = np.sqrt(np.maximum(xx / n[:, None] - (x / n[:, None]) ** 2, 0.0))
    pull = np.abs(xy[-1] / n[-1] - x[-1] / n[-1] * cases[-1] / n[-1])
    varies = spread[-1] > 1e-12
    top = (pull[varies] / spread[-1][varies]).max() / max(mix, 1e-3) * (1 + 1e-9) if varies.any() else 1.0
    penalties = top * np.logspace(0, np.log10(least), n_penalties)
    share = cases / n
    empty = 2 * n[-1] * -(share[-1] * np.log(share[-1]) + (1 - share[-1]) * np.log(1 - share[-1]))
    start = np.zeros((folds + 1, p + 1))
    start[:, 0] = np.log(share / (1 - share))
    block = min(TOGETHER, max(1, BYTES // ((folds + 1) * 4 * (p + 2) ** 2)))
    found: list[np.ndarray] = []  # by penalty (folds and all, features)
    for begin in range(0, n_penalties, block):
        lambdas = penalties[begin : begin + block]
        fits, explained = _fit(samples, np.tile(start, (len(lambdas), 1)), np.tile(np.arange(folds + 1), len(lambdas)), np.repeat(lambdas, folds + 1), mix, spread, steps)
        fits = fits.reshape(len(lambdas), folds + 1, p + 1)
        done = np.flatnonzero(explained.reshape(len(lambdas), -1)[:, -1] < 0.001 * empty)
        found += list(fits[: done[0] + 1] if len(done) else fits)
        start = fits[-1]
        if len(done):
            break
    fits = np.array(found)
    penalties = penalties[: len(fits)]
    told, dev = samples.held_out(fits[:, :folds].reshape(-1, p + 1), np.tile(np.arange(folds), len(fits)))
    told, dev = told.reshape(len(fits), folds), dev.reshape(len(fits), folds)
    used = told[0] > 0
    w, each = told[:, used], dev[:, used] / told[:, used]
    mean = (w * each).sum(1) / w.sum(1)
    error = np.sqrt((w * (each - mean[:, None]) ** 2).sum(1) / w.sum(1) / max(used.sum() - 1, 1))
    whole = fits[:, -1]
    slopes = whole[:, 1:] / samples.scale
    return Path(samples.names, mix, penalties, np.hstack([whole[:, :1] - slopes @ samples.mean[:, None], slopes]), mean, error)


def _fit(samples: _Samples, betas: np.ndarray, out: np.ndarray, lambdas: np.ndarray, mix: float, spread: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and training deviance of each model, all taking a step a pass until none moves."""
    held = np.where(out == samples.folds, -2, out)  # the model of all samples holds nothing out
    s = np.hstack([np.zeros((len(out), 1)), spread[out]])
    lasso, ridge = lambdas[:, None] * mix * s, lambdas[:, None] * (1 - mix) * s * s
    betas = np.where(np.hstack([np.ones((len(out), 1)), spread[out]]) > 1e-12, betas, 0.0)
    before, best, dev = betas.copy(), np.full(len(out), np.inf), np.zeros(len(out))
    open_ = np.arange(len(out))
    for _ in range(steps):
        now, a, r, old, bar = betas[open_], lasso[open_], ridge[open_], before[open_], best[open_]

        def solve(i, n, deviance, target, gram, now=now, a=a, r=r, old=old, bar=bar):
            value = deviance / (2 * n) + (a[i] * np.abs(now[i])).sum() + (r[i] * now[i] ** 2).sum() / 2
            if value > bar[i] + 1e-12:
                return np.concatenate([[bar[i]], (now[i] + old[i]) / 2, old[i]])
            return np.concatenate([[value], descend(gram / n, target / n, now[i], a[i], r[i]), now[i]])

        got = samples.pass_over(now, held[open_], solve)
        q, still = betas.shape[1], []
        for i, m in enumerate(open_):
            _, dev[m], best[m] = got[i][:3]
            new, before[m] = got[i][3 : 3 + q], got[i][3 + q :]
            if (np.abs(new - betas[m]) * np.maximum(s[m], 1e-12)).max() > 1e-7 or abs(new[0] - betas[m][0]) > 1e-7:
                still.append(m)
            betas[m] = new
        open_ = np.array(still, int)
        if not len(open_):
            break
    return betas, dev


def chosen(spark, path: Path, at: int) -> DataFrame:
    """(rank, feature, coefficient) of the features with a coefficient other than zero, largest first."""
    rows = sorted(zip(path.names, path.coefficients[at, 1:].tolist(), strict=True), key=lambda x: (-abs(x[1]), x[0]))
    return spark.createDataFrame([(i + 1, f, c) for i, (f, c) in enumerate(rows) if c], "rank int, feature string, coefficient double")


def as_table(spark, path: Path) -> DataFrame:
    """(step, penalty, deviance, error, n_features, least, sparse) along the path."""
    rows = [(i, float(path.penalties[i]), float(path.deviance[i]), float(path.error[i]), int((path.coefficients[i, 1:] != 0).sum()), i == path.least, i == path.sparse) for i in range(len(path.penalties))]
    return spark.createDataFrame(rows, "step int, penalty double, deviance double, error double, n_features int, least boolean, sparse boolean")


def cv_lasso(long: DataFrame, fold, folds: int = 10, **more) -> DataFrame:
    """The lasso's features at the penalty of least held-out deviance."""
    path = penalty_path(long, fold, folds, **more)
    return chosen(long.sparkSession, path, path.least)


def elastic_net(long: DataFrame, fold, folds: int = 10, mixes: tuple[float, ...] = tuple(round(0.1 + 0.05 * i, 2) for i in range(17)), **more) -> DataFrame:
    """The elastic net's features at the sparse penalty of the mix whose held-out deviance there is least; with that mix."""
    paths = [penalty_path(long, fold, folds, mix, **more) for mix in mixes]
    best = min(paths, key=lambda x: (round(x.deviance[x.sparse], 12), x.mix))
    return chosen(long.sparkSession, best, best.sparse).withColumn("mix", F.lit(best.mix))
