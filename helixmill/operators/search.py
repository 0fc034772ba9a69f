"""Genetic and annealing search for feature sets, judged by the cross-validated accuracy of linear discriminants.

One pass adds up each fold's counts, sums and products of features by features, from which the driver solves the discriminant of any set without any folds. A generation is one further pass: every sample meets the discriminants that have not seen its fold, of all candidates of all runs, and tasks count who is put into their own class. There is a run a fold, which never sees that fold, and one on all folds; the runs without a fold tell, on the fold left out, at which generation to stop, and the run on all folds gives the set of that generation. The driver holds features by features a fold and a generation's sets, never a sample; candidates come from generators seeded by run, so results do not depend on partitions.

Defined cases: samples with a missing value or feature, or whose fold is null, are left out; equal discriminants go to Case; sets of equal accuracy are ordered by size, then by names; fewer than three folds, or folds without which a class has fewer than two samples, are an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators import models
from helixmill.sources import stores

#: Numbers of a task's working arrays, and what is added to a scaled scatter's diagonal.
CELLS, RIDGE = 4_000_000, 1e-6


class Folds:
    """Samples as a written table with their fold, and accuracies of feature sets (tuples of places in ``names``). ``fold`` is a Column of sample_id, 0 to ``folds`` - 1."""

    def __init__(self, long: DataFrame, fold, folds: int):
        if folds < 3:
            raise ValueError("three folds or more are needed")
        self.spark, self.folds = long.sparkSession, folds
        data, self.names = models.vectors(long)
        data = data.withColumn("f", fold.cast("int")).where(F.col("f").between(0, folds - 1))
        seen = data.groupBy(F.lit("all")).agg(Summarizer.metrics("mean", "std").summary(F.col("x")).alias("s")).first()
        if seen is None:
            raise ValueError("no sample has all features and a fold")
        std = seen.s.std.toArray()
        self.mean, self.scale = seen.s.mean.toArray(), np.where(std > 0, std, 1.0)
        self.path = stores.new_folder(self.spark, "search")
        self.rows = stores.written(data.select("f", F.col("label").cast("int").alias("y"), vector_to_array("x").alias("x")), self.path)
        p = len(self.names)

        def moments(f, y, x):
            parts = []
            for k in range(folds):
                here = f == k
                own = x[here]
                parts += [[(y[here] == g).sum() for g in (0, 1)], *[own[y[here] == g].sum(0) for g in (0, 1)], (own.T @ own).ravel()]
            return np.concatenate(parts).astype(float)

        told = self._total(moments).reshape(folds, 2 + 2 * p + p * p)
        self.n, self.sums, self.products = told[:, :2], told[:, 2 : 2 + 2 * p].reshape(folds, 2, p), told[:, 2 + 2 * p :].reshape(folds, p, p)
        without = lambda *out: self.n.sum(0) - sum(self.n[k] for k in set(out))
        if min(without(i, j).min() for i in range(folds) for j in range(folds)) < 2:
            raise ValueError("two samples of each class are needed without any two folds")

    def close(self) -> None:
        stores.remove(self.spark, self.path)

    def _total(self, of) -> np.ndarray:
        mean, scale = self.mean, self.scale

        def add(batches):
            held = None
            for batch in batches:
                for at in range(0, batch.num_rows, max(1, CELLS // len(mean))):
                    part = batch.slice(at, max(1, CELLS // len(mean)))
                    x = (part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(mean)) - mean) / scale
                    new = of(part.column(0).to_numpy(), part.column(1).to_numpy(), x)
                    held = new if held is None else held + new
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(held, "f8").tobytes()], pa.binary())], ["sums"])

        return sum(np.frombuffer(r.sums) for r in self.rows.mapInArrow(add, "sums binary").toLocalIterator())  # one task's at a time

    def discriminant(self, chosen: tuple[int, ...], out: set[int]) -> np.ndarray:
        """Weights of all features and the constant, fitted without the folds ``out``; above 0 means Case."""
        kept, at = [k for k in range(self.folds) if k not in out], list(chosen)
        n, sums = self.n[kept].sum(0), self.sums[kept].sum(0)[:, at]
        means = sums / n[:, None]
        within = self.products[np.ix_(kept, at, at)].sum(0) - sum(np.outer(sums[g], means[g]) for g in (0, 1))
        beta = np.linalg.solve(within / max(n.sum() - 2, 1) + RIDGE * np.eye(len(at)), means[1] - means[0])
        w = np.zeros(len(self.names) + 1)
        w[at], w[-1] = beta, np.log(n[1] / n[0]) - beta @ (means[0] + means[1]) / 2
        return w

    def judge(self, asked: list[list[tuple[int, ...]]]) -> list[dict[tuple[int, ...], tuple[float, float | None]]]:
        """For each run (the last on all folds) each set's accuracy on the run's folds, each judged without itself, and on the fold that the run leaves out (None for the last)."""
        sets = [sorted(set(x)) for x in asked]
        cells = [(r, s) for r, x in enumerate(sets) for s in x]
        weights = np.stack([np.stack([self.discriminant(s, {r, f} - {self.folds}) for r, s in cells], 1) for f in range(self.folds)])

        def right(f, y, x):
            out = np.zeros((len(weights), len(cells)))
            for k in np.unique(f):
                own, labels = x[f == k], y[f == k]
                for at in range(0, len(own), max(1, CELLS // len(cells))):
                    told = own[at : at + max(1, CELLS // len(cells))] @ weights[k, :-1] + weights[k, -1] >= 0
                    out[k] += (told == (labels[at : at + len(told)] == 1)[:, None]).sum(0)
            return out.ravel()

        hits, n = self._total(right).reshape(self.folds, len(cells)), self.n.sum(1)
        found: list[dict] = [{} for _ in asked]
        for c, (r, s) in enumerate(cells):
            inner = [k for k in range(self.folds) if k != r]
            found[r][s] = (float(hits[inner, c].sum() / n[inner].sum()), float(hits[r, c] / n[r]) if r < self.folds and n[r] else None)
        return found


@dataclass
class Found:
    """What a search found: its steps as (step, run, features, internal, external), the step chosen, and its set."""

    names: list[str]
    steps: list[tuple] = field(default_factory=list)
    at: int = 0
    chosen: tuple[int, ...] = ()

    def settle(self, folds: int) -> Found:
        """Take the step of the largest mean accuracy on the folds left out (ties: the first), and the set of the last run there."""
        means: dict[int, list[float]] = {}
        for step, run, _, _, external in self.steps:
            if run < folds and external is not None:
                means.setdefault(step, []).append(external)
        self.at = min(means, key=lambda g: (-round(sum(means[g]) / len(means[g]), 12), g))
        self.chosen = next(s for step, run, s, *_ in self.steps if (step, run) == (self.at, folds))
        return self

    def features(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i + 1, self.names[j]) for i, j in enumerate(self.chosen)], "rank int, feature string")

    def history(self, spark: SparkSession) -> DataFrame:
        rows = [(step, run, len(s), [self.names[j] for j in s], a, b, step == self.at) for step, run, s, a, b in self.steps]
        return spark.createDataFrame(rows, "step int, run int, n_features int, features array<string>, internal double, external double, chosen boolean")


def _best(told: dict, sets) -> tuple[int, ...]:
    return min(sets, key=lambda s: (-round(told[s][0], 12), len(s), s))


def _set(bits: np.ndarray, rng: np.random.Generator) -> tuple[int, ...]:
    """The places of set bits; one at random if there are none."""
    return tuple(np.flatnonzero(bits).tolist()) or (int(rng.integers(len(bits))),)


def _bits(s: tuple[int, ...], p: int) -> np.ndarray:
    out = np.zeros(p, bool)
    out[list(s)] = True
    return out


def bred(population: list[tuple[int, ...]], told: dict, p: int, rng: np.random.Generator, crossover: float, mutation: float) -> list[tuple[int, ...]]:
    """The next generation: the best set as it is; else pairs drawn by rank, each with a chance of ``crossover`` to swap what lies behind a random place, and each child with a chance of ``mutation`` to have one feature turned over."""
    order = sorted(population, key=lambda s: (-round(told[s][0], 12), len(s), s))
    share = np.arange(len(order), 0, -1, dtype=float)
    out = [order[0]]
    while len(out) < len(population):
        a, b = (_bits(order[i], p) for i in rng.choice(len(order), 2, p=share / share.sum()))
        if p > 1 and rng.random() < crossover:
            cut = int(rng.integers(1, p))
            a, b = np.concatenate([a[:cut], b[cut:]]), np.concatenate([b[:cut], a[cut:]])
        for child in (a, b):
            if rng.random() < mutation:
                i = int(rng.integers(p))
                child[i] = not child[i]
            if len(out) < len(population):
                out.append(_set(child, rng))
    return out


def genetic(long: DataFrame, fold, folds: int, generations: int = 10, population: int = 50, crossover: float = 0.8, mutation: float = 0.1, seed: int = 1) -> Found:
    """A population a run, from sets of a tenth to nine tenths of the features, over ``generations``; a step is a generation's best set of each run."""
    samples = Folds(long, fold, folds)
    p, rngs = len(samples.names), [np.random.default_rng([seed, r]) for r in range(folds + 1)]
    out = Found(samples.names)
    try:
        runs = [[_set(g.random(p) < share, g) for share in np.linspace(0.1, 0.9, population)] for g in rngs]
        for step in range(1, generations + 1):
            told = samples.judge(runs)
            for r, sets in enumerate(runs):
                best = _best(told[r], sets)
                out.steps.append((step, r, best, *told[r][best]))
                runs[r] = bred(sets, told[r], p, rngs[r], crossover, mutation)
    finally:
        samples.close()
    return out.settle(folds)


def accepts(new: float, old: float, step: int, u: float) -> bool:
    """A better set always; a worse one the less likely, the worse it is and the later it comes."""
    return new >= old or u < np.exp((new - old) / max(old, 1e-9) * step)


def annealing(long: DataFrame, fold, folds: int, iterations: int = 10, chains: int = 10, improve: int = 50, seed: int = 1) -> Found:
    """``chains`` a run, from a fifth of the features, each of which turns a hundredth of the features (one at least) over an iteration; a chain without improvement for ``improve`` iterations goes back to its best set. A step is the best of a run's chains as they stand."""
    samples = Folds(long, fold, folds)
    p, rngs = len(samples.names), [np.random.default_rng([seed, r]) for r in range(folds + 1)]
    out = Found(samples.names)
    try:
        now = [[_set(g.random(p) < 0.2, g) for _ in range(chains)] for g in rngs]
        first = samples.judge(now)
        value = [{c: first[r][s] for c, s in enumerate(x)} for r, x in enumerate(now)]
        best = [[(value[r][c][0], s) for c, s in enumerate(x)] for r, x in enumerate(now)]
        since = [[0] * chains for _ in now]
        for step in range(1, iterations + 1):
            tried = []
            for r, x in enumerate(now):
                tried.append([])
                for s in x:
                    bits = _bits(s, p)
                    turned = rngs[r].choice(p, max(1, p // 100), replace=False)
                    bits[turned] = ~bits[turned]
                    tried[r].append(_set(bits, rngs[r]))
            told = samples.judge(tried)
            back = samples.judge([[best[r][c][1] for c in range(chains)] for r in range(folds + 1)]) if any(n + 1 >= improve for x in since for n in x) else None
            for r in range(folds + 1):
                for c, s in enumerate(tried[r]):
                    if accepts(told[r][s][0], value[r][c][0], step, rngs[r].random()):
                        now[r][c], value[r][c] = s, told[r][s]
                    if value[r][c][0] > best[r][c][0] + 1e-12:
                        best[r][c], since[r][c] = (value[r][c][0], now[r][c]), 0
                    else:
                        since[r][c] += 1
                        if since[r][c] >= improve:
                            now[r][c], since[r][c] = best[r][c][1], 0
                            value[r][c] = back[r][now[r][c]]
                at = min(range(chains), key=lambda c: (-round(value[r][c][0], 12), len(now[r][c]), now[r][c]))
                out.steps.append((step, r, now[r][at], *value[r][at]))
    finally:
        samples.close()
    return out.settle(folds)
