"""Linear discriminants of small feature sets, judged by their leave-one-out accuracy: a beam search over sets, and a stepwise search.

No discriminant is fitted again for a left-out sample. Tasks add up class counts, means and scatter rows of the features that candidate sets have in common; a second pass takes each sample out of its class's mean and of the pooled scatter by a rank-one down-date, for all candidates at once, and counts who is still put into their own class. Both passes go over all samples; the driver holds a row a candidate and the scatter of features that the search has picked by all features.

Defined cases: samples with a missing value or feature are left out; a set whose scatter cannot be inverted is no candidate; a sample that cannot be taken out (it alone spans a direction) counts as wrong; equal discriminants go to Case. Fewer than two samples of a class are an error. Ties between sets go to the names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.operators import models
from helixmill.sources import stores

#: Numbers of a task's working arrays.
CELLS = 4_000_000


class Samples:
    """Centred samples as a written table, and leave-one-out accuracies of feature sets (tuples of places in ``names``)."""

    def __init__(self, long: DataFrame):
        self.spark = long.sparkSession
        data, self.names = models.vectors(long)
        seen = data.agg(Summarizer.metrics("mean", "std").summary(F.col("x")).alias("s"), F.count("*").alias("n"), F.sum("label").alias("y")).first()
        self.n = np.array([(seen.n or 0) - (seen.y or 0), seen.y or 0])
        if self.n.min() < 2:
            raise ValueError("two samples of each class are needed")
        self.mean, std = seen.s.mean.toArray(), seen.s.std.toArray()
        self.scale = np.where(std > 0, std, 1.0)
        self.path = stores.new_folder(self.spark, "discriminant")
        self.rows = stores.written(data.select(F.col("label").cast("int").alias("label"), vector_to_array("x").alias("x")), self.path)
        self.sums, self.squares = self._total(lambda x, y: np.stack([np.stack([x[y == g].sum(0), (x[y == g] ** 2).sum(0)]) for g in (0, 1)])).transpose(1, 0, 2)
        self.centre = self.sums / self.n[:, None]
        self.own = (self.squares - self.sums**2 / self.n[:, None]).sum(0)  # pooled scatter of each feature with itself
        self.scatter: dict[int, np.ndarray] = {}

    def close(self) -> None:
        stores.remove(self.spark, self.path)

    def _total(self, of) -> np.ndarray:
        """The sum over tasks of the arrays that ``of(x, labels)`` gives for blocks of samples."""
        mean, scale = self.mean, self.scale

        def add(batches):
            total = None
            for batch in batches:
                x = (batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(mean)) - mean) / scale
                if batch.num_rows:
                    new = of(x, batch.column(0).to_numpy())
                    total = new if total is None else total + new
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total, "f8").tobytes()], pa.binary()), pa.array([list(total.shape)], pa.list_(pa.int32()))], ["sums", "shape"])

        return sum(np.frombuffer(r.sums).reshape(r["shape"]) for r in self.rows.mapInArrow(add, "sums binary, shape array<int>").toLocalIterator())  # one task's at a time

    def accuracies(self, sets: list[tuple[int, ...]], shared: set[int]) -> list[float | None]:
        """Leave-one-out accuracy of each set; every set has at most one feature outside ``shared``."""
        if missing := sorted(shared - set(self.scatter)):
            rows = self._total(lambda x, y: np.stack([x[y == g][:, missing].T @ x[y == g] for g in (0, 1)]))
            pooled = (rows - self.sums[:, missing, None] * self.sums[:, None, :] / self.n[:, None, None]).sum(0)
            self.scatter |= {f: pooled[i] for i, f in enumerate(missing)}
        found: dict[tuple[int, ...], float] = {}
        for size in sorted({len(s) for s in sets}):
            found |= self._of_size([s for s in sets if len(s) == size])
        return [found.get(s) for s in sets]

    def _between(self, i: int, j: int) -> float:
        return self.own[i] if i == j else self.scatter[i][j] if i in self.scatter else self.scatter[j][i]

    def _of_size(self, sets: list[tuple[int, ...]]) -> dict:
        within = np.array([[[self._between(i, j) for j in s] for i in s] for s in sets])
        usable = np.linalg.cond(within) < 1e12
        sets, inverse = [s for s, u in zip(sets, usable, strict=True) if u], np.linalg.inv(within[usable])
        if not sets:
            return {}
        at, centre, n = np.array(sets), self.centre, self.n

        def right(x, y):
            total = np.zeros(len(at))
            step = max(1, CELLS // at.size)
            for begin in range(0, len(x), step):
                block, labels = x[begin : begin + step], y[begin : begin + step]
                for g in (0, 1):
                    z = block[labels == g][:, at]  # samples, sets, features
                    u, v = z - centre[g][at], z - centre[1 - g][at]
                    au = np.einsum("nsf,sfe->nse", u, inverse)
                    q, r, t = (au * u).sum(2), (np.einsum("nsf,sfe->nse", v, inverse) * v).sum(2), (au * v).sum(2)
                    c, rest, free = n[g] / (n[g] - 1), n.sum() - 1, n.sum() - 3
                    gap = 1 - c * q
                    with np.errstate(divide="ignore", invalid="ignore"):
                        own = np.log((n[g] - 1) / rest) - free / 2 * c * c * q / gap
                        other = np.log(n[1 - g] / rest) - free / 2 * (r + c * t * t / gap)
                    total += ((gap > 1e-12) & ((own >= other) if g else (own > other))).sum(0)
            return total

        return dict(zip(sets, (self._total(right) / n.sum()).tolist(), strict=True))


def fisher_beam(long: DataFrame, turns: int = 3, width: int = 20) -> DataFrame:
    """(turn, rank, features, accuracy): the ``width`` best sets of each turn, which are the best of the turn before with one further feature."""
    samples = Samples(long)
    try:
        beam: list[tuple[int, ...]] = [()]
        rows = []
        for turn in range(1, turns + 1):
            sets = sorted({tuple(sorted((*s, j))) for s in beam for j in range(len(samples.names)) if j not in s})
            told = [(a, s) for s, a in zip(sets, samples.accuracies(sets, {i for s in beam for i in s}), strict=True) if a is not None]
            best = sorted(told, key=lambda x: (-round(x[0], 12), x[1]))[:width]
            rows += [(turn, i + 1, [samples.names[j] for j in s], a) for i, (a, s) in enumerate(best)]
            beam = [s for _, s in best]
            if not beam:
                break
    finally:
        samples.close()
    return long.sparkSession.createDataFrame(rows, "turn int, rank int, features array<string>, accuracy double")


def step_lda(long: DataFrame, improvement: float = 0.05, most: int | None = None) -> DataFrame:
    """(step, action, feature, accuracy): the feature whose entry or removal raises the accuracy most, as long as it rises by ``improvement`` at least; from the accuracy of the larger class."""
    samples = Samples(long)
    rows, now, best = [], (), float(samples.n.max() / samples.n.sum())
    try:
        while True:
            grown = [tuple(sorted((*now, j))) for j in range(len(samples.names)) if j not in now] if most is None or len(now) < most else []
            shrunk = [tuple(i for i in now if i != j) for j in now] if len(now) > 1 else []
            sets = grown + shrunk
            told = [(-round(a, 12), s) for s, a in zip(sets, samples.accuracies(sets, set(now)), strict=True) if a is not None]
            if not told or -min(told)[0] < best + improvement - 1e-12:
                break
            new = min(told)[1]
            (changed,) = set(new) ^ set(now)
            now, best = new, -min(told)[0]
            rows.append((len(rows) + 1, "in" if changed in now else "out", samples.names[changed], best))
    finally:
        samples.close()
    return long.sparkSession.createDataFrame(rows, "step int, action string, feature string, accuracy double")
