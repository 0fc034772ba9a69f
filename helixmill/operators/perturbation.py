"""Feature weights by simultaneous perturbation, judged by k nearest neighbours.

All weights are moved up or down by a random sign each, the accuracy is measured at both ends, and the difference is a slope for every weight at once. The measure is noisy by design: each step asks a fresh, hashed draw of about ``queries`` samples (all samples, if there are no more), each of which is classed by its ``k`` nearest among all other samples; the feature sets of a step are all measured by one pass. Tasks hold a block of samples against the queries and keep the nearest of each; a shuffle of these few brings a query's nearest together. No sample meets more than the queries, so a step's work grows with the samples, not with their square, and the driver holds the weights and two numbers a set.

Defined cases: samples with a missing value or feature are left out; equal distances go to the smaller hash of the sample; as many neighbours of either class is Case; a weight below one half leaves its feature out, and where all are the largest stays in; fewer than two samples or a class that is missing are an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.operators import models
from helixmill.operators.transforms import uniform
from helixmill.sources import stores

#: Numbers of a task's working arrays, and queries whose neighbours one task puts together.
CELLS, CHUNK = 4_000_000, 256
NEAR = "chosen int, chunk int, near binary"


def nearest(d: np.ndarray, h: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``d`` its ``k`` smallest (distance, hash) with their labels, by distance then hash. ``h`` and ``y`` have the shape of ``d``."""
    order = np.lexsort((h, d), axis=1)[:, :k]
    return tuple(np.take_along_axis(v, order, 1) for v in (d, h, y))


class Neighbours:
    """Scaled samples as a written table, and leave-one-out accuracies of feature sets by neighbours."""

    def __init__(self, long: DataFrame, k: int):
        self.spark, self.k = long.sparkSession, k
        data, self.names = models.vectors(long)
        seen = data.groupBy(F.lit("all")).agg(Summarizer.metrics("mean", "std").summary(F.col("x")).alias("s"), F.count("*").alias("n"), F.sum("label").alias("y")).first()
        if seen is None or seen.n < 2 or not 0 < seen.y < seen.n:
            raise ValueError("samples of both classes are needed")
        std = seen.s.std.toArray()
        self.n, self.mean, self.scale = seen.n, seen.s.mean.toArray(), np.where(std > 0, std, 1.0)
        self.path = stores.new_folder(self.spark, "perturbation")
        self.rows = stores.written(data.select("sample_id", F.xxhash64(F.col("sample_id").cast("string")).alias("h"), F.col("label").cast("int").alias("y"), vector_to_array("x").alias("x")), self.path)

    def close(self) -> None:
        stores.remove(self.spark, self.path)

    def drawn(self, queries: int, seed: int, step: int):
        """(h, y, x) of about ``queries`` samples, in the order of h; at least one."""
        share = min(1.0, queries / self.n)
        u = uniform(seed, "query", step, F.col("sample_id"))
        found = self.rows.where(u < share).select("h", "y", "x").collect() or [self.rows.orderBy(u, "h").select("h", "y", "x").first()]  # about ``queries`` samples
        found = sorted(found, key=lambda r: r.h)
        return np.array([r.h for r in found]), np.array([r.y for r in found]), (np.array([r.x for r in found]) - self.mean) / self.scale

    def accuracies(self, sets: list[tuple[int, ...]], queries: tuple) -> list[float]:
        """The share of the queries whose ``k`` nearest other samples are mostly of their class, by each set's features."""
        asked, labels, points = queries
        mean, scale, k, q = self.mean, self.scale, self.k, len(asked)
        masks = np.zeros((len(sets), len(mean)))
        for i, s in enumerate(sets):
            masks[i, list(s)] = 1
        own = (points * points) @ masks.T  # queries by sets

        def search(batches):
            held: list = [None] * len(sets)
            for batch in batches:
                step = max(1, CELLS // max(q, len(mean)))
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    h, y = part.column(0).to_numpy(), part.column(1).to_numpy()
                    x = (part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(h), len(mean)) - mean) / scale
                    for i, mask in enumerate(masks):
                        d = np.round(np.maximum(own[:, i, None] + ((x * x) @ mask)[None, :] - 2 * (points * mask) @ x.T, 0), 9)
                        d[asked[:, None] == h[None, :]] = np.inf
                        new = nearest(d, np.broadcast_to(h, d.shape), np.broadcast_to(y, d.shape), k)
                        held[i] = new if held[i] is None else nearest(*(np.concatenate(v, 1) for v in zip(held[i], new, strict=True)), k)
            rows = [(i, c, b"".join(np.ascontiguousarray(v[c * CHUNK : (c + 1) * CHUNK], t).tobytes() for v, t in zip(x, ("f8", "i8", "i8"), strict=True))) for i, x in enumerate(held) if x is not None for c in range(-(-q // CHUNK))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["chosen", "chunk", "near"])

        def merge(key, block: pd.DataFrame) -> pd.DataFrame:
            truth, held = labels[key[1] * CHUNK : (key[1] + 1) * CHUNK], None
            for raw in block["near"]:
                width = len(raw) // (24 * len(truth))
                cut = len(truth) * width * 8
                new = tuple(np.frombuffer(raw[j * cut : (j + 1) * cut], t).reshape(len(truth), width) for j, t in enumerate(("f8", "i8", "i8")))
                held = new if held is None else nearest(*(np.concatenate(v, 1) for v in zip(held, new, strict=True)), k)
            there = np.isfinite(held[0])
            told = 2 * (held[2] * there).sum(1) >= there.sum(1)
            return pd.DataFrame({"chosen": [key[0]], "right": [int((told == (truth == 1)).sum())]}).astype({"chosen": "int32"})

        near = self.rows.select("h", "y", "x").mapInArrow(search, NEAR).groupBy("chosen", "chunk").applyInPandas(merge, "chosen int, right bigint")
        right = {r.chosen: r.right for r in near.groupBy("chosen").agg(F.sum("right").alias("right")).collect()}  # a row a set
        return [right[i] / q for i in range(len(sets))]


def chosen(weights: np.ndarray) -> tuple[int, ...]:
    """The features whose weight is at least one half; the largest if there is none."""
    return tuple(np.flatnonzero(weights >= 0.5).tolist()) or (int(weights.argmax()),)


def gain(moved: np.ndarray, turned: np.ndarray, last: float, low: float = 0.1, high: float = 2.0) -> float:
    """The step length that the last move of the weights and the change of the slope suggest, between ``low`` and ``high``; the last one where they suggest none."""
    across = float(turned @ turned)
    found = abs(float(moved @ turned)) / across if across > 0 else 0.0
    return last if found == 0 else min(max(found, low), high)


def weights(long: DataFrame, k: int = 5, iterations: int = 10, slopes: int = 3, spread: float = 0.05, queries: int = 2_000, seed: int = 1) -> tuple[list[str], np.ndarray, list[tuple]]:
    """Features, the weights of the best step, and the steps as (step, n_features, accuracy). A step averages ``slopes`` slopes, each with an end ``spread`` above and one below."""
    samples, rng = Neighbours(long, k), np.random.default_rng(seed)
    p = len(samples.names)
    now, before, length, steps, best = np.full(p, 0.5), None, 1.0, [], (-1.0, None)
    try:
        for step in range(iterations + 1):  # the last pass judges the last step
            signs = rng.choice([-1.0, 1.0], (slopes, p))
            ends = [chosen(np.clip(now + side * spread * s, 0, 1)) for s in signs for side in (1, -1)]
            told = samples.accuracies([chosen(now), *ends], samples.drawn(queries, seed, step))
            steps.append((step, len(chosen(now)), told[0]))
            if told[0] > best[0] + 1e-12:
                best = (told[0], now)
            up, down = np.array(told[1::2]), np.array(told[2::2])
            slope = ((up - down)[:, None] / (2 * spread) * signs).mean(0)
            if before is not None:
                length = gain(now - before[0], slope - before[1], length)
            before = (now, slope)
            now = np.clip(now + length * slope, 0, 1)
    finally:
        samples.close()
    return samples.names, best[1], steps


def ranked(long: DataFrame, most: int = 11, **more) -> DataFrame:
    """(rank, feature, weight): the ``most`` features of largest weight at the best step, of those that it keeps."""
    names, found, _ = weights(long, **more)
    kept = set(chosen(found))
    rows = sorted(((names[i], float(found[i])) for i in kept), key=lambda r: (-round(r[1], 12), r[0]))[:most]
    return long.sparkSession.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "rank int, feature string, weight double")
