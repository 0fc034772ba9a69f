"""Search of boosted trees' parameters by a Gaussian process.

What was tried is the search's memory: every trial is a cell of ``dispatch`` with its parameters and its cross-validated AUC. The first trials are drawn from a Latin square; after these a Gaussian process over all stored trials tells where the expected improvement is largest, and that is tried next. A search that is run again takes the stored trials and goes on; a trial that fails or is late counts as the worst so far. The driver holds a row a trial; fits and scores run over all samples in Spark.

Defined cases: samples with a missing value or feature are left out; a fold whose held-out part lacks a class has no AUC and is left out of the mean, and a trial without any AUC fails; if all trials fail there is an error. Ties go to the earlier trial.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators import dispatch, evaluation, tuner
from helixmill.sources import stores

#: Name, least, greatest, and how values in between lie: "log", "int" or evenly.
SPACE = (("stepSize", 0.02, 0.5, "log"), ("maxDepth", 1, 5, "int"), ("minInstancesPerNode", 1, 10, "int"), ("subsamplingRate", 0.5, 1.0, "even"), ("minInfoGain", 0.0, 0.05, "even"))
LENGTH, NOISE, CANDIDATES = 0.35, 1e-4, 2_000


def parameters(unit: np.ndarray) -> dict[str, float]:
    """Values of the parameters at a point of the unit cube."""
    out = {}
    for (name, low, high, kind), u in zip(SPACE, unit, strict=True):
        if kind == "log":
            out[name] = float(low * (high / low) ** u)
        elif kind == "int":
            out[name] = min(int(high), int(low + u * (high - low + 1)))
        else:
            out[name] = float(low + u * (high - low))
    return out


def latin(n: int, rng: np.random.Generator) -> np.ndarray:
    """``n`` points of the unit cube, each in a slice of its own along every side."""
    return np.column_stack([(rng.permutation(n) + rng.random(n)) / n for _ in SPACE])


def posterior(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation at ``at`` of a Gaussian process with a Matérn 5/2 kernel through the standardised ``y`` at ``x``."""
    centre, spread = y.mean(), y.std() or 1.0

    def kernel(a, b):
        r = np.sqrt(5 * ((a[:, None] - b[None]) ** 2).sum(2)) / LENGTH
        return (1 + r + r * r / 3) * np.exp(-r)

    lower = np.linalg.cholesky(kernel(x, x) + NOISE * np.eye(len(x)))
    cross = np.linalg.solve(lower, kernel(x, at))
    mean = cross.T @ np.linalg.solve(lower, (y - centre) / spread)
    return centre + spread * mean, spread * np.sqrt(np.maximum(1 - (cross * cross).sum(0), 0))


def improvement(mean: np.ndarray, deviation: np.ndarray, best: float) -> np.ndarray:
    """How much a trial is expected to exceed ``best``."""
    z = (mean - best) / np.maximum(deviation, 1e-12)
    density, below = np.exp(-z * z / 2) / math.sqrt(2 * math.pi), np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    return np.maximum((mean - best) * below + deviation * density, 0)


def search(spark: SparkSession, objective: Callable[[dict], DataFrame], path: str, first: int = 8, further: int = 10, seed: int = 1, limit: float = 172_800, at_once: int = 3) -> list[tuple[int, dict, float | None]]:
    """(trial, parameters, value) of ``first`` + ``further`` trials. ``objective`` gives a table of one row with a double ``value`` to be made large. First trials run ``at_once``, further ones one after another."""
    starts = latin(first, np.random.default_rng(seed))

    def tried(points: dict[int, np.ndarray]) -> dict[int, float | None]:
        def cell(u):
            settings = parameters(u)
            return lambda: objective(settings).select(F.col("value").cast("double").alias("value"), F.lit(json.dumps(settings)).alias("settings"), F.lit(json.dumps(u.tolist())).alias("unit"))

        attempted = {r.cell for r in dispatch.states(spark, path).select("cell").collect()}  # a row a trial
        dispatch.run_cells(spark, {name: cell(u) for i, u in points.items() if (name := f"trial{i:05d}") not in attempted}, path, limit, at_once)
        found = dispatch.results(spark, path)
        values = {} if found is None else {r.cell: r.value for r in found.select("cell", "value").collect()}
        return {i: values.get(f"trial{i:05d}") for i in points}

    points = dict(enumerate(starts))
    values = tried(points)
    for i in range(first, first + further):
        known = [v for v in values.values() if v is not None]
        if not known:
            raise ValueError("no trial has a value")
        y = np.array([min(known) if values[k] is None else values[k] for k in points])
        at = np.random.default_rng([seed, i]).random((CANDIDATES, len(SPACE)))
        mean, deviation = posterior(np.array([*points.values()]), y, at)
        points[i] = at[int(np.round(improvement(mean, deviation, max(known)), 12).argmax())]
        values |= tried({i: points[i]})
    return [(i, parameters(u), values[i]) for i, u in points.items()]


def boosted(settings: dict, rounds: int, seed: int) -> GBTClassifier:
    return GBTClassifier(featuresCol="x", maxIter=rounds, seed=seed, **settings)


def _scored(fitted, data: DataFrame, *more) -> DataFrame:
    return fitted.transform(data).select("sample_id", *more, F.col("label").cast("int").alias("label"), vector_to_array("probability")[1].alias("score"))


def boosted_trees(long: DataFrame, features: list[str], fold, folds: int, path: str, first: int = 8, further: int = 10, rounds: int = 20, seed: int = 1, limit: float = 172_800) -> DataFrame:
    """(trial, settings, value, chosen, and of the chosen one cutoff, model, figures by mix): boosted trees on ``features``, tuned by the mean AUC over ``folds`` of the train part (``fold``: a Column of sample_id). The best is fitted on all of train, cut at its largest Youden index there, and stored under ``path``. ``long`` has a mix column."""
    spark = long.sparkSession
    at = stores.new_folder(spark, "boosted")
    data = stores.written(tuner.part(long, features).withColumn("f", fold), at)
    try:
        train = data.where("mix = 'train'")

        def objective(settings):
            told = None
            for k in range(folds):
                fitted = boosted(settings, rounds, seed).fit(train.where(F.col("f") != k))
                rows = _scored(fitted, train.where(F.col("f") == k), "f")
                told = rows if told is None else told.unionByName(rows)
            value = evaluation.auc(told, ("f",), turned=False).agg(F.avg("auc").alias("value"))
            return value.withColumn("value", F.coalesce("value", F.raise_error(F.lit("no fold has both classes"))))

        trials = search(spark, objective, path, first, further, seed, limit)
        _, settings, _ = best = max((t for t in trials if t[2] is not None), key=lambda t: (round(t[2], 12), -t[0]))
        fitted = boosted(settings, rounds, seed).fit(train)
        fitted.write().overwrite().save(f"{path}/model")
        told = _scored(fitted, data, "mix")
        cutoff = evaluation.youden(told.where("mix = 'train'"), ("mix",)).first().cutoff
        judged = told.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))
        figures = {r.mix: r for r in evaluation.confusion(judged, ("mix",)).collect()}  # a row a part
    finally:
        stores.remove(spark, at)
    names = [f"{mix}_{c}" for mix in stores.MIXES for c in tuner.FIGURES]
    of = [figures[mix][c] if mix in figures else None for mix in stores.MIXES for c in tuner.FIGURES]
    rows = [(i, json.dumps(s, sort_keys=True), v, i == best[0], *((cutoff, f"{path}/model", *of) if i == best[0] else (None, None, *[None] * len(of)))) for i, s, v in trials]
    return spark.createDataFrame(rows, "trial int, settings string, value double, chosen boolean, cutoff double, model string, " + ", ".join(f"{n} double" for n in names))
