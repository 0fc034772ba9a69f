"""Benchmarks of feature sets by tuned models: a cell for each set and algorithm, run by ``dispatch``.

A cell draws its candidates' parameters from a seeded hash, fits each on the train part, takes the one of largest AUC on the test part (ties: the first drawn), stores that model, and judges it on train, test and valid. Samples stay in Spark; the driver sees a row a candidate.

Defined cases: samples with a missing value of a set's features are left out; a set without a known feature, or a part without both classes, makes its cells fail with that error, and no others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators import dispatch, evaluation, models

SCORED = {"svm": "rawPrediction"}
FIGURES = ("accuracy", "sensitivity", "specificity")


class Draws:
    """Numbers in [0, 1) by a seed and their names."""

    def __init__(self, *seed):
        self.seed = "|".join(map(str, seed))

    def __call__(self, name: str) -> float:
        return int.from_bytes(hashlib.md5(f"{self.seed}|{name}".encode()).digest()[:6]) / 2**48

    def whole(self, name: str, low: int, high: int) -> int:
        return low + int(self(name) * (high - low + 1))

    def log(self, name: str, low: float, high: float) -> float:
        return float(low * (high / low) ** self(name))


#: By name: parameters from draws, and whether there are any to tune.
SPACES: dict[str, tuple[bool, Callable]] = {
    "logistic": (False, lambda d: LogisticRegression(featuresCol="z", maxIter=50)),
    "penalised": (True, lambda d: LogisticRegression(featuresCol="z", maxIter=50, regParam=d.log("penalty", 1e-4, 1.0), elasticNetParam=d("mix"))),
    "tree": (True, lambda d: DecisionTreeClassifier(featuresCol="z", seed=1, maxDepth=d.whole("depth", 1, 8), minInstancesPerNode=d.whole("leaf", 1, 20))),
    "forest": (True, lambda d: RandomForestClassifier(featuresCol="z", seed=1, numTrees=d.whole("trees", 10, 40), maxDepth=d.whole("depth", 2, 8), featureSubsetStrategy=str(round(0.1 + 0.9 * d("share"), 3)))),
    "boosted": (True, lambda d: GBTClassifier(featuresCol="z", seed=1, maxIter=d.whole("rounds", 3, 15), maxDepth=d.whole("depth", 1, 4), stepSize=d.log("step", 0.03, 0.5))),
    "svm": (True, lambda d: LinearSVC(featuresCol="z", maxIter=50, regParam=d.log("penalty", 1e-4, 1.0))),
    "network": (True, lambda d: MultilayerPerceptronClassifier(featuresCol="z", seed=1, maxIter=40, layers=[-1, d.whole("hidden", 2, 8), 2])),
    "bayes": (False, lambda d: NaiveBayes(featuresCol="z", modelType="gaussian")),
}


def candidates(name: str, draws: int, seed: int) -> list:
    """Estimators of an algorithm: ``draws`` of them, or one where there is nothing to tune."""
    tunable, make = SPACES[name]
    return [make(Draws(seed, name, i)) for i in range(draws if tunable else 1)]


def settings(estimator) -> str:
    """The parameters that were set, but for columns and the seed, as text."""
    told = sorted((p.name, v) for p, v in estimator.extractParamMap().items() if estimator.isSet(p) and not p.name.endswith("Col") and p.name != "seed")
    return ", ".join(f"{k}={v:.6g}" if isinstance(v, float) else f"{k}={v}" for k, v in told)


def part(long: DataFrame, features: list[str]) -> DataFrame:
    """(sample_id, label, x, mix) of samples with all ``features``, in the order of their names."""
    kept = long.where(F.col("feature").isin(features))
    data, names = models.vectors(kept)
    if missing := sorted(set(features) - set(names)):
        raise ValueError(f"features that are missing: {missing}")
    return data.join(long.select("sample_id", "mix").distinct(), "sample_id")


def judged(told: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, auc (as scored, not turned) and its interval, accuracy, sensitivity and specificity."""
    confused = evaluation.confusion(told, by).select(*by, *FIGURES)
    return evaluation.auc(told, by, turned=False).join(confused, list(by))


def scored(fitted, name: str, data: DataFrame, *more) -> DataFrame:
    return fitted.transform(data).select("sample_id", *more, F.col("label").cast("int").alias("label"), vector_to_array(SCORED.get(name, "probability"))[1].alias("score"), F.col("prediction").cast("int").alias("predicted"))


def cell(long: DataFrame, method: str, features: list[str], name: str, models_at: str, draws: int = 5, seed: int = 1) -> DataFrame:
    """(method, algorithm, settings, tested, model, mix, auc, auc_low, auc_high, accuracy, sensitivity, specificity), a row a part."""
    data = part(long, features).persist()
    try:
        train = data.where("mix = 'train'")
        scaler = StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True).fit(train)
        scaled, test = scaler.transform(train), scaler.transform(data.where("mix = 'test'"))
        tried, told = [], None
        for i, estimator in enumerate(candidates(name, draws, seed)):
            if name == "network":
                estimator.setLayers([len(features), *estimator.getLayers()[1:]])
            tried.append((estimator, estimator.fit(scaled)))
            rows = scored(tried[-1][1], name, test, F.lit(i).alias("candidate"))
            told = rows if told is None else told.unionByName(rows)
        found = {r.candidate: r.auc for r in evaluation.auc(told, ("candidate",), turned=False).collect()}
        if None in found.values() or not found:
            raise ValueError("the test part lacks a class")
        best = min(found, key=lambda i: (-round(found[i], 12), i))
        model = PipelineModel([scaler, tried[best][1]])
        at = f"{models_at}/{hashlib.md5(f'{method}|{name}'.encode()).hexdigest()}"
        model.write().overwrite().save(at)
        rows = judged(scored(model, name, data, "mix"), ("mix",)).collect()  # a row a part
    finally:
        data.unpersist()
    spark = long.sparkSession
    kept = [(method, name, settings(tried[best][0]), float(found[best]), at, *(r[c] for c in ("mix", "auc", "auc_low", "auc_high", *FIGURES))) for r in rows]
    return spark.createDataFrame(kept, "method string, algorithm string, settings string, tested double, model string, mix string, auc double, auc_low double, auc_high double, accuracy double, sensitivity double, specificity double")


def benchmark(long: DataFrame, formulas: dict[str, list[str]], path: str, algorithms: tuple[str, ...] = tuple(SPACES), draws: int = 5, seed: int = 1, limit: float = 172_800, at_once: int = 3) -> DataFrame:
    """Run every set by every algorithm under ``path``, as far as it is not done, and give the states of the cells. ``long`` has a mix column (train, test, valid)."""
    cells = {f"{m}|{a}": (lambda m=m, f=f, a=a: cell(long, m, f, a, f"{path}/models", draws, seed)) for m, f in formulas.items() for a in algorithms}
    return dispatch.run_cells(long.sparkSession, cells, path, limit, at_once)


def board(spark: SparkSession, path: str) -> DataFrame | None:
    """A row a set and algorithm that is done: settings, model, AUC of train with its interval, and accuracy, sensitivity and specificity of each part."""
    found = dispatch.results(spark, path)
    if found is None:
        return None
    of = lambda mix, c: F.max(F.when(F.col("mix") == mix, F.col(c))).alias(f"{mix}_{c}")
    train = [of("train", c) for c in ("auc", "auc_low", "auc_high")]
    return found.groupBy("method", "algorithm", "settings", "model").agg(*train, *[of(mix, c) for mix in ("train", "test", "valid") for c in FIGURES])


def apply_best(spark: SparkSession, path: str, long: DataFrame, features_of: dict[str, list[str]]) -> DataFrame:
    """(sample_id, label, score, predicted) of ``long`` by the stored model of largest valid accuracy (then test, then train; ties: by names)."""
    order = [F.desc(f"{mix}_accuracy") for mix in ("valid", "test", "train")]
    best = board(spark, path).orderBy(*order, "method", "algorithm").first()
    data, _ = models.vectors(long.where(F.col("feature").isin(features_of[best.method])))
    return scored(PipelineModel.load(best.model), best.algorithm, data)
