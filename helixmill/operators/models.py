"""Selectors and projections by fitted models (spark.ml) over long tables (sample_id, class, feature, value).

A sample with a missing value is left out, as is one that lacks a feature. Tables without samples of both classes give an error from spark.ml, not a guess.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.operators import evaluation


def vectors(long: DataFrame) -> tuple[DataFrame, list[str]]:
    """(sample_id, label, x) with one vector for each complete sample, and the features' names in the vector's order."""
    names = [r.feature for r in long.select("feature").distinct().orderBy("feature").collect()]
    sorted_values = F.transform(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("feature", "value")))), lambda s: s["value"])
    rows = long.groupBy("sample_id").agg((F.first("class") == "Case").cast("double").alias("label"), sorted_values.alias("v")).where(F.size("v") == len(names))
    return rows.select("sample_id", "label", array_to_vector("v").alias("x")), names


def _ranked(long: DataFrame, names: list[str], figures, name: str) -> DataFrame:
    rows = sorted(zip(names, map(float, figures), strict=True), key=lambda x: (-abs(x[1]), x[0]))
    return long.sparkSession.createDataFrame([(i + 1, f, x) for i, (f, x) in enumerate(rows) if x], f"rank int, feature string, {name} double")


def lasso(long: DataFrame, penalty: float = 0.01, mix: float = 1.0) -> DataFrame:
    """Features with a coefficient other than zero, largest first. ``mix`` 1 is the lasso, between 0 and 1 the elastic net."""
    data, names = vectors(long)
    fitted = LogisticRegression(featuresCol="x", regParam=penalty, elasticNetParam=mix, maxIter=200).fit(data)
    return _ranked(long, names, fitted.coefficients, "coefficient")


def wx(long: DataFrame) -> DataFrame:
    """Discriminative index of a softmax layer: |m1 w1 - m1 w0| + |m0 w0 - m0 w1|, with m the feature's mean in a class and w its weight for it."""
    data, names = vectors(long)
    w0, w1 = LogisticRegression(featuresCol="x", family="multinomial", regParam=0.001).fit(data).coefficientMatrix.toArray()
    means = {r.feature: r for r in long.groupBy("feature").agg(F.avg(F.when(F.col("class") == "Case", F.col("value"))).alias("m1"), F.avg(F.when(F.col("class") != "Case", F.col("value"))).alias("m0")).collect()}
    return _ranked(long, names, [(abs(means[f].m1) + abs(means[f].m0)) * abs(w1[i] - w0[i]) for i, f in enumerate(names)], "score")


def forest_importance(long: DataFrame, trees: int = 50, seed: int = 1) -> DataFrame:
    """Features by importance in a random forest; those in no split are left out."""
    data, names = vectors(long)
    return _ranked(long, names, RandomForestClassifier(featuresCol="x", numTrees=trees, seed=seed).fit(data).featureImportances.toArray(), "importance")


def pca_scores(long: DataFrame, k: int = 3) -> DataFrame:
    """(sample_id, label, pc1 ... pck): scores on the components of centred, scaled features. Each component's sign makes its largest loading positive."""
    data, _ = vectors(long)
    scaled = StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True).fit(data).transform(data)
    fitted = PCA(k=k, inputCol="z", outputCol="s").fit(scaled)
    loadings = fitted.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, i]).argmax(), i] > 0 else -1.0 for i in range(k)]
    scores = fitted.transform(scaled).withColumn("s", vector_to_array("s"))
    return scores.select("sample_id", "label", *[(F.col("s")[i] * signs[i]).alias(f"pc{i + 1}") for i in range(k)])


def forward_cfs(long: DataFrame, k: int = 11) -> DataFrame:
    """(rank, feature, merit): features added one by one while the merit k r_cf / sqrt(k + k (k - 1) r_ff) grows, at most ``k``. Correlations come from one distributed pass; the search sees a matrix of features by features."""
    data, names = vectors(long)
    both = data.select(array_to_vector(F.concat(vector_to_array("x"), F.array("label"))).alias("x"))
    r = abs(np.nan_to_num(Correlation.corr(both, "x").first()[0].toArray()))
    chosen, merits = [], []
    while len(chosen) < min(k, len(names)):
        n = len(chosen) + 1
        best = (0.0, 0)
        for i in (i for i in range(len(names)) if i not in chosen):
            now = [*chosen, i]
            within = (r[np.ix_(now, now)].sum() - n) / 2
            best = max(best, (float(r[now, -1].sum() / np.sqrt(n + 2 * within)), -i))
        if merits and best[0] <= merits[-1]:
            break
        chosen.append(-best[1])
        merits.append(best[0])
    return long.sparkSession.createDataFrame([(i + 1, names[j], m) for i, (j, m) in enumerate(zip(chosen, merits, strict=True))], "rank int, feature string, merit double")


def recursive_elimination(long: DataFrame, k: int, share: float = 0.3, trees: int = 30) -> DataFrame:
    """(size, feature): the features left at each size when a forest is fitted again and again without the least important ``share``, down to ``k``."""
    left = [r.feature for r in long.select("feature").distinct().orderBy("feature").collect()]
    rows = [(len(left), f) for f in left]
    while len(left) > k:
        ranked = [r.feature for r in forest_importance(long.where(F.col("feature").isin(left)), trees).orderBy("rank").collect()]
        ranked += [f for f in left if f not in ranked]
        left = ranked[: max(k, int(len(left) * (1 - share)))]
        rows += [(len(left), f) for f in left]
    return long.sparkSession.createDataFrame(rows, "size int, feature string")


def benchmark(long: DataFrame, formulas: dict[str, list[str]], seed: int = 1) -> DataFrame:
    """Metrics by method (a formula's name), algorithm and mix (train, test, valid): confusion figures of models fitted on the train part. ``long`` has a mix column. The driver goes through formulas and algorithms, never through samples."""
    mixes = long.select("sample_id", "mix").distinct()
    out = None
    for method, features in formulas.items():
        data = vectors(long.where(F.col("feature").isin(features)))[0].join(mixes, "sample_id")
        for name, algorithm in (("logistic", LogisticRegression(featuresCol="x")), ("tree", DecisionTreeClassifier(featuresCol="x", seed=seed)), ("forest", RandomForestClassifier(featuresCol="x", seed=seed, numTrees=20))):
            told = algorithm.fit(data.where("mix = 'train'")).transform(data)
            rows = told.select(F.lit(method).alias("method"), F.lit(name).alias("algorithm"), "mix", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))
            out = rows if out is None else out.unionByName(rows)
    return evaluation.confusion(out, ("method", "algorithm", "mix"))
