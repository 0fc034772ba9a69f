"""Selectors that fit models again and again, matching, clustering and network grids, over long tables (sample_id, class, feature, value). The driver goes through features, steps or grid cells; samples stay in Spark.

As in ``models``, samples with a missing value are left out, and tables without both classes give an error from spark.ml.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from math import erfc, sqrt

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.operators import evaluation, models, trees
from helixmill.operators.transforms import uniform
from helixmill.sources import stores

#: Samples whose order one task decides, in shuffling and in matching.
BLOCK, MATCHED = 4096, 100_000
#: Models that are fitted together, passes that a model may take, and the move of coefficients at which it is done.
AHEAD, STEPS, CLOSE = 16, 50, 1e-6


@dataclass
class Logit:
    """A binomial model of ``features`` on standardised values: intercept and coefficients, the inverse information, and -2 log-likelihood."""

    features: tuple[int, ...]
    beta: np.ndarray
    inverse: np.ndarray
    deviance: float

    def z(self) -> np.ndarray:
        """Coefficients by their standard errors; 0 where the data do not tell one."""
        var = np.diag(self.inverse)[1:]
        return np.divide(self.beta[1:], np.sqrt(var), out=np.zeros(len(var)), where=np.isfinite(var) & (var > 0))

    def without(self, worst: int) -> Logit:
        """About the model without its feature number ``worst``, where the likelihood is quadratic."""
        at, left = worst + 1, np.delete(np.arange(len(self.beta)), worst + 1)
        column, v = self.inverse[left, at], self.inverse[at, at]
        if not (np.isfinite(self.inverse).all() and v > 0):
            return Logit(tuple(np.delete(self.features, worst).tolist()), self.beta[left], self.inverse[np.ix_(left, left)], self.deviance)
        return Logit(tuple(np.delete(self.features, worst).tolist()), self.beta[left] - column * (self.beta[at] / v), self.inverse[np.ix_(left, left)] - np.outer(column, column) / v, self.deviance + self.beta[at] ** 2 / v)


def worst_of(model: Logit) -> tuple[int, float]:
    """The feature of the largest p-value, which is that of the smallest z, and that p-value."""
    z = abs(model.z())
    worst = int(z.argmin())
    return worst, erfc(z[worst] / sqrt(2))


def logits(rows: DataFrame, starts: list[Logit], centre: np.ndarray, scale: np.ndarray) -> dict[tuple[int, ...], Logit]:
    """The models of the features of ``starts``, from there on by Newton's method: all take a step a pass over ``rows`` (label, x). A step that raises a deviance is halved. A model is done when no coefficient moves by ``CLOSE``, when its deviance stays as it is (separable classes), or after ``STEPS`` passes. Coefficients that the data do not tell have an infinite variance."""
    at, step, best, done = {m.features: m.beta for m in starts}, {}, {}, {}
    for _ in range(STEPS):
        asked = [(f, b) for f, b in at.items() if f not in done]
        if not asked:
            break

        def add(batches, asked=asked):
            total = [np.zeros(1 + (len(f) + 1) * (len(f) + 2)) for f, _ in asked]
            for batch in batches:
                for first in range(0, batch.num_rows, 2048):
                    part = batch.slice(first, 2048)
                    y = part.column("label").to_numpy(zero_copy_only=False)
                    x = np.hstack([np.ones((len(y), 1)), (part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1) - centre) * scale])
                    for sums, (f, b) in zip(total, asked, strict=True):
                        own = x[:, [0, *(i + 1 for i in f)]]
                        eta = own @ b
                        mu = 0.5 + 0.5 * np.tanh(eta / 2)
                        q = len(b)
                        sums[0] += 2 * np.logaddexp(0.0, np.where(y == 1, -eta, eta)).sum()
                        sums[1 : 1 + q] += own.T @ (y - mu)
                        sums[1 + q :] += (own.T @ ((mu * (1 - mu))[:, None] * own)).ravel()
            yield trees.batch_of(total)

        for k, sums in trees.summed(rows, add).items():
            f, b = asked[k]
            q = len(b)
            deviance, gradient, information = float(sums[0]), sums[1 : 1 + q], sums[1 + q :].reshape(q, q)
            if f in best and deviance > best[f].deviance + 1e-9 * (1 + abs(best[f].deviance)):
                step[f] = step[f] / 2
                at[f] = best[f].beta + step[f]
                continue
            inverse = np.linalg.pinv(information, rcond=1e-12, hermitian=True)
            untold = np.diag(inverse @ information) < 1 - 1e-6
            step[f] = inverse @ gradient
            variance = inverse.copy()
            variance[untold, untold] = np.inf
            stays = f in best and abs(deviance - best[f].deviance) < 1e-10 * (abs(deviance) + 0.1)
            best[f] = Logit(f, b, variance, deviance)
            at[f] = b + step[f]
            if stays or abs(step[f]).max() < CLOSE:
                # the last step, too small to alter the information, is taken all the same
                done[f] = Logit(f, at[f], variance, deviance - float(gradient @ step[f]))
    return {f: done.get(f, m) for f, m in best.items()}


def foreseen(model: Logit, by: str, most_p: float) -> list[Logit]:
    """About the next models of ``backward_logit``, at least one."""
    out: list[Logit] = []
    while len(out) < AHEAD and len(model.features) > 1:
        worst, p = worst_of(model)
        if out and (p <= most_p if by == "p" else out[-1].deviance > before + 2):
            break
        before, model = model.deviance, model.without(worst)
        out.append(model)
    return out


def backward_logit(long: DataFrame, by: str = "aic", most_p: float = 0.05) -> DataFrame:
    """(step, n_features, removed, aic): a binomial model without the feature of the largest p-value, step by step: while the AIC does not rise (``by`` "aic"), or until all p-values are at most ``most_p`` ("p"). The first row has all features. What is left is what no row removes.

    The next ``AHEAD`` models are foreseen from the last one and fitted together; as soon as a fitted model's largest p-value is another feature's than foreseen, those after it are foreseen anew. So each row is of a model that was fitted to the end, and each feature removed that of its largest p-value.
    """
    data, names = models.vectors(long)
    rows = data.select("label", vector_to_array("x").alias("x")).persist()
    told, out, now = data.select(Summarizer.metrics("mean", "std", "count").summary(F.col("x")).alias("s")).first().s, [], tuple(range(len(names)))
    if names and not (told and told["count"]):
        raise ValueError("no sample has every feature")
    centre, std = (told[x].toArray() for x in ("mean", "std")) if names else (np.zeros(0),) * 2
    scale = np.divide(1.0, std, out=np.zeros(len(std)), where=std > 0)
    ahead, fitted, removed, last = [Logit(now, np.zeros(len(now) + 1), np.zeros((len(now) + 1,) * 2), 0.0)], {}, None, None
    while now:
        if now not in fitted:
            fitted = logits(rows, ahead, centre, scale)
        model = fitted[now]
        aic = model.deviance + 2 * (len(now) + 1)
        if by == "aic" and last is not None and aic > last:
            break
        last = aic
        out.append((len(out), len(now), removed, float(last)))
        worst, p = worst_of(model)
        if len(now) == 1 or (by == "p" and p <= most_p):
            break
        removed, now = names[now[worst]], (*now[:worst], *now[worst + 1 :])
        if now not in fitted:
            ahead = foreseen(model, by, most_p)
    rows.unpersist()
    return long.sparkSession.createDataFrame(out, "step int, n_features int, removed string, aic double")


def shadowed(data: DataFrame, seed: int) -> DataFrame:
    """``data`` (sample_id, label, x) with the values of another sample behind each ``x``: samples are paired at random within random blocks, so that shadows know nothing of the label."""
    blocks = max(1, -(-data.count() // BLOCK))
    dealt = data.withColumn("_b", F.floor(uniform(seed, "block", F.col("sample_id")) * blocks))
    at = lambda name: F.row_number().over(Window.partitionBy("_b").orderBy(uniform(seed, name, F.col("sample_id")), "sample_id"))
    other = dealt.select("_b", F.col("x").alias("y"), at("there").alias("_k"))
    return dealt.withColumn("_k", at("here")).join(other, ["_b", "_k"]).select("sample_id", "label", array_to_vector(F.concat(vector_to_array("x"), vector_to_array("y"))).alias("x"))


def boruta(long: DataFrame, rounds: int = 12, trees: int = 30, level: float = 0.05, seed: int = 1) -> DataFrame:
    """(feature, hits, decision): in each round a forest sees every feature and its shadow, and a feature more important than the best shadow has a hit. Confirmed: more hits than chance (one half) gives at ``level``, corrected for the number of features; Rejected: as few; else Tentative."""
    from math import comb

    data, names = models.vectors(long)
    data = data.persist()
    hits = np.zeros(len(names), int)
    for i in range(rounds):
        seen = RandomForestClassifier(featuresCol="x", numTrees=trees, seed=seed + i).fit(shadowed(data, seed + i)).featureImportances.toArray()
        hits += seen[: len(names)] > seen[len(names) :].max()
    data.unpersist()
    tail = lambda k: sum(comb(rounds, j) for j in range(k, rounds + 1)) / 2**rounds
    told = lambda h: "Confirmed" if tail(h) * len(names) <= level else "Rejected" if tail(rounds - h) * len(names) <= level else "Tentative"
    return long.sparkSession.createDataFrame([(f, int(h), told(int(h))) for f, h in zip(names, hits, strict=True)], "feature string, hits int, decision string")


def forward_wrapper(long: DataFrame, fold, k: int = 3, candidates: int | None = None, folds: int = 3) -> DataFrame:
    """(rank, feature, accuracy): features added one by one while the cross-validated accuracy of a decision tree grows, each step trying every open feature (or only the ``candidates`` that correlate most with the class, if given); ties go to the larger correlation. A step's trees, of depth 3, are grown together, a pass a level. ``fold`` is a Column of sample_id, 0 to ``folds`` - 1."""
    data, names = models.vectors(long)
    data = data.withColumn("f", fold).persist()
    r = abs(np.nan_to_num(Correlation.corr(data.select(array_to_vector(F.concat(vector_to_array("x"), F.array("label"))).alias("x")), "x").first()[0].toArray()))[:-1, -1]
    open_ = sorted(range(len(names)), key=lambda i: (-r[i], i))[:candidates]
    n, chosen, rows = data.count(), [], []
    dealt = trees.binned(data, folds, len(names)).persist()
    while open_ and len(chosen) < k:
        right = trees.right_told(dealt, [[*chosen, i] for i in open_], folds, len(names))
        best, at = max((int(x) / max(n, 1), -at) for at, x in enumerate(right))
        if rows and best <= rows[-1][2]:
            break
        chosen.append(open_.pop(-at))
        rows.append((len(chosen), names[chosen[-1]], best))
    dealt.unpersist()
    data.unpersist()
    return long.sparkSession.createDataFrame(rows, "rank int, feature string, accuracy double")


def _nearest_free(cases: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """For each case, in the order given, the place of the nearest free control in the sorted ``pool`` (of two equally near the lower), which is then taken; -1 once none is left. Taken places are skipped by links that are shortened on the way."""
    n = len(pool)
    down, up = np.arange(n + 1), np.arange(n + 1)  # down: place + 1 of the nearest free one at or below, 0 for none

    def find(links, i):
        root = i
        while links[root] != root:
            root = links[root]
        while links[i] != root:
            links[i], i = root, links[i]
        return root

    out = np.full(len(cases), -1)
    for k, (s, at) in enumerate(zip(cases, np.searchsorted(pool, cases), strict=True)):
        low, high = find(down, at) - 1, find(up, at)
        if low < 0 and high >= n:
            break
        j = low if high >= n or (low >= 0 and s - pool[low] <= pool[high] - s) else high
        out[k], down[j + 1], up[j] = j, j, j + 1
    return out


def _transfers(cases: dict[int, int], controls: dict[int, int]) -> list[tuple]:
    """(id, case stratum, its first, control stratum, its first, how many): the cases left over in a stratum, from the highest scores on, with the controls left over in the nearest strata."""
    free, used, out = dict(controls), dict.fromkeys(controls, 0), []
    order = sorted(s for s in controls if controls[s])
    low, high = {s: i for i, s in enumerate(order)}, len(order)
    down, up = list(range(high + 1)), list(range(high + 1))

    def find(links, i):
        while links[i] != i:
            links[i] = links[links[i]]
            i = links[i]
        return i

    for s in sorted(cases):
        at, done = bisect_left(order, s), 0
        while done < cases[s]:
            i, j = find(down, at) - 1, find(up, at)
            if i < 0 and j >= high:
                return out
            t = order[i] if j >= high or (i >= 0 and s - order[i] <= order[j] - s) else order[j]
            n = min(cases[s] - done, free[t])
            out.append((len(out), s, done, t, used[t], n))
            done, used[t], free[t] = done + n, used[t] + n, free[t] - n
            if not free[t]:
                k = low[t]
                down[k + 1], up[k] = k, k + 1
    return out


def matched(samples: DataFrame, covariates: list[str]) -> DataFrame:
    """(case_id, control_id, case_score, control_score): every case with a control of near propensity (logit scale), each control once, cases of larger score first, until cases or controls are used up.

    ``samples`` is (sample_id, label 0 or 1, covariates). Rows with a missing covariate are left out. Matching is greedy within strata of about ``MATCHED`` neighbouring scores (rows of one score are told apart by their ids, so no stratum is larger); what strata have left over then goes to the nearest strata with controls left over, a plan of which the driver holds a row a stratum. So the number of matches does not depend on the strata, and one stratum is plain greedy matching.
    """
    spark = samples.sparkSession
    full = samples.dropna(subset=covariates).select("sample_id", F.col("label").cast("double").alias("label"), array_to_vector(F.array(*[F.col(c).cast("double") for c in covariates])).alias("x"))
    fitted = LogisticRegression(featuresCol="x", maxIter=100, tol=1e-9).fit(full)
    scored = fitted.transform(full).select("sample_id", F.col("label").cast("int").alias("label"), vector_to_array("rawPrediction")[1].alias("score"))
    strata = max(1, -(-full.count() // MATCHED))
    dealt = stores.written(scored.repartitionByRange(strata, F.desc("score"), "sample_id").withColumn("stratum", F.spark_partition_id()), stores.new_folder(spark, "strata"))
    kind = scored.schema["sample_id"].dataType.simpleString()

    def pair(block: pd.DataFrame) -> pd.DataFrame:
        cases = block[block.label == 1].sort_values(["score", "sample_id"], ascending=[False, True])
        pool = block[block.label == 0].sort_values(["score", "sample_id"])
        at = _nearest_free(cases.score.to_numpy(), pool.score.to_numpy())
        with_control = cases[at >= 0]
        taken = pool.iloc[at[at >= 0]]
        rows = [pd.DataFrame({"case_id": with_control.sample_id.to_numpy(), "control_id": taken.sample_id.to_numpy(), "case_score": with_control.score.to_numpy(), "control_score": taken.score.to_numpy()}).astype({"case_id": object, "control_id": object})]
        alone, free = cases[at < 0], pool.drop(index=taken.index)
        rows.append(pd.DataFrame({"case_id": alone.sample_id.astype(object), "control_id": None, "case_score": alone.score, "control_score": np.nan}))
        rows.append(pd.DataFrame({"case_id": None, "control_id": free.sample_id.astype(object), "case_score": np.nan, "control_score": free.score}))
        return pd.concat([r for r in rows if len(r)] or rows[:1]).assign(stratum=int(block.stratum.iloc[0]))[["stratum", "case_id", "control_id", "case_score", "control_score"]]

    columns = ("case_id", "control_id", "case_score", "control_score")
    paired = stores.written(dealt.groupBy("stratum").applyInPandas(pair, f"stratum int, case_id {kind}, control_id {kind}, case_score double, control_score double"), stores.new_folder(spark, "pairs"))
    done = paired.where("case_id is not null and control_id is not null").select(*columns)
    left = paired.groupBy("stratum").agg(F.count_if(F.col("control_id").isNull()).alias("cases"), F.count_if(F.col("case_id").isNull()).alias("controls")).where("cases + controls > 0").collect()  # a row a stratum
    plan = _transfers({r.stratum: r.cases for r in left if r.cases}, {r.stratum: r.controls for r in left if r.controls})
    if not plan:
        return done
    plan = spark.createDataFrame(plan, "transfer bigint, case_stratum int, case_from bigint, control_stratum int, control_from bigint, n bigint")

    def side(name: str, other: str) -> DataFrame:
        order = Window.partitionBy("stratum").orderBy(F.desc(f"{name}_score"), f"{name}_id")  # a stratum's rows
        ranked = paired.where(f"{other}_id is null").withColumn("k", F.row_number().over(order) - 1)
        at = F.col("k") - F.col(f"{name}_from")
        return ranked.join(plan, F.col("stratum") == F.col(f"{name}_stratum")).where((at >= 0) & (at < F.col("n"))).select("transfer", at.alias("k"), f"{name}_id", f"{name}_score")

    moved = side("case", "control").join(side("control", "case"), ["transfer", "k"])
    return done.unionByName(moved.select(*columns))


def feature_clusters(distances: DataFrame, clusters: int) -> DataFrame:
    """(feature, cluster): average linkage on (feature_a, feature_b, distance), cut at ``clusters``; clusters are numbered by their smallest feature. The driver holds features by features."""
    rows = distances.collect()
    names = sorted({r.feature_a for r in rows} | {r.feature_b for r in rows})
    at = {f: i for i, f in enumerate(names)}
    d = np.full((len(names), len(names)), np.inf)
    for r in rows:
        d[at[r.feature_a], at[r.feature_b]] = d[at[r.feature_b], at[r.feature_a]] = r.distance
    member, size = {i: [i] for i in range(len(names))}, np.ones(len(names))
    while len(member) > max(clusters, 1):
        a, b = sorted(divmod(int(d.argmin()), len(names)))
        new = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        new[a] = np.inf
        d[a], d[:, a] = new, new
        d[b], d[:, b] = np.inf, np.inf
        size[a] += size[b]
        member[a] += member.pop(b)
    found = sorted(member.values(), key=min)
    return distances.sparkSession.createDataFrame([(names[i], c) for c, m in enumerate(found) for i in m], "feature string, cluster int")


def network_grid(long: DataFrame, layers: list[list[int]], steps: int = 60, seed: int = 1) -> DataFrame:
    """(model_id, layers, mix, cutoff, metrics): feed-forward networks with these hidden layers, fitted on scaled train samples; the cutoff of the largest Youden index on train is used on every part. ``long`` has a mix column (train, test, valid). Cells are fitted one after another, each over all samples in Spark."""
    mixes = long.select("sample_id", "mix").distinct()
    data, names = models.vectors(long)
    data = data.join(mixes, "sample_id")
    scaler = StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True).fit(data.where("mix = 'train'"))
    data, out = scaler.transform(data).select("sample_id", "label", "mix", "z").persist(), None
    for i, hidden in enumerate(layers):
        fitted = MultilayerPerceptronClassifier(featuresCol="z", layers=[len(names), *hidden, 2], maxIter=steps, seed=seed).fit(data.where("mix = 'train'"))
        told = fitted.transform(data).select(F.lit(i + 1).alias("model_id"), F.lit("-".join(map(str, hidden))).alias("layers"), "mix", F.col("label").cast("int").alias("label"), vector_to_array("probability")[1].alias("score"))
        out = told if out is None else out.unionByName(told)
    cutoffs = evaluation.youden(out.where("mix = 'train'").select(F.col("model_id").alias("feature"), "score", "label")).select(F.col("feature").alias("model_id"), "cutoff")
    judged = out.join(F.broadcast(cutoffs), "model_id").withColumn("predicted", (F.col("score") >= F.col("cutoff")).cast("int"))  # a row a model
    return evaluation.confusion(judged, ("model_id", "layers", "mix", "cutoff"))
