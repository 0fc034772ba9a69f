"""Chained-equations imputation by predictive mean matching, for long tables (sample_id, feature, value).

A missing value is given an observed one of its feature: that of one of the ``donors`` samples whose predicted value is nearest. Predictions come from a linear regression of the feature on all others, over the samples that have it, with missing values of others as they were last filled. Gram sums of several features are added up in one pass; donors are found in buckets of neighbouring predictions, each with the nearest observed samples beyond its borders, so no feature is one task's. Every pass ends with a written table.

Defined cases: observed values are never changed; a feature without an observed value stays null, and takes part in no regression; of equally near donors those of smaller ids are taken (samples of one prediction share a bucket); with fewer observed samples than ``donors`` all are. A repeated (sample, feature) counts with its smallest value. Draws are hashes, the same on any partitioning. Empty tables stay empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.operators import ranks
from helixmill.operators.transforms import uniform
from helixmill.sources import stores

#: Bytes of a task's Gram sums, which bound the features that a pass fills, and samples of a bucket of predictions.
BYTES, BUCKET = 64_000_000, 200_000
RIDGE = 1e-8


def nearest_donors(block: pd.DataFrame, donors: int) -> pd.DataFrame:
    """(sample_id, value) of the missing rows of a bucket: the value of donor floor(u * k) among the k nearest observed rows, in order of distance and then id. Rows are (sample_id, predicted, value or null, u)."""
    held = block[block.value.notna()].sort_values(["predicted", "sample_id"])
    asked = block[block.value.isna()]
    at, ids, values = held.predicted.to_numpy(), held.sample_id.to_numpy(), held.value.to_numpy()
    out = []
    for s, u in zip(asked.predicted, asked.u, strict=True):
        k = min(donors, len(at))
        # all at the distance of the k-th on either side, so that ties are settled by ids
        i = int(np.searchsorted(at, s))
        low, high = max(0, i - k), min(len(at), i + k)
        far = np.sort(np.abs(at[low:high] - s))[k - 1]
        low, high = int(np.searchsorted(at, s - far * (1 + 1e-12) - 1e-300)), int(np.searchsorted(at, s + far * (1 + 1e-12) + 1e-300, side="right"))
        near = sorted(zip(np.abs(at[low:high] - s), ids[low:high], values[low:high], strict=True))[:k]
        out.append(near[int(u * k)][2])
    return pd.DataFrame({"sample_id": asked.sample_id.to_numpy(), "value": np.array(out, float)})


def impute_pmm(long: DataFrame, rounds: int = 5, donors: int = 5, seed: int = 1) -> DataFrame:
    """``long`` (sample_id, feature, value), a row a sample and feature, with every missing value filled."""
    spark = long.sparkSession
    names = [r.feature for r in long.where("value is not null").select("feature").distinct().orderBy("feature").collect()]  # a row a feature
    if not names:
        return long.select("sample_id", "feature", "value")
    found = F.map_from_entries(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("feature", "value"))))
    once = long.groupBy("sample_id", "feature").agg(F.min(F.col("value").cast("double")).alias("value"))
    wide = once.groupBy("sample_id").agg(found.alias("m")).select("sample_id", F.array(*[F.try_element_at("m", F.lit(f)) for f in names]).alias("seen"))
    means = wide.agg(*[F.avg(F.get("seen", F.lit(i))).alias(str(i)) for i in range(len(names))]).first()
    filled = F.array(*[F.coalesce(F.get("seen", F.lit(i)), F.lit(float(m))) for i, m in enumerate(means)])
    path = stores.new_folder(spark, "imputed")
    table = stores.written(wide.withColumn("x", filled), path)
    gaps = table.agg(F.count("*").alias("n"), *[F.count_if(F.get("seen", F.lit(i)).isNull()).alias(str(i)) for i in range(len(names))]).first()
    targets = sorted((i for i in range(len(names)) if gaps[str(i)]), key=lambda i: (gaps[str(i)], names[i]))
    together = max(1, BYTES // (8 * (len(names) + 1) ** 2))
    for k in range(rounds):
        for begin in range(0, len(targets), together):
            new_path = stores.new_folder(spark, "imputed")
            table = stores.written(_filled(table, targets[begin : begin + together], np.array(means, float), donors, -(-gaps.n // BUCKET), (seed, k)), new_path)
            stores.remove(spark, path)
            path = new_path
    shown = table.select("sample_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), "x")).alias("feature", "_filled"))
    return long.join(shown, ["sample_id", "feature"], "left").select("sample_id", "feature", F.coalesce(F.col("value").cast("double"), "_filled").alias("value"))


def _filled(table: DataFrame, targets: list[int], means: np.ndarray, donors: int, buckets: int, seed: tuple) -> DataFrame:
    """(sample_id, seen, x) with the missing values of ``targets`` drawn anew, from predictions on the table as it is."""
    p, kind = len(means), table.schema["sample_id"].dataType.simpleString()

    def blocks(batch):
        return np.hstack([np.ones((batch.num_rows, 1)), batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p) - means]), ~np.isnan(batch.column("seen").flatten().to_numpy(zero_copy_only=False).reshape(-1, p))

    def add(batches):
        total = np.zeros((len(targets), p + 1, p + 1))
        for batch in batches:
            x, there = blocks(batch)
            for i, j in enumerate(targets):
                rows = x[there[:, j]]
                total[i] += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(targets, pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["target", "sums"])

    def solve(block: pd.DataFrame) -> pd.DataFrame:
        j, gram = int(block["target"].iloc[0]), sum(np.frombuffer(s).reshape(p + 1, p + 1) for s in block["sums"])
        others = [i for i in range(p + 1) if i != j + 1]
        inner = gram[np.ix_(others, others)]
        slope = np.zeros(p + 1)
        slope[others] = np.linalg.lstsq(inner + np.diag(np.diag(inner) * RIDGE), gram[others, j + 1], rcond=None)[0]
        return pd.DataFrame({"target": [j], "slope": [slope.tolist()]})

    slopes = {r.target: np.array(r.slope) for r in table.mapInArrow(add, "target int, sums binary").groupBy("target").applyInPandas(solve, "target int, slope array<double>").collect()}  # coefficients of each target

    def predict(batches):
        for batch in batches:
            x, there = blocks(batch)
            for j in targets:
                value = np.where(there[:, j], batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)[:, j], np.nan)
                yield pa.RecordBatch.from_arrays([pa.array([j] * len(x), pa.int32()), batch.column("sample_id"), pa.array(x @ slopes[j]), pa.array(value, from_pandas=True)], ["target", "sample_id", "predicted", "value"])

    told = table.mapInArrow(predict, f"target int, sample_id {kind}, predicted double, value double")
    dealt = ranks.in_buckets(told, ("target",), "predicted", buckets, tie=("sample_id",)).select("*", uniform(*seed, "donor", F.col("target"), F.col("sample_id")).alias("u"))

    def beyond(block: pd.DataFrame) -> pd.DataFrame:
        """Of a target's border rows, those nearest to each bucket on either side."""
        out = []
        for b in range(buckets):
            below, above = block[block._b < b].nlargest(donors, "predicted", keep="all"), block[block._b > b].nsmallest(donors, "predicted", keep="all")
            out.append(pd.concat([below, above]).assign(_b=b))
        return pd.concat(out)

    columns = ("target", "_b", "sample_id", "predicted", "value", "u")
    work = dealt.select(*columns)
    if buckets > 1:
        edge = lambda order: F.rank().over(Window.partitionBy("target", "_b").orderBy(order))
        borders = work.where("value is not null").withColumn("l", edge(F.asc("predicted"))).withColumn("h", edge(F.desc("predicted"))).where((F.col("l") <= donors) | (F.col("h") <= donors)).select(*columns)
        work = work.unionByName(borders.groupBy("target").applyInPandas(beyond, f"target int, _b int, sample_id {kind}, predicted double, value double, u double"))

    def draw(block: pd.DataFrame) -> pd.DataFrame:
        return nearest_donors(block, donors).assign(target=int(block.target.iloc[0]))[["target", "sample_id", "value"]]

    drawn = work.groupBy("target", "_b").applyInPandas(draw, f"target int, sample_id {kind}, value double")
    of = drawn.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("target", "value"))).alias("new"))
    return table.join(of, "sample_id", "left").select("sample_id", "seen", F.transform("x", lambda v, i: F.coalesce(F.try_element_at("new", i), v)).alias("x"))
