"""Many small decision trees at once: each level of all of them is one pass over the samples, which adds up counts by bin.

The trees are those of spark.ml's DecisionTreeClassifier on the same bins: Gini impurity, a node's best split over its features and bins (of equals the first), none if it gains nothing. Bins are cut as there, at midpoints between values, from all samples of a training part or about ``DRAWN`` of them, drawn by a hash.

Defined cases: a feature that does not vary has one bin and so no split; a leaf with as many of either class tells class 0; samples with a null fold are in no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a feature, samples that its cuts are told from, and bytes of the counts of a pass that a task hands on.
BINS, DRAWN, BYTES = 32, 10_000, 32_000_000


def summed(rows: DataFrame, add) -> dict[int, np.ndarray]:
    """What ``add`` yields from record batches of ``rows``, (model int, sums of doubles as binary), added up by model."""

    def total(block: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [int(block["model"].iloc[0])], "sums": [sum(np.frombuffer(s) for s in block["sums"]).tobytes()]})

    got = rows.mapInArrow(add, "model int, sums binary").groupBy("model").applyInPandas(total, "model int, sums binary").collect()  # a row a model
    return {r.model: np.frombuffer(r.sums) for r in got}


def batch_of(sums) -> pa.RecordBatch:
    """A row a model for ``summed``."""
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype="i4")), pa.array([np.asarray(x, float).tobytes() for x in sums], pa.binary())], ["model", "sums"])


def cuts_of(values: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` - 1 cuts between the values, as evenly as repeated ones allow."""
    at, counts = np.unique(values, return_counts=True)
    if len(at) <= bins:
        return (at[:-1] + at[1:]) / 2
    stride, cuts = len(values) / bins, []
    target, upto = stride, np.cumsum(counts)
    for i in range(1, len(at)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            cuts.append((at[i - 1] + at[i]) / 2)
            target += stride
    return np.array(cuts)


def binned(data: DataFrame, folds: int, width: int) -> DataFrame:
    """(label, f, bins) of ``data`` (sample_id, label, x, f): for each fold and feature a byte, the bin by the cuts of that fold's training part."""
    n = data.agg(*[F.count_if(F.col("f") != i).alias(str(i)) for i in range(folds)]).first()
    parts = F.filter(F.array(*[F.when((F.col("f") != i) & (F.pmod(F.xxhash64("sample_id", F.lit("cuts"), F.lit(i)), F.lit(1 << 30)) < int(min(1.0, DRAWN / max(n[i], 1)) * (1 << 30))), F.lit(i)) for i in range(folds)]), lambda i: i.isNotNull())

    def told(block: pd.DataFrame) -> pd.DataFrame:
        x, fold = np.stack(block["x"].to_numpy()), int(block["part"].iloc[0])
        return pd.DataFrame({"part": [fold], "cuts": [[cuts_of(c, min(BINS, n[fold])).tolist() for c in x.T]]})

    drawn = data.select(F.explode(parts).alias("part"), vector_to_array("x").alias("x"))
    cuts = {r.part: [np.array(c) for c in r.cuts] for r in drawn.groupBy("part").applyInPandas(told, "part int, cuts array<array<double>>").collect()}  # a row a fold

    def deal(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            out = np.zeros((len(x), folds, width), "u1")
            for i, of in cuts.items():
                for j, c in enumerate(of):
                    out[:, i, j] = np.searchsorted(c, x[:, j], side="left")
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("f"), pa.array([b.tobytes() for b in out], pa.binary())], ["label", "f", "bins"])

    return data.select("label", F.col("f").cast("bigint").alias("f"), vector_to_array("x").alias("x")).mapInArrow(deal, "label double, f bigint, bins binary")


def gini(counts: np.ndarray) -> np.ndarray:
    total = np.maximum(counts.sum(-1), 1)
    return 1.0 - (counts[..., 0] / total) ** 2 - (counts[..., 1] / total) ** 2


def best_split(counts: np.ndarray) -> tuple[int, int] | None:
    """(feature, last bin to the left) of the split of ``counts`` (feature, bin, class) that gains most, if one gains."""
    left = counts.cumsum(axis=1)[:, :-1]
    whole = counts[0].sum(axis=0)
    right, n = whole - left, max(whole.sum(), 1)
    gain = gini(whole) - left.sum(-1) / n * gini(left) - right.sum(-1) / n * gini(right)
    gain[(left.sum(-1) < 1) | (right.sum(-1) < 1)] = -np.inf
    at = int(gain.argmax())
    return divmod(at, gain.shape[1]) if gain.flat[at] > 0 else None


def right_told(rows: DataFrame, tried: list[list[int]], folds: int, width: int, depth: int = 3) -> np.ndarray:
    """For each list of features the samples of ``rows`` (see ``binned``) that trees of them tell right, each from a tree that has not seen its fold."""
    size = 2 ** (depth - 1) * len(tried[0]) * BINS * 4 * 8 * folds
    each = max(1, BYTES // size)
    return np.concatenate([_right_told(rows, tried[i : i + each], folds, width, depth) for i in range(0, len(tried), each)])


def _right_told(rows: DataFrame, tried: list[list[int]], folds: int, width: int, depth: int) -> np.ndarray:
    models, q = [(i, features) for features in tried for i in range(folds)], len(tried[0])
    splits: list[dict[int, tuple[int, int]]] = [{} for _ in models]  # by node, numbered from 1 level by level
    right = np.zeros(len(models), "i8")
    for level in range(depth):
        nodes = 1 << level

        def add(batches, level=level, nodes=nodes):
            total = np.zeros((len(models), nodes * q * BINS * 4), "i8")
            for batch in batches:
                bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), "u1").reshape(-1, folds, width)
                label = batch.column("label").to_numpy(zero_copy_only=False).astype("i8")
                f = batch.column("f").to_numpy(zero_copy_only=False)  # nulls are NaN
                side = [2 * (f == i) + label for i in range(folds)]
                known = ~np.isnan(f.astype(float))
                for m, (i, features) in enumerate(models):
                    at, node = bins[:, i, features], np.ones(len(label), "i8")
                    for above in range(level):
                        new = np.zeros(len(label), "i8")
                        for k in range(1 << above, 2 << above):
                            if k in splits[m]:
                                s, t = splits[m][k]
                                here = node == k
                                new[here] = 2 * k + (at[here, s] > t)
                        node = new
                    live = known & (node > 0)
                    base = (node[live] - nodes) * (q * BINS * 4) + side[i][live]
                    for s in range(q):
                        total[m] += np.bincount(base + (s * BINS + at[live, s].astype("i8")) * 4, minlength=total.shape[1])
            yield batch_of(total)

        for m, sums in summed(rows, add).items():
            counts = sums.astype("i8").reshape(nodes, q, BINS, 2, 2)  # node, feature, bin, training or held out, class
            for k in range(nodes):
                if level and (nodes + k) // 2 not in splits[m]:
                    continue
                train, held = counts[k, :, :, 0], counts[k, :, :, 1]
                split = best_split(train)
                if split is None:
                    parts = [slice(None)]
                elif level == depth - 1:
                    parts = [slice(None, split[1] + 1), slice(split[1] + 1, None)]
                else:
                    splits[m][nodes + k] = split
                    continue
                s = split[0] if split else 0
                right[m] += sum(held[s, p].sum(axis=0)[int(train[s, p].sum(axis=0).argmax())] for p in parts)
    return right.reshape(-1, folds).sum(axis=1)
