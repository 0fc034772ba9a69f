"""Supervised discretisation by minimum description length, and selectors on its bins.

``mdl_cuts`` splits each feature where the class entropy falls most, as long as that pays for the description of the cut (Fayyad and Irani's criterion). All features and intervals of a level are searched in one aggregation: running class counts by distinct value are worked out once, and a cut's left and right counts in any interval are differences of them. Selectors hold a row a feature on the driver, and of pairs only those with a feature that a search has picked.

Defined cases: null values are left out; a feature with one class or one value has no cut; of equally good cuts the lowest is taken; a sample that repeats a feature counts with each value for cuts and with its smallest for pairs. Empty tables have no cuts and select nothing.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.operators import evaluation, expression, ranks
from helixmill.sources import stores


def _entropy(a: Column, b: Column) -> Column:
    n = (a + b).cast("double")
    part = lambda x: F.when(x > 0, -x / n * F.log2(x / n)).otherwise(0.0)
    return F.when(n > 0, part(a) + part(b)).otherwise(0.0)


def _kinds(a: Column, b: Column) -> Column:
    return (a > 0).cast("int") + (b > 0).cast("int")


def class_prefixes(long: DataFrame) -> DataFrame:
    """(feature, value, next, c1, c0) of each distinct value: the next greater one, and how many cases and controls have at most this one."""
    counts = long.where("value is not null").groupBy("feature", "value").agg(F.count_if(F.col("class") == expression.CASE).alias("n1"), F.count_if(F.col("class") != expression.CASE).alias("n0"))
    dealt = ranks.in_buckets(counts, ("feature",), "value")
    summed = ranks.running(dealt, ("feature",), [F.col("value")], c1=F.col("n1"), c0=F.col("n0"))
    firsts = dealt.groupBy("feature", "_b").agg(F.min("value").alias("_first"))
    after = firsts.select("feature", "_b", F.lead("_first").over(Window.partitionBy("feature").orderBy("_b")).alias("_after"))  # a row a feature and bucket
    within = F.lead("value").over(Window.partitionBy("feature", "_b").orderBy("value"))
    return summed.join(after, ["feature", "_b"]).select("feature", "value", F.coalesce(within, "_after").alias("next"), "c1", "c0")


def mdl_cuts(long: DataFrame) -> DataFrame:
    """(feature, cut, level): cuts half-way between neighbouring values, and the level of the recursion that made them. One job a level; what a level made is a written table."""
    spark = long.sparkSession
    path, found = stores.new_folder(spark, "mdl-prefixes"), stores.new_folder(spark, "mdl-cuts")
    kind = long.schema["feature"].dataType.simpleString()
    at = stores.written(class_prefixes(long), path)
    whole = at.groupBy("feature").agg(F.max("c1").alias("e1"), F.max("c0").alias("e0"))
    open_ = whole.select("feature", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(0).cast("bigint").alias("s1"), F.lit(0).cast("bigint").alias("s0"), "e1", "e0")
    level = 0
    while True:
        new = stores.written(_split(at, open_).withColumn("level", F.lit(level)), f"{found}/{level}")
        if new.isEmpty():
            break
        left = new.select("feature", "lo", F.col("value").alias("hi"), "s1", "s0", F.col("c1").alias("e1"), F.col("c0").alias("e0"))
        right = new.select("feature", F.col("value").alias("lo"), "hi", F.col("c1").alias("s1"), F.col("c0").alias("s0"), "e1", "e0")
        open_, level = left.unionByName(right), level + 1
    stores.remove(spark, path)
    return spark.read.schema(f"feature {kind}, cut double, level int").parquet(*[f"{found}/{i}" for i in range(level + 1)])


def _split(at: DataFrame, open_: DataFrame) -> DataFrame:
    """The accepted cut of each open interval (feature, lo, hi, and class counts up to its start and its end)."""
    open_ = open_.where("e1 > s1 and e0 > s0")
    inside = at.join(open_, "feature").where("value > lo and value < hi and next is not null and c1 + c0 < e1 + e0")
    l1, l0, r1, r0 = F.col("c1") - F.col("s1"), F.col("c0") - F.col("s0"), F.col("e1") - F.col("c1"), F.col("e0") - F.col("c0")
    n = (F.col("e1") + F.col("e0") - F.col("s1") - F.col("s0")).cast("double")
    after = ((l1 + l0) * _entropy(l1, l0) + (r1 + r0) * _entropy(r1, r0)) / n
    held = F.struct("value", "next", "c1", "c0")
    best = inside.groupBy("feature", "lo", "hi", "s1", "s0", "e1", "e0").agg(F.min_by(held, F.struct(F.round(after, 12).alias("h"), "value")).alias("b")).select("feature", "lo", "hi", "s1", "s0", "e1", "e0", "b.*")
    a1, a0 = F.col("e1") - F.col("s1"), F.col("e0") - F.col("s0")
    whole, left, right = _entropy(a1, a0), _entropy(l1, l0), _entropy(r1, r0)
    k = _kinds(a1, a0)
    cost = F.log2(F.pow(F.lit(3.0), k) - 2) - (k * whole - _kinds(l1, l0) * left - _kinds(r1, r0) * right)
    pays = whole - after > (F.log2(n - 1) + cost) / n
    return best.where(pays).withColumn("cut", (F.col("value") + F.col("next")) / 2)


def binned(long: DataFrame, cuts: DataFrame) -> DataFrame:
    """``long`` with the bin of each value that is not null: the number of the feature's cuts below it. Features without a cut go."""
    of = cuts.groupBy("feature").agg(F.array_sort(F.collect_list("cut")).alias("_cuts"))
    return long.where("value is not null").join(of, "feature").withColumn("bin", F.size(F.filter("_cuts", lambda c: c < F.col("value")))).drop("_cuts")


def su_mdl(long: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """(feature, su, gain): symmetrical uncertainty of the class and the feature's bins; features without a cut have none, and so 0."""
    cells = binned(long, mdl_cuts(long) if cuts is None else cuts).groupBy("feature", "bin", "class").agg(F.count("*").alias("n"))
    every = long.select("feature").distinct().join(evaluation.uncertainty(cells), "feature", "left")
    return every.select("feature", F.coalesce("su", F.lit(0.0)).alias("su"), F.coalesce("gain", F.lit(0.0)).alias("gain"))


def su_pairs(long: DataFrame, cuts: DataFrame) -> DataFrame:
    """(feature_a, feature_b, su) of every two features with cuts, over the samples that have both, from their bins' contingency counts: matrix products of bin indicators."""
    once = binned(long.groupBy("sample_id", "feature").agg(F.min("value").alias("value")), cuts)
    cell = F.concat(F.col("feature"), F.lit("\x1f"), F.col("bin").cast("string"))
    g = expression.gram(once.select("sample_id", cell.alias("feature"), F.lit(1.0).alias("value")))
    side = lambda c: F.substring_index(c, "\x1f", 1)
    cells = g.select(side(F.col("feature_a")).alias("a"), F.col("feature_a").alias("bin_a"), side(F.col("feature_b")).alias("b"), F.col("feature_b").alias("bin_b"), "n").where("a <> b")
    turned = F.col("a") > F.col("b")
    cells = cells.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("feature_a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("feature_b"), F.when(turned, F.col("bin_b")).otherwise(F.col("bin_a")).alias("bin"), F.when(turned, F.col("bin_a")).otherwise(F.col("bin_b")).alias("class"), "n")
    return evaluation.uncertainty(cells, ("feature_a", "feature_b")).select("feature_a", "feature_b", "su")


class _Merits:
    """Merits of feature sets: k r_cf / sqrt(k + k (k - 1) r_ff). Uncertainties between features are read for one picked feature at a time."""

    def __init__(self, long: DataFrame):
        self.spark = long.sparkSession
        cuts = mdl_cuts(long)
        self.su = {r.feature: r.su for r in su_mdl(long, cuts).where("su > 0").collect()}  # a row a feature
        self.names = sorted(self.su)
        self.path = stores.new_folder(self.spark, "su-pairs")
        self.pairs = stores.written(su_pairs(long, cuts), self.path)
        self.rows: dict[str, dict[str, float]] = {}

    def row(self, feature: str) -> dict[str, float]:
        if feature not in self.rows:
            other = F.when(F.col("feature_a") == feature, F.col("feature_b")).otherwise(F.col("feature_a"))
            self.rows[feature] = {r.other: r.su for r in self.pairs.where((F.col("feature_a") == feature) | (F.col("feature_b") == feature)).select(other.alias("other"), "su").collect()}
        return self.rows[feature]

    def of(self, to_class: float, within: float, k: int) -> float:
        return round(to_class / (k + 2 * within) ** 0.5, 12)

    def grown(self, chosen: tuple[str, ...]) -> list[tuple[float, str]]:
        """(merit, feature) of the set with each further feature."""
        rows = [self.row(f) for f in chosen]
        base = sum(self.su[f] for f in chosen)
        inner = sum(rows[j].get(f, 0.0) for i, f in enumerate(chosen) for j in range(i))
        return [(self.of(base + self.su[f], inner + sum(r.get(f, 0.0) for r in rows), len(chosen) + 1), f) for f in self.names if f not in chosen]

    def close(self) -> None:
        stores.remove(self.spark, self.path)


def best_first_cfs(long: DataFrame, patience: int = 5) -> DataFrame:
    """(feature, su, merit): the feature set of largest merit that a best-first search finds, which expands the best open set and ends after ``patience`` expansions in a row without a better one. Ties go to names. Features without a cut are never chosen."""
    m = _Merits(long)
    best, open_, seen, stale = (0.0, ()), [(-0.0, ())], {()}, 0
    while open_ and stale < patience:
        _, chosen = heapq.heappop(open_)
        better = False
        for merit, f in m.grown(chosen):
            new = tuple(sorted((*chosen, f)))
            if new not in seen:
                seen.add(new)
                heapq.heappush(open_, (-merit, new))
                if merit > best[0]:
                    best, better = (merit, new), True
        stale = 0 if better else stale + 1
    m.close()
    return long.sparkSession.createDataFrame([(f, m.su[f], best[0]) for f in best[1]], "feature string, su double, merit double")


def forward_cfs_mdl(long: DataFrame, k: int | None = None) -> DataFrame:
    """(rank, feature, merit): features added one by one while the merit grows, at most ``k``; ties go to the smaller name."""
    m, chosen, rows = _Merits(long), (), []
    while (k is None or len(chosen) < k) and (options := m.grown(chosen)):
        merit, f = min((-merit, f) for merit, f in options)
        if rows and -merit <= rows[-1][2]:
            break
        chosen = (*chosen, f)
        rows.append((len(chosen), f, -merit))
    m.close()
    return long.sparkSession.createDataFrame(rows, "rank int, feature string, merit double")


def auc_mdl(long: DataFrame, k: int = 11, cuts: DataFrame | None = None) -> DataFrame:
    """(feature, rank, auc): the ``k`` features of largest AUC of their bins against the class; features without a cut come last, at 0.5."""
    told = binned(long, mdl_cuts(long) if cuts is None else cuts).select("feature", F.col("bin").alias("score"), (F.col("class") == expression.CASE).cast("int").alias("label"))
    every = long.select("feature").distinct().join(evaluation.auc(told).select("feature", "auc"), "feature", "left").select("feature", F.coalesce("auc", F.lit(0.5)).alias("auc"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.round("auc", 12)), "feature"))  # a row a feature
    return every.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
