"""Smaller table operations: stacking, barcodes, probe checks, partial names, breaks, distances, pairwise discriminants, and resumable grids.

Nulls: a barcode or symbol that is null gives null parts and is no tumour sample; features without a value in a class have no discriminant. Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.operators import expression


def stack(*tables: DataFrame) -> DataFrame:
    """All rows, by column name; a table without a column has nulls there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def barcode_parts(barcode: Column) -> list[Column]:
    """participant (the first twelve characters), sample_type (number) and tumour (types below 10) of a dashed barcode."""
    kind = F.substring(F.get(F.split(barcode, "-"), F.lit(3)), 1, 2).try_cast("int")
    return [F.substring(barcode, 1, 12).alias("participant"), kind.alias("sample_type"), F.coalesce(kind < 10, F.lit(False)).alias("tumour")]


def known_symbols(table: DataFrame, gene: str) -> DataFrame:
    """``table`` with ``symbol`` and ``gene_id``, the parts of "symbol|id"; rows whose symbol is "?" go."""
    parts = F.split(gene, r"\|")
    return table.withColumns({"symbol": parts[0], "gene_id": F.get(parts, F.lit(1))}).where("symbol <> '?'")


def agreeing_probes(table: DataFrame, file: str, probe: str, value: str) -> DataFrame:
    """Per file and probe that occurs more than once: its rows, and whether all hold the same value (nulls count as one value)."""
    same = F.count_distinct(F.coalesce(F.col(value).cast("string"), F.lit("null"))) == 1
    return table.groupBy(file, probe).agg(F.count("*").alias("n"), same.alias("agree")).where("n > 1")


def without_partial(features: DataFrame, patterns: list[str]) -> DataFrame:
    """Features but those that a pattern names: in full, or as the only feature that begins with it. ``patterns`` is a caller's short list."""
    hits = features.select("feature").distinct().withColumn("pattern", F.explode(F.filter(F.array(*map(F.lit, patterns)), lambda p: F.col("feature").startswith(p))))
    n = F.count("*").over(Window.partitionBy("pattern"))
    named = hits.withColumn("n", n).where("n = 1 or feature = pattern").select("feature").distinct()
    return features.join(named, "feature", "left_anti")


def membership(signatures: DataFrame, features: list[str]) -> DataFrame:
    """(method, has_any, has_all): whether a signature holds some or all of ``features``."""
    of = signatures.groupBy("method").agg(F.count_distinct(F.when(F.col("feature").isin(features), F.col("feature"))).alias("n"))
    return of.select("method", (F.col("n") > 0).alias("has_any"), (F.col("n") == len(set(features))).alias("has_all"))


def diverging_breaks(long: DataFrame, centre: float = 0.0, bins: int = 50) -> DataFrame:
    """(feature, i, at): ``bins`` equal steps from the smallest value to ``centre`` and as many on to the largest."""
    ends = long.groupBy("feature").agg(F.least(F.min("value"), F.lit(centre)).alias("lo"), F.greatest(F.max("value"), F.lit(centre)).alias("hi"))
    steps = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(2 * bins))).alias("i"))
    low, high = F.col("lo") + (centre - F.col("lo")) * F.col("i") / bins, centre + (F.col("hi") - centre) * (F.col("i") - bins) / bins
    return steps.select("feature", "i", F.when(F.col("i") <= bins, low).otherwise(high).alias("at"))


def distances(long: DataFrame) -> DataFrame:
    """(feature_a, feature_b, distance): Euclidean, over samples that have both."""
    mean = lambda x: expression.means(long).select(F.col("feature").alias(f"feature_{x}"), F.col("_mean").alias(f"m{x}"))
    apart = F.col("ma") - F.col("mb")
    square = F.col("saa") - 2 * F.col("sab") + F.col("sbb") + 2 * apart * (F.col("sa") - F.col("sb")) + F.col("n") * apart * apart
    return expression.gram(long).join(mean("a"), "feature_a").join(mean("b"), "feature_b").select("feature_a", "feature_b", F.sqrt(F.greatest(square, F.lit(0.0))).alias("distance"))


def fisher_pairs(long: DataFrame) -> DataFrame:
    """(feature_a, feature_b, criterion): Fisher's criterion of the linear discriminant of two features, d' S^-1 d with the pooled covariance S, from sums alone. Null where S cannot be inverted."""
    side = F.when(F.col("class") == "Case", "k").otherwise("o")
    g = expression.gram(long.withColumn("side", side), "side")
    centred = lambda p, x, y: F.col(p) - F.col(x) * F.col(y) / F.col("n")
    g = g.select("side", "feature_a", "feature_b", "n", (F.col("sa") / F.col("n")).alias("mx"), (F.col("sb") / F.col("n")).alias("my"), centred("saa", "sa", "sa").alias("vx"), centred("sbb", "sb", "sb").alias("vy"), centred("sab", "sa", "sb").alias("c"))
    got = g.groupBy("feature_a", "feature_b").pivot("side", ["k", "o"]).agg(*[F.first(x).alias(x) for x in ("n", "mx", "my", "vx", "vy", "c")])
    pool = lambda x: F.try_divide(F.col(f"k_{x}") + F.col(f"o_{x}"), F.col("k_n") + F.col("o_n") - 2)
    got = got.select("feature_a", "feature_b", (F.col("k_mx") - F.col("o_mx")).alias("dx"), (F.col("k_my") - F.col("o_my")).alias("dy"), pool("vx").alias("a"), pool("vy").alias("b"), pool("c").alias("c"))
    top = F.col("dx") ** 2 * F.col("b") - 2 * F.col("dx") * F.col("dy") * F.col("c") + F.col("dy") ** 2 * F.col("a")
    return got.select("feature_a", "feature_b", F.try_divide(top, F.col("a") * F.col("b") - F.col("c") ** 2).alias("criterion"))


def wx_scores(long: DataFrame, weights: DataFrame) -> DataFrame:
    """(feature, score): the sum over ordered pairs of classes of |m w - m w'|, with m a class's mean of the feature, w its weight for it and w' the other class's. ``weights`` is (class, feature, weight)."""
    means = long.groupBy("class", "feature").agg(F.avg("value").alias("m")).join(weights, ["class", "feature"])
    other = weights.select("feature", F.col("class").alias("other"), F.col("weight").alias("w"))
    return means.join(other, "feature").where("class <> other").groupBy("feature").agg(F.sum(F.abs(F.col("m") * (F.col("weight") - F.col("w")))).alias("score"))


def correlated_with_class(long: DataFrame, least: float = 0.2) -> DataFrame:
    """(feature, r): features whose correlation with the class has an absolute value of at least ``least``."""
    return long.groupBy("feature").agg(F.corr("value", (F.col("class") == "Case").cast("double")).alias("r")).where(F.abs("r") >= least)


def ensemble_weights(runs: DataFrame, by: str, weight: str) -> DataFrame:
    """Mean weight over runs, with one run without weight added, so that rare features come lower."""
    return runs.groupBy(by).agg((F.sum(weight).cast("double") / (1 + F.count(weight))).alias("weight"))


def unfinished(grid: DataFrame, done: DataFrame, key: str, batch: int = 250) -> DataFrame:
    """The grid's rows that are not done, with the batch that each is in (ids from 1)."""
    return grid.join(done.select(key).distinct(), key, "left_anti").withColumn("batch", F.floor((F.col(key) - 1) / batch).cast("bigint"))


def worth_saving(board: DataFrame, train: float = 0.85, test: float = 0.8, k: int = 1000) -> DataFrame:
    """The ``k`` rows of largest meta-index among those above both thresholds."""
    rank = F.row_number().over(Window.orderBy(F.desc(F.round("metaindex", 10)), "method", "algorithm"))  # a row a model
    return board.where((F.col("train") > train) & (F.col("test") > test)).withColumn("rank", rank).where(F.col("rank") <= k)
