"""Predicates, lookups and small selections over input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.operators import ranks


def label_set_is(table: DataFrame, labels: tuple[str, ...], by: tuple[str, ...], label: str = "class") -> DataFrame:
    """Per group: are its labels (nulls aside) just ``labels``?"""
    seen = F.array_sort(F.collect_set(label))  # as many as there are labels
    return table.groupBy(*by).agg((seen == F.array_sort(F.array(*[F.lit(x) for x in labels]))).alias("equal"))


def same_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many keys are in both, in ``a`` alone and in ``b`` alone, and whether the sets are equal. Null keys are no members."""
    both = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full").where(F.col(key).isNotNull())
    n = both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"), F.count_if(F.col("b").isNull()).alias("n_a"), F.count_if(F.col("a").isNull()).alias("n_b"))
    return n.withColumn("equal", (F.col("n_a") == 0) & (F.col("n_b") == 0))


def cohort(table: DataFrame, equal: dict[str, str], like: dict[str, str] | None = None) -> DataFrame:
    """Rows with the given values, and whose columns match the given regular expressions."""
    for name, value in equal.items():
        table = table.where(F.col(name) == value)
    for name, pattern in (like or {}).items():
        table = table.where(F.col(name).rlike(pattern))
    return table


def by_size(files: DataFrame, size: str, least: int) -> DataFrame:
    """``platform`` of each file: old below ``least`` bytes, else new; null without a size."""
    return files.withColumn("platform", F.when(F.col(size) < least, "old").when(F.col(size) >= least, "new"))


def newest_archive(files: DataFrame, name: str, archive: str) -> DataFrame:
    """The newest archive of each file name, by the three numbers in its last five to third dot-separated parts (``x.1.10.0.tar.gz``: 1, 10, 0); ties to the greater archive name. Archives without such numbers come before all others."""
    parts = F.split(archive, r"\.")
    version = F.struct(*[F.coalesce(F.try_element_at(parts, F.lit(-i)).try_cast("int"), F.lit(-1)) for i in (5, 4, 3)], F.col(archive))
    return files.groupBy(name).agg(F.max_by(archive, version).alias(archive))  # aggregated map-side: no window over a file's versions


def cut_metadata(table: DataFrame, pattern: str = r"\.1\.") -> DataFrame:
    """Rows in which every column whose name matches is null, without these columns; the whole table if no name matches."""
    import re

    cut = [c for c in table.columns if re.search(pattern, c)]
    rest = [F.col(f"`{c}`") for c in table.columns if c not in cut]
    return table.where(F.coalesce(*[F.col(f"`{c}`").cast("string") for c in cut]).isNull()).select(rest) if cut else table


def dashes(name: Column) -> Column:
    """Names with dashes for the dots that syntactic names have."""
    return F.regexp_replace(name, r"\.", "-")


def first_name(name: Column) -> Column:
    """The first of several names joined by commas."""
    return F.split(name, ",")[0]


def without_summaries(table: DataFrame, name: str, rows: tuple[str, ...] = ("Mean", "Median", "StdDev", "Total"), columns: tuple[str, ...] = ()) -> DataFrame:
    """``table`` without summary rows and the given columns; rows with a null name stay."""
    return table.where(F.coalesce(~F.col(name).isin(*rows), F.lit(True))).drop(*columns)


def preview(table: DataFrame, rows: int, columns: int, order: str) -> DataFrame:
    """The first rows (by ``order``) and columns."""
    return table.orderBy(order).limit(rows).select(*[F.col(f"`{c}`") for c in table.columns[:columns]])


def with_suffix(table: DataFrame, suffix: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys`` and the columns whose names end in ``suffix``, which is cut off."""
    return table.select(*keys, *[F.col(f"`{c}`").alias(c[: -len(suffix)]) for c in table.columns if c.endswith(suffix) and c not in keys])


def named(table: DataFrame, names: list[str]) -> DataFrame:
    """The named columns in order; an error names those that are missing."""
    if missing := [x for x in names if x not in table.columns]:
        raise ValueError(f"columns that are missing: {missing}")
    return table.select(*[F.col(f"`{x}`") for x in names])


def whitelisted(long: DataFrame, features: DataFrame) -> DataFrame:
    """Rows of the features in a list (a table with column ``feature``)."""
    return long.join(features.select("feature").distinct(), "feature", "left_semi")


def with_clinical(counts: DataFrame, clinical: DataFrame, key: str) -> DataFrame:
    """All rows of counts, with what clinical has for their key (null where it has none). A key that clinical repeats repeats the row."""
    return counts.join(clinical, key, "left")


def scale_bounds(samples: DataFrame, class_col: str = "class") -> DataFrame:
    """One row (ratio, low, high): bounds of the weight of positive samples, from the ratio of Control to Case: 0 to twice the ratio if that is over 1, else half of it to 5. Null without a Case."""
    n = samples.agg(F.count_if(F.col(class_col) == "Case").alias("n1"), F.count_if(F.col(class_col) == "Control").alias("n0"))
    ratio = F.try_divide(F.col("n0").cast("double"), F.col("n1"))
    return n.select(ratio.alias("ratio")).select("ratio", F.when(F.col("ratio") > 1, 0.0).otherwise(F.col("ratio") * 0.5).alias("low"), F.when(F.col("ratio") > 1, F.col("ratio") * 2).otherwise(F.when(F.col("ratio").isNotNull(), 5.0)).alias("high"))


def parse_formulas(formulas: DataFrame) -> DataFrame:
    """(method, response, position, feature) of formulas ``response ~ a + b``; back-quotes are taken off, empty terms dropped, a repeated feature is taken at its first place."""
    side = F.split("formula", "~", 2)
    terms = F.array_distinct(F.filter(F.transform(F.split(side[1], r"\+"), lambda x: F.trim(F.regexp_replace(x, "`", ""))), lambda x: x != ""))
    return formulas.select("method", F.trim(side[0]).alias("response"), F.posexplode(terms).alias("position", "feature"))


def combination_key(features: Column) -> Column:
    """The same hash for the same set of features in any order."""
    return F.md5(F.array_join(F.array_sort(F.array_distinct(features)), "|"))


def unvisited(combinations: DataFrame, visited: DataFrame, features: str) -> DataFrame:
    """Combinations (arrays of features) whose set is in no row of ``visited``, each set once."""
    key = combination_key(F.col(features))
    return combinations.withColumn("_k", key).dropDuplicates(["_k"]).join(visited.select(key.alias("_k")).distinct(), "_k", "left_anti").drop("_k")


def validation_share(samples: DataFrame, share: float, seed: int = 1, buckets: int = 256) -> DataFrame:
    """(sample_id, class, part): of each class the first int(n * share) samples in order of a seeded hash are valid, the others train.

    Ranks are those in hash buckets plus a prefix sum over buckets, so that no class is one task's.
    """
    h = F.md5(F.concat_ws("|", F.lit(seed), "sample_id"))
    keyed = samples.select("sample_id", "class", h.alias("_h")).withColumn("_b", F.conv(F.substring("_h", 1, 2), 16, 10).cast("int") % buckets)
    sizes = keyed.groupBy("class", "_b").agg(F.count("*").alias("_n"))
    over = Window.partitionBy("class").orderBy("_b")
    bases = sizes.select("class", "_b", (F.sum("_n").over(over) - F.col("_n")).alias("_base"), F.sum("_n").over(Window.partitionBy("class")).alias("_all"))  # a row a class and bucket
    rank = F.row_number().over(Window.partitionBy("class", "_b").orderBy("_h", "sample_id"))
    placed = keyed.withColumn("_r", rank).join(bases, ["class", "_b"])
    return placed.select("sample_id", "class", F.when(F.col("_r") + F.col("_base") <= F.floor(F.col("_all") * share), "valid").otherwise("train").alias("part"))


def top_features(scores: DataFrame, score: str, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(feature, rank, score) of the k best of each group, ties to the smaller name."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), "feature"))
    return scores.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select(*by, "rank", "feature", score)


def only_selected(scores: DataFrame, selected: DataFrame) -> DataFrame:
    """Scores of the features that an earlier selection holds, for the variants of selectors that start from one. Repeated features of the selection count once, null features never; an empty selection leaves no row."""
    return scores.join(selected.select("feature"), "feature", "left_semi")


def all_features(long: DataFrame) -> DataFrame:
    """Every feature, ranked by name: the selection that selects nothing away."""
    return long.select("feature").distinct().withColumn("rank", F.row_number().over(Window.orderBy("feature")).cast("int"))  # a row a feature


def without_redundant(features: DataFrame, correlations: DataFrame, cutoff: float = 0.75) -> DataFrame:
    """Features that stay when, of every two with \\|r\\| over ``cutoff``, the one of larger mean \\|r\\| over all pairs (ties: the greater name) goes."""
    two = correlations.select("feature_a", "feature_b", F.abs("r").alias("r"))
    mean = two.select(F.explode(F.array("feature_a", "feature_b")).alias("feature"), "r").groupBy("feature").agg(F.round(F.avg("r"), 10).alias("mean"))
    side = lambda x: mean.select(F.col("feature").alias(f"feature_{x}"), F.col("mean").alias(f"mean_{x}"))
    close = two.where(F.col("r") > cutoff).join(side("a"), "feature_a").join(side("b"), "feature_b")
    out = F.when(F.struct("mean_a", "feature_a") > F.struct("mean_b", "feature_b"), F.col("feature_a")).otherwise(F.col("feature_b"))
    return features.select("feature").distinct().join(close.select(out.alias("feature")).distinct(), "feature", "left_anti")


def trimmed_means(long: DataFrame, trim: float = 0.1) -> DataFrame:
    """(feature, trimmed): the mean without the floor(n * trim) smallest and largest values. Equal values are one row with their number, and running numbers are taken in buckets cut by quantiles, so neither an outlier nor a repeated value makes a feature one task's."""
    each = long.where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("_n"))
    upto = ranks.running(ranks.in_buckets(each, ("feature",), "value"), ("feature",), [F.col("value")], _upto=F.col("_n"))
    cut = F.floor(F.col("_upto_all") * trim)
    kept = F.greatest(F.least(F.col("_upto"), F.col("_upto_all") - cut) - F.greatest(F.col("_upto") - F.col("_n"), cut), F.lit(0))
    return upto.groupBy("feature").agg(F.try_divide(F.sum(F.col("value") * kept), F.sum(kept)).alias("trimmed"))


def complete(long: DataFrame, most: int = 0) -> DataFrame:
    """(sample_id, n_features) of samples with at most ``most`` missing values."""
    return long.groupBy("sample_id").agg(F.count("*").alias("n_features"), F.count_if(F.col("value").isNull()).alias("_m")).where(F.col("_m") <= most).drop("_m")


def fill_mode(table: DataFrame, column: str) -> DataFrame:
    """``table`` with the column's most frequent value for nulls, ties to the smaller value; all null stays null."""
    counts = table.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    mode = counts.agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column)))).first()[0]  # one value
    return table if mode is None else table.withColumn(column, F.coalesce(column, F.lit(mode)))
