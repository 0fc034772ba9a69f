"""Differential expression, normalisation and feature filters over the long layout. Each is one shuffle on the feature (or sample) with map-side aggregation."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions import stats
from helixmill.operators import ranks

CASE, CONTROL = "Case", "Control"


def moments(long: DataFrame) -> DataFrame:
    """n, mean, var by class, and overall, Case and Control descriptives of every feature; medians are exact, by ranks in buckets."""
    case, control = F.col("class") == CASE, F.col("class") == CONTROL
    v, v1, v0 = F.col("value"), F.when(case, F.col("value")), F.when(control, F.col("value"))
    middle = ranks.medians(long, ("feature",), median=v, median1=v1, median0=v0)
    found = long.groupBy("feature").agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.avg(v1).alias("mean1"), F.stddev_samp(v1).alias("sd1"), F.var_samp(v1).alias("var1"), F.count(v1).alias("n1"),
        F.avg(v0).alias("mean0"), F.stddev_samp(v0).alias("sd0"), F.var_samp(v0).alias("var0"), F.count(v0).alias("n0"),
    )
    return found.join(middle, "feature", "left")


def differential_expression(long: DataFrame, mode: str = "logtpm") -> DataFrame:
    """Welch's test and fold changes of Case over Control; mode "logtpm" (log10 values) or "deltact" (cycles)."""
    found = stats.adjust(stats.welch(moments(long)))
    diff = F.col("mean1") - F.col("mean0")
    log10fc = diff if mode == "logtpm" else F.log10(F.pow(F.lit(2.0), diff))
    log2fc = diff / math.log10(2) if mode == "logtpm" else diff
    return found.withColumn("log10fc", log10fc).withColumn("log2fc", log2fc).withColumn("reversed_log10fc", -log10fc).withColumn("reversed_log2fc", -log2fc)


def significant(de: DataFrame, p_col: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Features with p at most alpha; all of them where none is significant."""
    any_ = F.max((F.col(p_col) <= alpha).cast("int")).over(Window.partitionBy())
    return de.withColumn("_any", any_).where((F.col("_any") == 0) | (F.col(p_col) <= alpha)).drop("_any")


def top(de: DataFrame, method: str, key, k: int) -> DataFrame:
    """(method, rank, feature) of the k first by ``key``, ties by BH and name."""
    order = Window.orderBy(key, "p_bh", "feature")
    return de.select(F.lit(method).alias("method"), F.row_number().over(order).alias("rank"), "feature").where(F.col("rank") <= k)


def signatures(de: DataFrame, k: int = 11) -> DataFrame:
    """The signatures of the differential-expression slot: sig, fcsig and the top-k lists."""
    sig = significant(de)
    listed = lambda df, name: df.select(F.lit(name).alias("method"), F.row_number().over(Window.orderBy("p_bh", "feature")).alias("rank"), "feature")
    parts = [listed(sig, "sig"), listed(sig.where(F.abs("log2fc") > 1), "fcsig"), top(de, "sigtop", F.col("p_value"), k), top(de, "sigtopBonf", F.col("p_bonferroni"), k), top(de, "sigtopHolm", F.col("p_holm"), k), top(de, "topFC", -F.abs("log2fc"), k)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def log10_tpm(counts: DataFrame, increment: float = 0.001) -> DataFrame:
    """Counts per million of a sample's library, log10 with an increment; with the raw value."""
    library = F.sum("value").over(Window.partitionBy("sample_id"))
    return counts.withColumn("cpm", F.col("value") / library * 1e6).withColumn("log10tpm", F.log10(F.col("cpm") + increment))


def expressed(counts: DataFrame, least: float = 10, share: float = 0.5) -> DataFrame:
    """Features of which at most ``share`` of the samples have fewer than ``least`` counts."""
    return counts.groupBy("feature").agg(F.count_if(F.col("value") < least).alias("low"), F.count("*").alias("n")).where(F.col("low") <= share * F.col("n")).select("feature")


def varying(long: DataFrame, split_col: str) -> DataFrame:
    """Features that vary in every split."""
    by = long.groupBy("feature", split_col).agg(F.var_samp("value").alias("v"))
    return by.groupBy("feature").agg(F.count_if(F.coalesce("v", F.lit(0.0)) == 0).alias("flat")).where("flat = 0").select("feature")


def missing_audit(long: DataFrame) -> DataFrame:
    counts = long.groupBy("feature").agg(F.count_if(F.col("value").isNull()).alias("n_missing"), F.count("*").alias("n"), F.avg("value").alias("mean"))
    return counts.join(ranks.medians(long, ("feature",), median=F.col("value")), "feature", "left").select("feature", "n_missing", "n", "median", "mean")


def impute(long: DataFrame, how: str = "median", share: float = 0.1) -> DataFrame:
    """Drop features of which a ``share`` or more is missing, fill the rest with their exact median or mean. The audit is a row a feature: Spark chooses how to join it."""
    audit = missing_audit(long).where(F.col("n_missing") < share * F.col("n")).select("feature", F.col(how).alias("_fill"))
    return long.join(audit, "feature").select(*[F.coalesce("value", "_fill").alias("value") if c == "value" else c for c in long.columns])


def z_scores(long: DataFrame) -> DataFrame:
    """Values scaled by their feature's mean and standard deviation; 0 where that is 0 or null."""
    m = long.groupBy("feature").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    return long.join(m, "feature").select("sample_id", "class", "feature", F.when(F.col("_s") > 0, (F.col("value") - F.col("_m")) / F.col("_s")).otherwise(0.0).alias("value"))


def like_counts(long: DataFrame) -> DataFrame:
    """Per feature: are all values whole and not negative?"""
    whole = (F.col("value") % 1 == 0) & (F.col("value") >= 0)
    return long.groupBy("feature").agg(F.min(whole.cast("int")).alias("counts_like"))


def describe(long: DataFrame) -> DataFrame:
    """Descriptives by feature: n, mean, sd, median, mad, min, max, range, skew, kurtosis, se."""
    v = F.col("value")
    mid = ranks.medians(long, ("feature",), median=v)
    apart = ranks.medians(long.join(mid, "feature"), ("feature",), mad=F.abs(v - F.col("median"))).withColumn("mad", F.col("mad") * 1.4826)
    out = long.groupBy("feature").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"), F.skewness(v).alias("_g1"), F.kurtosis(v).alias("_g2")).join(mid, "feature", "left").join(apart, "feature", "left")
    sd, share = F.col("sd"), (F.col("n") - 1) / F.col("n")  # by the sample's deviation, not the population's
    skew, kurtosis = F.col("_g1") * F.pow(share, F.lit(1.5)), (F.col("_g2") + 3) * share * share - 3
    return out.select("feature", "n", "mean", "sd", "median", "mad", "min", "max", (F.col("max") - F.col("min")).alias("range"), skew.alias("skew"), kurtosis.alias("kurtosis"), (sd / F.sqrt("n")).alias("se"))


def stratified_split(samples: DataFrame, train: float = 0.6, seed: int = 1) -> DataFrame:
    """Samples (sample_id, class) with mix: per class the first ceil(train * n) in hash order train, half of the rest (rounded up) test, the others valid. Ranks are those in 256 hash buckets a class plus a running sum over buckets, so that no class is one task's."""
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col("sample_id").cast("string")))
    keyed = samples.withColumn("_h", F.substring(h, 1, 7)).withColumn("_b", F.conv(F.substring("_h", 1, 2), 16, 10).cast("int")).withColumn("_c", F.coalesce("class", F.lit("")))
    sums = ranks.running(keyed, ("_c",), [F.col("_h"), F.col("sample_id")], _r=F.lit(1))
    n = F.col("_r_all")
    ranked = sums.withColumn("_t", F.ceil(n * train)).withColumn("_e", F.col("_t") + F.ceil((n - F.col("_t")) / 2))
    return ranked.select(*samples.columns, F.when(F.col("_r") <= F.col("_t"), "train").when(F.col("_r") <= F.col("_e"), "test").otherwise("valid").alias("mix"))


def profile(long: DataFrame) -> DataFrame:
    """Level (a sample's mean) and pattern (value less level)."""
    level = F.avg("value").over(Window.partitionBy("sample_id"))
    return long.select("sample_id", "feature", level.alias("level"), (F.col("value") - level).alias("pattern"))


def means(long: DataFrame) -> DataFrame:
    """(feature, _mean)."""
    return long.groupBy("feature").agg(F.avg(F.col("value").cast("double")).alias("_mean"))


def gram(long: DataFrame, *by: str, block: int = 512) -> DataFrame:
    """(by, feature_a, feature_b, n, sa, sb, saa, sbb, sab): counts and sums over the samples that have both features, for every two features, of values less their feature's mean (over all groups).

    Samples are gathered to arrays; tasks add up matrix products of ``block`` by ``block`` features (blocks by hash, two at a time), and sums of tasks are added up by Spark. A feature that a sample repeats counts with its smallest value.
    """
    blocks = -(-long.select("feature").distinct().count() // block) or 1
    own = F.pmod(F.xxhash64("feature"), F.lit(blocks)).cast("int")
    centred = long.where("value is not null").join(means(long), "feature")
    held = F.struct("feature", (F.col("value").cast("double") - F.col("_mean")).alias("value"), own.alias("block"))
    rows = centred.groupBy("sample_id", *by).agg(F.sort_array(F.collect_list(held), asc=False).alias("x"))  # of a repeated feature the smallest value comes last, and stays
    if blocks == 1:
        rows = rows.withColumn("two", F.array(F.lit(0), F.lit(0)))
    else:  # blocks of a sample are cut out once; each is in as many pairs as there are blocks
        cut = rows.select(*by, F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.filter("x", lambda e: e["block"] == b)).alias("xs"))
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(blocks) for j in range(i, blocks)])
        both = lambda p: F.when(p["i"] == p["j"], F.col("xs")[p["i"]]).otherwise(F.concat(F.col("xs")[p["i"]], F.col("xs")[p["j"]]))
        rows = cut.select(*by, F.explode(F.transform(pairs, lambda p: F.struct(F.array(p["i"], p["j"]).alias("two"), both(p).alias("x")))).alias("p")).select(*by, "p.two", "p.x")
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by], F.array_join("two", "|"))
    slim = rows.select(key.alias("key"), *by, "two", "x")
    slim = slim if blocks == 1 else slim.repartition("key", F.pmod(F.xxhash64("x"), F.lit(64))).sortWithinPartitions("key")
    kinds = {c: long.schema[c].dataType.simpleString() for c in by}
    sums = ("n", "sa", "sb", "saa", "sbb", "sab")

    def add(batches):
        held: dict = {}
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for key in t.column("key").unique().to_pylist():
                part = t.filter(pc.equal(t.column("key"), key)).combine_chunks()
                if key not in held:
                    if len(held) >= 4:  # cells at a time
                        yield from flush(held)
                        held = {}
                    held[key] = ([part.column(c)[0].as_py() for c in by], part.column("two")[0].as_py(), {}, {}, {})
                for i in range(0, len(part), 1024):  # samples at a time
                    product(part.column("x").chunk(0).slice(i, 1024), held[key])
        yield from flush(held)

    def product(x: pa.ListArray, cell) -> None:
        _, _, names, found, sides = cell
        values = x.flatten()
        row = np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy()))
        coded = values.field("feature").dictionary_encode()
        place = np.array([names.setdefault(f, len(names)) for f in coded.dictionary.to_pylist()], "i8")
        p = len(names)
        dense, there = np.zeros((len(x), p)), np.zeros((len(x), p))
        if len(row):
            at = place[coded.indices.to_numpy()]
            dense[row, at], there[row, at] = values.field("value").to_numpy(), 1.0
            sides.update(zip(coded.dictionary.to_pylist(), values.field("block").to_numpy()[np.unique(coded.indices.to_numpy(), return_index=True)[1]].tolist(), strict=True))
        square = dense * dense
        new = {"n": there.T @ there, "sa": dense.T @ there, "sb": there.T @ dense, "saa": square.T @ there, "sbb": there.T @ square, "sab": dense.T @ dense}
        for k, m in new.items():
            if k in found:
                m[: len(found[k]), : len(found[k])] += found[k]
            found[k] = m

    def flush(held):
        for tags, (low, high), names, found, sides in held.values():
            if not names:
                continue
            order, side = np.array(list(names), object), np.array([sides[x] for x in names])
            meets = (order[:, None] < order[None, :]) & (found["n"] > 0)
            if low != high:  # features of one block meet where it is paired with itself
                meets &= side[:, None] != side[None, :]
            a, b = np.nonzero(meets)
            for i in range(0, len(a), 50_000):
                u, v = a[i : i + 50_000], b[i : i + 50_000]
                columns = [pa.array([tag] * len(u)) for tag in tags] + [pa.array(order[u].tolist(), pa.string()), pa.array(order[v].tolist(), pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(found[k][u, v]) for k in sums)], [*by, "feature_a", "feature_b", *sums])

    ddl = ", ".join([*(f"{c} {k}" for c, k in kinds.items()), "feature_a string, feature_b string", *(f"{c} double" for c in sums)])
    return slim.mapInArrow(add, ddl).groupBy(*by, "feature_a", "feature_b").agg(*[F.sum(c).alias(c) for c in sums])


def correlations(long: DataFrame) -> DataFrame:
    """Pearson's r of each pair of features with its p, over the samples that have both; null where either does not vary."""
    g = gram(long)
    c, va, vb = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n"), F.col("saa") - F.col("sa") ** 2 / F.col("n"), F.col("sbb") - F.col("sb") ** 2 / F.col("n")
    r = g.select("feature_a", "feature_b", F.try_divide(c, F.sqrt(F.greatest(va, F.lit(0.0)) * F.greatest(vb, F.lit(0.0)))).alias("r"), F.col("n").cast("bigint").alias("n"))
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2.0, 1 - F.col("r") * F.col("r")))
    return r.withColumn("p_value", stats.t_two_sided(t, F.col("n") - 2.0))
