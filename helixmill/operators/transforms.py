"""Balancing, batch correction, cross-validated ranking, association tests and heat-map matrices, on long tables (sample_id, class, feature, value).

Random draws are hashes of their keys, so they are the same for any partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions import stats
from helixmill.operators import evaluation, ranks

#: Rows whose distances one task computes; larger minorities are searched block by block of about this size.
BLOCK = 4096


def uniform(*parts) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by bars."""
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("bigint") / F.lit(float(1 << 28))


def class_sizes(long: DataFrame) -> dict[str, int]:
    """Samples by class: two numbers, whatever the table's size."""
    return {r["class"]: r["n"] for r in long.groupBy("class", "sample_id").agg(F.lit(1)).groupBy("class").agg(F.count("*").alias("n")).collect()}


def nearest(samples: DataFrame, k: int, blocks: int) -> DataFrame:
    """(sample_id, near) with the ids of the ``k`` nearest other samples, by Euclidean distance, ties to the smaller id. Samples are (sample_id, x array). With more than one block, each task holds one block against another, and the nearest of all are merged."""

    def search(key, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("sample_id")
        asked = block[block["block"] == key[0]]
        held = block[block["block"] == key[1]]
        if not len(asked) or not len(held):
            return pd.DataFrame({"sample_id": asked["sample_id"][:0], "d": [], "other": asked["sample_id"][:0]})
        ids, x = held["sample_id"].to_numpy(), np.stack(held["x"].to_numpy())
        out = []
        for i, y in zip(asked["sample_id"].to_numpy(), asked["x"], strict=True):
            d = ((x - y) ** 2).sum(axis=1)
            d[ids == i] = np.inf
            best = [j for j in np.argsort(d, kind="stable")[:k] if ids[j] != i]
            out.append(pd.DataFrame({"sample_id": i, "d": d[best], "other": ids[best]}))
        return pd.concat(out)

    kind = samples.schema["sample_id"].dataType.simpleString()
    dealt = samples.withColumn("block", F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    cells = F.array_distinct(F.concat(F.transform(every, lambda b: F.struct(F.col("block").alias("i"), b.alias("j"))), F.transform(every, lambda b: F.struct(b.alias("i"), F.col("block").alias("j")))))
    met = dealt.withColumn("cell", F.explode(cells)).select("sample_id", "x", "block", "cell.i", "cell.j")
    found = met.groupBy("i", "j").applyInPandas(search, f"sample_id {kind}, d double, other {kind}")
    near = found.groupBy("sample_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("d", "other"))), 1, k), lambda s: s["other"]).alias("near"))
    return samples.select("sample_id").join(near, "sample_id", "left").select("sample_id", F.coalesce("near", F.array().cast(f"array<{kind}>")).alias("near"))


def smote(long: DataFrame, k: int = 5, seed: int = 1, each: int | None = None) -> DataFrame:
    """Synthetic minority rows (sample_id, draw, class, feature, value): ``each`` for a minority sample; if not given, as many as bring the minority to the majority's size or just above.

    A row lies between its sample and one of its ``k`` nearest minority samples. Balanced or one-class tables give no rows; a lone minority sample gives copies of itself. Samples must have every feature and no nulls.
    """
    sizes = class_sizes(long)
    minor = min(sizes, key=lambda c: (sizes[c], c), default=None)
    few, many = (sizes[minor], max(sizes.values())) if sizes else (1, 1)
    each = -(-(many - few) // few) if each is None else each
    own = long.where(F.col("class").eqNullSafe(F.lit(minor))).select("sample_id", "class", "feature", "value")
    vectors = own.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "value"))), lambda s: s["value"]).alias("x"))
    near = nearest(vectors, k, -(-few // BLOCK))
    draws = near.select("sample_id", "near", F.explode(F.sequence(F.lit(1), F.lit(each))).alias("draw")) if each else near.select("sample_id", "near", F.lit(1).alias("draw")).limit(0)
    at = F.floor(uniform(seed, "near", F.col("sample_id"), F.col("draw")) * F.size("near")).cast("int")
    draws = draws.select("sample_id", "draw", F.coalesce(F.get("near", at), "sample_id").alias("other"), uniform(seed, "gap", F.col("sample_id"), F.col("draw")).alias("gap"))
    others = own.select(F.col("sample_id").alias("other"), "feature", F.col("value").alias("there"))
    return draws.join(own, "sample_id").join(others, ["other", "feature"]).select("sample_id", "draw", "class", "feature", (F.col("value") + F.col("gap") * (F.col("there") - F.col("value"))).alias("value"))


def undersample(long: DataFrame, kept: str, rows: int, seed: int = 1) -> DataFrame:
    """``long`` without some samples of classes other than ``kept``: about ``rows`` of theirs stay, each by its own chance. Classes with fewer stay whole."""
    others = sum(n for c, n in class_sizes(long).items() if c != kept)
    stays = (F.col("class") == kept) | (uniform(seed, "under", F.col("sample_id")) < rows / max(others, 1))
    return long.where(stays)


def rose(long: DataFrame, rows: int, seed: int = 1) -> DataFrame:
    """A smoothed bootstrap (sample_id, draw, class, feature, value) of about ``rows`` rows, half of them of each class: every sample is drawn equally often (up to one, by chance), and each value gets Gaussian noise of its class's bandwidth. Features that do not vary in a class get no noise."""
    sizes = class_sizes(long)
    p = long.select("feature").distinct().count()
    h = F.pow(F.lit(4.0) / ((p + 2) * F.col("n")), F.lit(1.0 / (p + 4))) * F.coalesce("sd", F.lit(0.0))
    kernel = long.groupBy("class", "feature").agg(F.count("value").alias("n"), F.stddev_samp("value").alias("sd")).select("class", "feature", h.alias("h"))
    times = F.lit(None).cast("double")
    for name, n in sizes.items():
        times = F.when(F.col("class").eqNullSafe(F.lit(name)), F.lit(rows / len(sizes) / n)).otherwise(times)
    copies = F.floor(times + uniform(seed, "copies", F.col("sample_id"))).cast("int")
    drawn = long.withColumn("copies", copies).where("copies > 0").withColumn("draw", F.explode(F.sequence(F.lit(1), "copies")))
    u, v = (uniform(seed, x, F.col("sample_id"), F.col("draw"), F.col("feature")) for x in ("u", "v"))
    normal = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * np.pi * v)
    return drawn.join(kernel, ["class", "feature"]).select("sample_id", "draw", "class", "feature", (F.col("value") + F.col("h") * normal).alias("value"))


def batch_effects(long: DataFrame, steps: int = 50) -> DataFrame:
    """Per batch and feature: grand mean, pooled sd, and the empirical Bayes shift and scale of parametric ComBat; ``combat`` takes a covariate out before.

    Needs nothing but counts, means and variances by batch and feature: the conditional estimates are iterated on these. Features without variance within batches get no row, and so stay as they are in ``combat``.
    """
    cells = long.groupBy("feature", "batch").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("var"))
    of = Window.partitionBy("feature")
    total = F.sum("n").over(of)
    cells = cells.withColumns({"grand": F.sum(F.col("n") * F.col("mean")).over(of) / total, "pooled": F.sum((F.col("n") - 1) * F.col("var")).over(of) / total}).where("pooled > 0")
    hats = cells.select("feature", "batch", "n", "grand", F.sqrt("pooled").alias("sd"), ((F.col("mean") - F.col("grand")) / F.sqrt("pooled")).alias("g"), (F.col("var") / F.col("pooled")).alias("d"))
    prior = hats.groupBy("batch").agg(F.avg("g").alias("gbar"), F.var_samp("g").alias("t2"), F.avg("d").alias("m"), F.var_samp("d").alias("s2"))
    prior = prior.select("batch", "gbar", "t2", F.try_divide(2 * F.col("s2") + F.col("m") ** 2, F.col("s2")).alias("a"), F.try_divide(F.col("m") * F.col("s2") + F.col("m") ** 3, F.col("s2")).alias("b"))

    def step(now, _):
        shift = (F.col("t2") * F.col("n") * F.col("g") + now["d"] * F.col("gbar")) / (F.col("t2") * F.col("n") + now["d"])
        squares = (F.col("n") - 1) * F.col("d") + F.col("n") * (F.col("g") - shift) ** 2
        return F.struct(shift.alias("g"), ((squares / 2 + F.col("b")) / (F.col("n") / 2 + F.col("a") - 1)).alias("d"))

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.col("g"), F.col("d")), step)
    # one feature alone has no prior variance: its own estimates stand
    return hats.join(prior, "batch").withColumn("eb", solved).select("feature", "batch", "grand", "sd", F.coalesce("eb.g", "g").alias("shift"), F.coalesce("eb.d", "d").alias("scale"))


def class_slopes(long: DataFrame) -> DataFrame:
    """(feature, slope): how much higher a Case's value is in a linear model with a level for each batch; 0 if no batch has both classes. Within a batch cases and their mean tell all there is to know."""
    case = F.col("class") == "Case"
    cells = long.where("value is not null").groupBy("feature", "batch").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.count_if(case).alias("n1"), F.avg(F.when(case, F.col("value"))).alias("mean1"))
    across, within = F.sum(F.col("n1") * (F.col("mean1") - F.col("mean"))), F.sum(F.col("n1") - F.col("n1") * F.col("n1") / F.col("n"))
    return cells.groupBy("feature").agg(F.coalesce(F.when(within > 0, across / within), F.lit(0.0)).alias("slope"))


def combat(long: DataFrame, steps: int = 50, by_class: bool = False) -> DataFrame:
    """``long`` (with a batch column) with batch shifts and scales taken out of ``value``. With ``by_class`` the difference between the classes is fitted with the batches and stays: batches of unlike shares of cases are not made alike by it. Features whose batches have one class each have no such difference to fit."""
    if by_class:
        part = F.when(F.col("class") == "Case", F.coalesce("_slope", F.lit(0.0))).otherwise(0.0)
        apart = long.join(class_slopes(long).withColumnRenamed("slope", "_slope"), "feature", "left").select(*long.columns, part.alias("_part"))
        return combat(apart.withColumn("value", F.col("value") - F.col("_part")), steps).withColumn("value", F.col("value") + F.col("_part")).drop("_part")
    effects = batch_effects(long, steps)
    z = (F.col("value") - F.col("grand")) / F.col("sd")
    mended = (z - F.col("shift")) / F.sqrt("scale") * F.col("sd") + F.col("grand")
    return long.join(effects, ["feature", "batch"], "left").select(*long.columns[: long.columns.index("value")], F.coalesce(mended, "value").alias("value"), *long.columns[long.columns.index("value") + 1 :])


def fold_ranking(long: DataFrame, fold: Column, k: int) -> DataFrame:
    """(feature, n_folds, mean_auc): features among the ``k`` of largest AUC in some fold's training part, with the number of such folds. Each row serves the folds that leave it out."""
    folds = long.select(fold.alias("f")).distinct()
    scored = long.select(fold.alias("own"), "feature", F.col("value").alias("score"), (F.col("class") == "Case").cast("int").alias("label"))
    per = evaluation.auc(scored.join(F.broadcast(folds), F.col("own") != F.col("f")), ("f", "feature"))  # as many rows as there are folds
    rank = F.row_number().over(Window.partitionBy("f").orderBy(F.desc(F.round("auc", 10)), "feature"))
    return per.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("feature").agg(F.count("*").alias("n_folds"), F.avg("auc").alias("mean_auc"))


def chi_squared(table: DataFrame, row: str, col: str) -> DataFrame:
    """One row (n, df, statistic, p_value) of Pearson's test of independence of two columns; Yates's correction in a 2 x 2 table. Rows with a null in either are left out."""
    cell = table.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(F.col(row).alias("r"), F.col(col).alias("c")).agg(F.count("*").alias("o"))
    rows, cols = cell.groupBy("r").agg(F.sum("o").alias("nr")), cell.groupBy("c").agg(F.sum("o").alias("nc"))
    total = cell.agg(F.sum("o").alias("n"), ((F.count_distinct("r") - 1) * (F.count_distinct("c") - 1)).alias("df"))
    every = rows.crossJoin(F.broadcast(cols)).join(cell, ["r", "c"], "left").crossJoin(F.broadcast(total))  # the margins of a contingency table
    e = F.col("nr") * F.col("nc") / F.col("n")
    off = F.abs(F.coalesce("o", F.lit(0)) - e)
    off = F.when(F.col("df") == 1, off - F.least(F.lit(0.5), off)).otherwise(off)
    return every.groupBy("n", "df").agg(F.sum(off * off / e).alias("statistic")).withColumn("p_value", stats.chi_squared_upper(F.col("statistic"), F.col("df")))


def balance(table: DataFrame, class_col: str = "class", case: str = "Case") -> DataFrame:
    """One row (n, cases, p_value): the exact two-sided binomial test of the cases against one half. Rows without a class are left out."""
    counts = table.where(F.col(class_col).isNotNull()).agg(F.count("*").alias("n"), F.count_if(F.col(class_col) == case).alias("cases"))
    return counts.withColumn("p_value", stats.binomial_even(F.col("cases"), F.col("n")))


def association(long: DataFrame, target: str) -> DataFrame:
    """Every other feature against ``target``: Pearson's and Spearman's correlation with their p-values (Student's t), the line of best fit and its adjusted R squared. Tied values have their mean rank, from running counts in buckets."""
    each = long.where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("_n"))
    upto = ranks.running(ranks.in_buckets(each, ("feature",), "value"), ("feature",), [F.col("value")], _upto=F.col("_n"))
    ranked = long.join(upto.select("feature", "value", (F.col("_upto") - (F.col("_n") - 1) / 2).alias("rank")), ["feature", "value"])
    x = ranked.where(F.col("feature") == target).select("sample_id", F.col("value").alias("x"), F.col("rank").alias("rx"))
    n, r2 = F.count("*"), F.regr_r2("value", "x")
    found = ranked.where(F.col("feature") != target).join(x, "sample_id").groupBy("feature").agg(n.alias("n"), F.corr("value", "x").alias("pearson"), F.corr("rank", "rx").alias("spearman"), F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("intercept"), (1 - (1 - r2) * (n - 1) / (n - 2)).alias("adjusted_r2"))
    p = lambda r: stats.t_two_sided(F.col(r) * F.sqrt(F.try_divide(F.col("n") - 2.0, 1 - F.col(r) * F.col(r))), F.col("n") - 2.0)
    return found.withColumns({"pearson_p": p("pearson"), "spearman_p": p("spearman")})


def heat_map(long: DataFrame, clip: float = 2.0, bins: int = 50) -> DataFrame:
    """Values centred and scaled by feature, clipped to ``clip`` either way, and the equal-width bin (1 to 2 * ``bins``) of each."""
    moments = long.groupBy("feature").agg(F.avg("value").alias("a"), F.stddev_samp("value").alias("s"))
    z = F.least(F.greatest((F.col("value") - F.col("a")) / F.when(F.col("s") > 0, F.col("s")), F.lit(-clip)), F.lit(clip))
    scaled = long.join(moments, "feature").select("sample_id", "class", "feature", z.alias("z"))
    return scaled.withColumn("bin", F.least(F.floor((F.col("z") + clip) / (clip / bins)) + 1, F.lit(2 * bins)).cast("int"))
