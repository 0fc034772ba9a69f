"""Metrics of scores and signatures: ROC curves, cut-offs, confusion, meta-indices, leaderboards, overlaps and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.stats import harmonic
from helixmill.operators import ranks


def roc_points(scored: DataFrame, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """Cumulative true and false positives at each distinct score, from the top. Scores are aggregated first, so ties are one row, and summed in buckets, so no group is one task's."""
    at = scored.groupBy(*by, "score").agg(F.sum(F.col("label").cast("bigint")).alias("p"), F.sum((1 - F.col("label")).cast("bigint")).alias("n")).where("score is not null")
    upto = ranks.running(ranks.in_buckets(at, by, "score"), by, [F.col("score")], below_p=F.col("p"), below_n=F.col("n"))
    upto = upto.withColumnsRenamed({"below_p_all": "pos", "below_n_all": "neg"})
    return upto.select(*by, "score", "p", "n", (F.col("pos") - F.col("below_p") + F.col("p")).alias("tp"), (F.col("neg") - F.col("below_n") + F.col("n")).alias("fp"), "pos", "neg")


def auc(scored: DataFrame, by: tuple[str, ...] = ("feature",), turned: bool = True) -> DataFrame:
    """Area under the ROC curve (ties count half), turned to be at least 0.5 if ``turned``, with DeLong's 95 % interval from placement values. Null without both classes."""
    r = roc_points(scored, by)
    # a case beats the controls below it; a control is beaten by the cases above it
    v10 = F.try_divide(F.col("neg") - F.col("fp") + F.col("n") / 2, F.col("neg"))
    v01 = F.try_divide(F.col("tp") - F.col("p") / 2, F.col("pos"))
    sums = r.groupBy(*by).agg(F.max("pos").alias("pos"), F.max("neg").alias("neg"), F.sum(F.col("p") * v10).alias("s1"), F.sum(F.col("p") * v10 * v10).alias("q1"), F.sum(F.col("n") * v01).alias("s0"), F.sum(F.col("n") * v01 * v01).alias("q0"))
    a = F.try_divide("s1", "pos")
    # one case or one control has no variance: it adds nothing
    one = lambda q, s, n: F.coalesce(F.try_divide(q - s * s / n, (n - 1) * n), F.lit(0.0))
    var = one(F.col("q1"), F.col("s1"), F.col("pos")) + one(F.col("q0"), F.col("s0"), F.col("neg"))
    area, half = F.greatest(a, 1 - a) if turned else a, 1.959963984540054 * F.sqrt(F.greatest(var, F.lit(0.0)))
    return sums.select(*by, area.alias("auc"), F.greatest(F.lit(0.0), area - half).alias("auc_low"), F.least(F.lit(1.0), area + half).alias("auc_high"))


def youden(scored: DataFrame, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """The cut-off (score >= cut-off is Case) of the largest sensitivity + specificity - 1; of equals the largest."""
    j = F.col("tp") / F.col("pos") - F.col("fp") / F.col("neg")
    best = F.max(F.struct(F.round(j, 12).alias("j"), "score")).alias("b")
    return roc_points(scored, by).groupBy(*by).agg(best).select(*by, F.col("b.score").alias("cutoff"), F.col("b.j").alias("youden"))


def confusion(predicted: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Accuracy, sensitivity, specificity, PPV, NPV and F1 of (label, predicted), positive = 1; null where a denominator is 0."""
    y, p = F.col("label") == 1, F.col("predicted") == 1
    c = predicted.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return c.select(*by, "tp", "fp", "tn", "fn", ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), ratio(tp, tp + fn).alias("sensitivity"), ratio(tn, tn + fp).alias("specificity"), ratio(tp, tp + fp).alias("ppv"), ratio(tn, tn + fn).alias("npv"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def proposals(benchmark: DataFrame, without_train: bool = False) -> DataFrame:
    """Signatures by meta-index: the harmonic mean over splits of the mean accuracy over algorithms."""
    m = lambda s: F.avg(F.when(F.col("split") == s, F.col("value"))).alias(s)
    acc = benchmark.where("metric = 'Accuracy'").groupBy("method").agg(m("train"), m("test"), m("valid"))
    used = ("test", "valid") if without_train else ("train", "test", "valid")
    return acc.withColumn("metaindex", harmonic(*(F.col(x) for x in used)))


def proposals_youden(benchmark: DataFrame) -> DataFrame:
    """Signatures by the mean sensitivity + mean specificity - 1 on the validation split."""
    m = lambda s: F.avg(F.when(F.col("metric") == s, F.col("value")))
    return benchmark.where("split = 'valid'").groupBy("method").agg((m("Sensitivity") + m("Specificity") - 1).alias("metaindex"))


def leaderboard(benchmark: DataFrame) -> DataFrame:
    """A row a signature and algorithm with its accuracies and meta-index; incomplete rows go."""
    m = lambda s: F.max(F.when(F.col("split") == s, F.col("value"))).alias(s)
    acc = benchmark.where("metric = 'Accuracy'").groupBy("method", "algorithm").agg(m("train"), m("test"), m("valid")).dropna()
    return acc.withColumn("metaindex", harmonic(F.col("train"), F.col("test"), F.col("valid"))).withColumn("metaindex2", (F.col("train") + F.col("test") + F.col("valid")) / 3)


def overlap(signatures: DataFrame) -> DataFrame:
    """Venn regions: for each set of methods the features that exactly these have."""
    sets = signatures.groupBy("feature").agg(F.array_join(F.array_sort(F.collect_set("method")), "&").alias("methods"))
    return sets.groupBy("methods").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("feature")), ",").alias("features"))


def merge_formulas(signatures: DataFrame, most: int = 11, pinned: tuple[str, ...] = ("fcsig", "cfs_sig")) -> DataFrame:
    """One formula a distinct feature set, under its first method; longer ones than ``most`` go unless pinned."""
    f = signatures.groupBy("method").agg(F.array_sort(F.collect_set("feature")).alias("fs"))
    f = f.select("method", F.size("fs").alias("size"), F.concat(F.lit("Class ~ "), F.array_join("fs", " + ")).alias("formula"))
    f = f.where((F.col("size") <= most) | F.col("method").isin(*pinned))
    first = Window.partitionBy("formula").orderBy("method")
    return f.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("method", "formula", F.when(F.col("method").isin(*pinned), 0).otherwise(F.col("size")).alias("n_features"))


def grid(of: DataFrame, **values) -> DataFrame:
    """The rows of ``of`` by every combination of the value lists. The lists are literals: their product is the feature asked for."""
    for name, options in values.items():
        of = of.select("*", F.explode(F.array(*[F.lit(x) for x in options])).alias(name))
    return of


def symmetrical_uncertainty(long: DataFrame, bins: int = 4) -> DataFrame:
    """2 (H(X) + H(Y) - H(X, Y)) / (H(X) + H(Y)) of each feature's equal-width bins and the class."""
    span = long.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    b = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return uncertainty(long.join(span, "feature").groupBy("feature", b.alias("bin"), "class").agg(F.count("*").alias("n")))


def uncertainty(cells: DataFrame, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """by, su and gain, from contingency counts (by, bin, class, n): 2 (H(X) + H(Y) - H(X, Y)) / (H(X) + H(Y)), 0 where neither varies."""
    h = lambda n, total: -F.sum(n / total * F.log2(n / total))
    cells = cells.withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    xy = cells.groupBy(*by).agg(h(F.col("n"), F.col("total")).alias("hxy"))
    side = lambda c, name: cells.groupBy(*by, c).agg(F.sum("n").alias("n"), F.max("total").alias("total")).groupBy(*by).agg(h(F.col("n"), F.col("total")).alias(name))
    gain = F.col("hx") + F.col("hy") - F.col("hxy")
    su = F.coalesce(F.try_divide(2 * gain, F.col("hx") + F.col("hy")), F.lit(0.0))
    return xy.join(side("bin", "hx"), list(by)).join(side("class", "hy"), list(by)).select(*by, su.alias("su"), gain.alias("gain"))
