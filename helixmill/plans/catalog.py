"""Registered queries over the driver's tables, and the SQL each must equal. Figures are rounded where sums may differ in their last bits."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.operators import evaluation as ev
from helixmill.operators import expression as ex
from helixmill.operators import preparation
from helixmill.sources import fixtures as fx

QUERIES = {}
ORACLES = {}

#: The long tables of ``fixtures`` in SQL.
FEATURES = "feat AS (SELECT vec_id AS sample_id, CASE WHEN label = 0 THEN 'Case' ELSE 'Control' END AS class, 'hsa.f' || lpad(CAST(t.i - 1 AS VARCHAR), 2, '0') AS feature, CAST(embedding[t.i] AS DOUBLE) AS value FROM embeddings, range(1, 65) t(i) WHERE t.i <= len(embedding))"
COUNTS = "cnt AS (SELECT l_suppkey AS sample_id, p_brand AS feature, count(*) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
MISSING = FEATURES + ", miss AS (SELECT sample_id, class, feature, CASE WHEN (sample_id * 31 + CAST(substr(feature, 6, 2) AS BIGINT) * 17) % 11 <> 0 THEN value END AS value FROM feat)"
BENCH = """base AS (SELECT 'sig' || CAST(o_custkey % 12 AS VARCHAR) AS method, CASE o_orderkey % 4 WHEN 0 THEN 'rf' WHEN 1 THEN 'mlp' WHEN 2 THEN 'svm' ELSE 'tree' END AS algorithm, sum(o_orderkey % 97) AS v, count(*) AS n FROM orders GROUP BY ALL),
bench AS (SELECT method, algorithm, split, metric, 0.5::DOUBLE + CAST((v * length(split) + n * length(metric)) % 500 AS DOUBLE) / 1000.0::DOUBLE AS value FROM base, (VALUES ('train'), ('test'), ('valid')) s(split), (VALUES ('Accuracy'), ('Sensitivity'), ('Specificity')) m(metric))"""


def t_p(t: str, df: str) -> str:
    """Student's two-sided p by Simpson's rule in 2000 steps and the gamma function: another rule than the operator's."""
    upper = f"asin(sqrt({df} / ({df} + ({t}) * ({t}))))"
    width = f"least({upper}, 12.0 / sqrt({df}), 45.0 / greatest(({df} - 1) / tan({upper}), 1e-300::DOUBLE))"
    terms = f"list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i = 0 OR i = 2000 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END * pow(sin({upper} - {width} + {width} / 2000 * i), {df} - 1)))"
    return f"({width} / 6000 * {terms} / (sqrt(pi()) / 2 * exp(lgamma({df} / 2) - lgamma(({df} + 1) / 2))))"


DE = FEATURES + f""",
mom AS (SELECT feature, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS sd,
  avg(value) FILTER (class = 'Case') AS mean1, median(value) FILTER (class = 'Case') AS median1, stddev_samp(value) FILTER (class = 'Case') AS sd1, var_samp(value) FILTER (class = 'Case') AS var1, count(value) FILTER (class = 'Case') AS n1,
  avg(value) FILTER (class = 'Control') AS mean0, median(value) FILTER (class = 'Control') AS median0, stddev_samp(value) FILTER (class = 'Control') AS sd0, var_samp(value) FILTER (class = 'Control') AS var0, count(value) FILTER (class = 'Control') AS n0 FROM feat GROUP BY feature),
w AS (SELECT *, (mean1 - mean0) / sqrt(var1 / n1 + var0 / n0) AS t, pow(var1 / n1 + var0 / n0, 2) / (pow(var1 / n1, 2) / (n1 - 1) + pow(var0 / n0, 2) / (n0 - 1)) AS df FROM mom),
p AS (SELECT *, {t_p('t', 'df')} AS p_value FROM w),
k AS (SELECT *, row_number() OVER (ORDER BY p_value, feature) AS r, count(*) OVER () AS m FROM p),
de AS (SELECT *, least(1.0, p_value * m) AS p_bonferroni, max(least(1.0, (m - r + 1) * p_value)) OVER (ORDER BY r) AS p_holm, min(least(1.0, m / r * p_value)) OVER (ORDER BY r DESC) AS p_bh, mean1 - mean0 AS diff FROM k)"""

SHOWN = ("mean", "median", "sd", "mean1", "median1", "sd1", "mean0", "median0", "sd0", "t", "df", "p_value", "p_bonferroni", "p_holm", "p_bh")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df, *names, digits: int = 8):
    return df.withColumns({n: F.round(n, digits) for n in names})


def r(*names, digits: int = 8) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


@query("de_logtpm", f"WITH {DE} SELECT feature, n1, n0, {r(*SHOWN)}, round(diff, 8) AS log10fc, round(diff / log10(2), 8) AS log2fc, round(-diff, 8) AS reversed_log10fc, round(-diff / log10(2), 8) AS reversed_log2fc FROM de")
def de_logtpm(spark, sf):
    found = rounded(ex.differential_expression(fx.feature_matrix(spark, sf)), *SHOWN, "log10fc", "log2fc", "reversed_log10fc", "reversed_log2fc")
    return found.select("feature", "n1", "n0", *SHOWN, "log10fc", "log2fc", "reversed_log10fc", "reversed_log2fc")


@query("de_deltact", f"WITH {DE} SELECT feature, round(pow(2.0, diff), 8) AS fc, round(log10(pow(2.0, diff)), 8) AS log10fc, round(diff, 8) AS log2fc, round(p_bh, 8) AS p_bh FROM de")
def de_deltact(spark, sf):
    d = ex.differential_expression(fx.feature_matrix(spark, sf), "deltact")
    return d.select("feature", F.round(F.pow(F.lit(2.0), "log2fc"), 8).alias("fc"), F.round("log10fc", 8).alias("log10fc"), F.round("log2fc", 8).alias("log2fc"), F.round("p_bh", 8).alias("p_bh"))


@query("volcano", f"WITH {DE} SELECT feature, round(diff / log10(2), 8) AS x, round(-log10(p_value), 6) AS y, p_value <= 0.05 AS labelled, round(max(abs(diff / log10(2))) OVER (), 8) AS x_limit FROM de")
def volcano(spark, sf):
    from pyspark.sql import Window

    d = ex.differential_expression(fx.feature_matrix(spark, sf))
    return d.select("feature", F.round("log2fc", 8).alias("x"), F.round(-F.log10("p_value"), 6).alias("y"), (F.col("p_value") <= 0.05).alias("labelled"), F.round(F.max(F.abs("log2fc")).over(Window.partitionBy()), 8).alias("x_limit"))


SIGS = DE + """,
sig AS (SELECT * FROM de WHERE p_value <= 0.05 OR (SELECT min(p_value) FROM de) > 0.05),
ranked AS (SELECT 'sigtop' AS method, row_number() OVER (ORDER BY p_value, p_bh, feature) AS rank, feature FROM de
  UNION ALL SELECT 'sigtopBonf', row_number() OVER (ORDER BY p_bonferroni, p_bh, feature), feature FROM de
  UNION ALL SELECT 'sigtopHolm', row_number() OVER (ORDER BY p_holm, p_bh, feature), feature FROM de
  UNION ALL SELECT 'topFC', row_number() OVER (ORDER BY abs(diff) DESC, p_bh, feature), feature FROM de),
signatures AS (SELECT * FROM ranked WHERE rank <= 11
  UNION ALL SELECT 'sig', row_number() OVER (ORDER BY p_bh, feature), feature FROM sig
  UNION ALL SELECT 'fcsig', row_number() OVER (ORDER BY p_bh, feature), feature FROM sig WHERE abs(diff / log10(2)) > 1)"""


def signatures_of(spark, sf):
    return ex.signatures(ex.differential_expression(fx.feature_matrix(spark, sf)))


@query("signatures", f"WITH {SIGS} SELECT method, CAST(rank AS INTEGER) AS rank, feature FROM signatures")
def signatures(spark, sf):
    return signatures_of(spark, sf)


@query("signature_overlap", f"WITH {SIGS}, s AS (SELECT feature, array_to_string(list_sort(list(DISTINCT method)), '&') AS methods FROM signatures GROUP BY feature) SELECT methods, count(*) AS n, array_to_string(list_sort(list(feature)), ',') AS features FROM s GROUP BY methods")
def signature_overlap(spark, sf):
    return ev.overlap(signatures_of(spark, sf))


@query("merge_formulas", f"""WITH {SIGS}, f AS (SELECT method, count(*) AS size, 'Class ~ ' || array_to_string(list_sort(list(feature)), ' + ') AS formula FROM signatures GROUP BY method),
g AS (SELECT *, row_number() OVER (PARTITION BY formula ORDER BY method) AS k FROM f WHERE size <= 11 OR method = 'fcsig') SELECT method, formula, CAST(CASE WHEN method = 'fcsig' THEN 0 ELSE size END AS INTEGER) AS n_features FROM g WHERE k = 1""")
def merge_formulas(spark, sf):
    return ev.merge_formulas(signatures_of(spark, sf))


@query("best_signature_de", f"WITH {SIGS} SELECT CAST(s.rank AS INTEGER) AS rank, s.feature, round(d.diff, 8) AS log10fc, round(d.p_bh, 8) AS p_bh FROM signatures s LEFT JOIN de d USING (feature) WHERE s.method = 'topFC'")
def best_signature_de(spark, sf):
    de = ex.differential_expression(fx.feature_matrix(spark, sf))
    chosen = ex.top(de, "topFC", -F.abs("log2fc"), 11)
    return chosen.join(de, "feature", "left").select("rank", "feature", F.round("log10fc", 8).alias("log10fc"), F.round("p_bh", 8).alias("p_bh"))


@query("log10_tpm", f"WITH {COUNTS} SELECT sample_id, feature, value, round(value / sum(value) OVER (PARTITION BY sample_id) * 1e6, 6) AS cpm, round(log10(value / sum(value) OVER (PARTITION BY sample_id) * 1e6 + 0.001), 8) AS log10tpm FROM cnt")
def log10_tpm(spark, sf):
    return rounded(rounded(ex.log10_tpm(fx.count_matrix(spark, sf)), "cpm", digits=6), "log10tpm")


@query("expression_filter", f"WITH {COUNTS} SELECT feature FROM cnt GROUP BY feature HAVING count(*) FILTER (value < 24) <= 0.5 * count(*)")
def expression_filter(spark, sf):
    return ex.expressed(fx.count_matrix(spark, sf), 24)


@query("like_counts", f"WITH {COUNTS} SELECT feature, min(CASE WHEN value % 1 = 0 AND value >= 0 THEN 1 ELSE 0 END)::INTEGER AS counts_like FROM cnt GROUP BY feature")
def like_counts(spark, sf):
    return ex.like_counts(fx.count_matrix(spark, sf))


@query("class_counts", f"WITH {FEATURES}, s AS (SELECT DISTINCT sample_id, class FROM feat) SELECT class, count(*) AS n, CAST(ceil(max(count(*)) OVER () / count(*)) AS BIGINT) AS weight FROM s GROUP BY class")
def class_counts(spark, sf):
    from pyspark.sql import Window

    n = fx.table(spark, sf, "embeddings").groupBy(F.when(F.col("label") == 0, "Case").otherwise("Control").alias("class")).agg(F.count("*").alias("n"))
    return n.withColumn("weight", F.ceil(F.max("n").over(Window.partitionBy()) / F.col("n")))


@query("missing_audit", f"WITH {MISSING} SELECT feature, count(*) FILTER (value IS NULL) AS n_missing, count(*) AS n, {r('median', 'mean')} FROM (SELECT feature, value, median(value) OVER (PARTITION BY feature) AS median, avg(value) OVER (PARTITION BY feature) AS mean FROM miss) GROUP BY feature, median, mean")
def missing_audit(spark, sf):
    return rounded(ex.missing_audit(fx.missing_matrix(spark, sf)), "median", "mean")


@query("impute_median", f"WITH {MISSING}, a AS (SELECT feature, median(value) AS fill FROM miss GROUP BY feature HAVING count(*) FILTER (value IS NULL) < 0.1 * count(*)) SELECT sample_id, class, feature, round(coalesce(value, fill), 8) AS value FROM miss JOIN a USING (feature)")
def impute_median(spark, sf):
    return rounded(ex.impute(fx.missing_matrix(spark, sf)), "value")


@query("complete_cases", f"WITH {MISSING} SELECT sample_id, count(*) AS n_features FROM miss GROUP BY sample_id HAVING count(*) FILTER (value IS NULL) <= 5")
def complete_cases(spark, sf):
    return preparation.complete(fx.missing_matrix(spark, sf), 5)


@query("z_scores", f"WITH {FEATURES}, m AS (SELECT feature, avg(value) AS a, stddev_samp(value) AS s FROM feat GROUP BY feature) SELECT sample_id, class, feature, round((value - a) / s, 7) AS value FROM feat JOIN m USING (feature)")
def z_scores(spark, sf):
    return rounded(ex.z_scores(fx.feature_matrix(spark, sf)), "value", digits=7)


@query("describe", f"""WITH {FEATURES}, m AS (SELECT feature, median(value) AS mid FROM feat GROUP BY feature),
c AS (SELECT feature, avg(value) AS mean FROM feat GROUP BY feature),
d AS (SELECT feature, count(value) AS n, any_value(c.mean) AS mean, stddev_samp(value) AS sd, median(value) AS median, 1.4826 * median(abs(value - mid)) AS mad, min(value) AS min, max(value) AS max, avg(pow(value - c.mean, 3)) AS m3, avg(pow(value - c.mean, 4)) AS m4 FROM feat JOIN m USING (feature) JOIN c USING (feature) GROUP BY feature)
SELECT feature, n, {r('mean', 'sd', 'median', 'mad', 'min', 'max', digits=6)}, round(max - min, 6) AS range, round(m3 / pow(sd, 3), 6) AS skew, round(m4 / pow(sd, 4) - 3, 6) AS kurtosis, round(sd / sqrt(n), 6) AS se FROM d""")
def describe(spark, sf):
    return rounded(ex.describe(fx.feature_matrix(spark, sf)), "mean", "sd", "median", "mad", "min", "max", "range", "skew", "kurtosis", "se", digits=6)


@query("stratified_split", """WITH s AS (SELECT vec_id AS sample_id, CASE WHEN label = 0 THEN 'Case' ELSE 'Control' END AS class FROM embeddings),
k AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY substr(md5('1|' || CAST(sample_id AS VARCHAR)), 1, 7), sample_id) AS r, count(*) OVER (PARTITION BY class) AS n FROM s),
t AS (SELECT *, ceil(n * 0.6::DOUBLE) AS nt FROM k)
SELECT sample_id, class, CASE WHEN r <= nt THEN 'train' WHEN r <= nt + ceil((n - nt) / 2) THEN 'test' ELSE 'valid' END AS mix FROM t""")
def stratified_split(spark, sf):
    samples = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), F.when(F.col("label") == 0, "Case").otherwise("Control").alias("class"))
    return ex.stratified_split(samples)


@query("zero_variance", f"WITH {FEATURES}, z AS (SELECT feature, sample_id % 3 AS mix, CASE WHEN feature = 'hsa.f03' AND sample_id % 3 = 1 THEN 0.5 ELSE value END AS value FROM feat), v AS (SELECT feature, mix, var_samp(value) AS v FROM z GROUP BY ALL) SELECT feature FROM v GROUP BY feature HAVING count(*) FILTER (coalesce(v, 0) = 0) = 0")
def zero_variance(spark, sf):
    mix = F.col("sample_id") % 3
    long = fx.feature_matrix(spark, sf).withColumn("mix", mix).withColumn("value", F.when((F.col("feature") == "hsa.f03") & (mix == 1), 0.5).otherwise(F.col("value")))
    return ex.varying(long, "mix")


@query("profile", f"WITH {FEATURES} SELECT sample_id, feature, round(avg(value) OVER (PARTITION BY sample_id), 8) AS level, round(value - avg(value) OVER (PARTITION BY sample_id), 8) AS pattern FROM feat")
def profile(spark, sf):
    return rounded(ex.profile(fx.feature_matrix(spark, sf)), "level", "pattern")


@query("correlations", f"WITH {FEATURES}, c AS (SELECT a.feature AS feature_a, b.feature AS feature_b, corr(a.value, b.value) AS r, count(*) AS n FROM feat a JOIN feat b ON a.sample_id = b.sample_id AND a.feature < b.feature GROUP BY ALL), d AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2.0::DOUBLE AS df FROM c) SELECT feature_a, feature_b, round(r, 8) AS r, n, round({t_p('t', 'df')}, 7) AS p_value FROM d")
def correlations(spark, sf):
    return rounded(rounded(ex.correlations(fx.feature_matrix(spark, sf)), "r"), "p_value", digits=7)


def scored(spark, sf):
    return fx.feature_matrix(spark, sf).select("feature", F.col("value").alias("score"), (F.col("class") == "Case").cast("int").alias("label"))


AUC = FEATURES + """, g AS (SELECT feature, value AS score, count(*) FILTER (class = 'Case') AS p, count(*) FILTER (class <> 'Case') AS n FROM feat GROUP BY ALL),
roc AS (SELECT feature, score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY feature) AS pos, sum(n) OVER (PARTITION BY feature) AS neg FROM g WINDOW w AS (PARTITION BY feature ORDER BY score DESC))"""


@query("roc_auc", f"""WITH {AUC}, v AS (SELECT *, (neg - fp + n / 2) / neg AS v10, (tp - p / 2) / pos AS v01 FROM roc),
s AS (SELECT feature, max(pos) AS pos, max(neg) AS neg, sum(p * v10) AS s1, sum(p * v10 * v10) AS q1, sum(n * v01) AS s0, sum(n * v01 * v01) AS q0 FROM v GROUP BY feature),
a AS (SELECT feature, greatest(s1 / pos, 1 - s1 / pos) AS auc, 1.959963984540054 * sqrt(greatest(0.0::DOUBLE, (q1 - s1 * s1 / pos) / (pos - 1) / pos + (q0 - s0 * s0 / neg) / (neg - 1) / neg)) AS h FROM s)
SELECT feature, round(auc, 8) AS auc, round(greatest(0.0::DOUBLE, auc - h), 8) AS auc_low, round(least(1.0::DOUBLE, auc + h), 8) AS auc_high FROM a""")
def roc_auc(spark, sf):
    return rounded(ev.auc(scored(spark, sf)), "auc", "auc_low", "auc_high")


@query("youden_cutoff", f"WITH {AUC}, j AS (SELECT feature, score, round(tp / pos - fp / neg, 12) AS j FROM roc), k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY j DESC, score DESC) AS k FROM j) SELECT feature, round(score, 8) AS cutoff, round(j, 8) AS youden FROM k WHERE k = 1")
def youden_cutoff(spark, sf):
    return rounded(ev.youden(scored(spark, sf)), "cutoff", "youden")


@query("confusion", """WITH x AS (SELECT source, coalesce(toxic, 0) AS label, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS predicted FROM documents JOIN labels USING (doc_id)),
c AS (SELECT source, count(*) FILTER (label = 1 AND predicted = 1) AS tp, count(*) FILTER (label <> 1 AND predicted = 1) AS fp, count(*) FILTER (label <> 1 AND predicted <> 1) AS tn, count(*) FILTER (label = 1 AND predicted <> 1) AS fn FROM x GROUP BY source)
SELECT source, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 8) AS accuracy, round(tp / nullif(tp + fn, 0), 8) AS sensitivity, round(tn / nullif(tn + fp, 0), 8) AS specificity, round(tp / nullif(tp + fp, 0), 8) AS ppv, round(tn / nullif(tn + fn, 0), 8) AS npv, round(2 * tp / nullif(2 * tp + fp + fn, 0), 8) AS f1 FROM c""")
def confusion(spark, sf):
    x = fx.table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(fx.table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    x = x.select("source", F.coalesce("toxic", F.lit(0)).alias("label"), F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("predicted"))
    return rounded(ev.confusion(x, ("source",)), "accuracy", "sensitivity", "specificity", "ppv", "npv", "f1")


@query("symmetrical_uncertainty", f"""WITH {FEATURES}, s AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM feat GROUP BY feature),
b AS (SELECT feature, class, least(floor((value - lo) / (hi - lo) * 4), 3) AS bin, count(*) AS n FROM feat JOIN s USING (feature) GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS total FROM b),
xy AS (SELECT feature, -sum(n / total * log2(n / total)) AS h FROM c GROUP BY feature),
x AS (SELECT feature, -sum(n / total * log2(n / total)) AS h FROM (SELECT feature, bin, sum(n) AS n, max(total) AS total FROM c GROUP BY ALL) GROUP BY feature),
y AS (SELECT feature, -sum(n / total * log2(n / total)) AS h FROM (SELECT feature, class, sum(n) AS n, max(total) AS total FROM c GROUP BY ALL) GROUP BY feature)
SELECT feature, round(2 * (x.h + y.h - xy.h) / (x.h + y.h), 8) AS su, round(x.h + y.h - xy.h, 8) AS gain FROM xy JOIN x USING (feature) JOIN y USING (feature)""")
def symmetrical_uncertainty(spark, sf):
    return rounded(ev.symmetrical_uncertainty(fx.feature_matrix(spark, sf)), "su", "gain")


@query("best_signature_proposals", f"WITH {BENCH}, a AS (SELECT method, avg(value) FILTER (split = 'train') AS train, avg(value) FILTER (split = 'test') AS test, avg(value) FILTER (split = 'valid') AS valid FROM bench WHERE metric = 'Accuracy' GROUP BY method) SELECT method, {r('train', 'test', 'valid')}, round(3 / (1 / train + 1 / test + 1 / valid), 8) AS metaindex FROM a")
def best_signature_proposals(spark, sf):
    return rounded(ev.proposals(fx.benchmark_long(spark, sf)), "train", "test", "valid", "metaindex")


@query("best_signature_meta11", f"WITH {BENCH} SELECT method, round(avg(value) FILTER (metric = 'Sensitivity') + avg(value) FILTER (metric = 'Specificity') - 1, 8) AS metaindex FROM bench WHERE split = 'valid' GROUP BY method")
def best_signature_meta11(spark, sf):
    return rounded(ev.proposals_youden(fx.benchmark_long(spark, sf)), "metaindex")


@query("leaderboard", f"WITH {BENCH}, a AS (SELECT method, algorithm, max(value) FILTER (split = 'train') AS train, max(value) FILTER (split = 'test') AS test, max(value) FILTER (split = 'valid') AS valid FROM bench WHERE metric = 'Accuracy' GROUP BY ALL) SELECT method, algorithm, {r('train', 'test', 'valid')}, round(3 / (1 / train + 1 / test + 1 / valid), 8) AS metaindex, round((train + test + valid) / 3, 8) AS metaindex2 FROM a WHERE train IS NOT NULL AND test IS NOT NULL AND valid IS NOT NULL")
def leaderboard(spark, sf):
    return rounded(ev.leaderboard(fx.benchmark_long(spark, sf)), "train", "test", "valid", "metaindex", "metaindex2")


@query("hyperparameter_grid", """SELECT s_suppkey AS study, CAST(layer1 AS INTEGER) AS layer1, CAST(layer2 AS INTEGER) AS layer2, activation, dropout, optimizer, balanced FROM
supplier, (SELECT unnest(range(3, 12)) AS layer1), (SELECT unnest([0, 3, 5]) AS layer2), (VALUES ('relu'), ('sigmoid'), ('selu')) a(activation), (VALUES (0.0::DOUBLE), (0.1::DOUBLE)) d(dropout), (VALUES ('adam'), ('sgd')) o(optimizer), (VALUES (true), (false)) b(balanced)""")
def hyperparameter_grid(spark, sf):
    """The networks of a grid, for every study."""
    return ev.grid(fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("study")), layer1=list(range(3, 12)), layer2=[0, 3, 5], activation=["relu", "sigmoid", "selu"], dropout=[0.0, 0.1], optimizer=["adam", "sgd"], balanced=[True, False])


@query("probe_pivot", """SELECT l_partkey % 50 AS probe, sum(l_quantity) FILTER (l_returnflag = 'A') AS "A", sum(l_quantity) FILTER (l_returnflag = 'N') AS "N", sum(l_quantity) FILTER (l_returnflag = 'R') AS "R" FROM lineitem GROUP BY 1""")
def probe_pivot(spark, sf):
    return fx.table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 50).alias("probe")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))


@query("newest_version", "WITH k AS (SELECT o_custkey AS file_name, o_orderkey AS archive, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 7 DESC, o_orderkey % 11 DESC, o_orderkey DESC) AS r FROM orders) SELECT file_name, archive FROM k WHERE r = 1")
def newest_version(spark, sf):
    o = F.col("o_orderkey")
    newest = F.max_by(o, F.struct(o % 7, o % 11, o))  # aggregated map-side: no window over a file's versions
    return fx.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("file_name")).agg(newest.alias("archive"))
