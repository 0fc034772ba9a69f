"""Queries of balancing, batch correction, ranking by folds, association and heat maps, with their SQL; and of the fitted models, which SQL does not express."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from helixmill.operators import assembly, expression, models, tables, transforms, wrappers
from helixmill.plans.catalog import AUC, FEATURES, ORACLES, query, r, rounded, t_p
from helixmill.sources import fixtures as fx


def u(*parts: str) -> str:
    return "(CAST('0x' || substr(md5(" + " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "), 1, 7) AS BIGINT) / 268435456.0::DOUBLE)"


SIZES = FEATURES + ", per AS (SELECT class, count(DISTINCT sample_id) AS n FROM feat GROUP BY class)"


@query("smote", f"""WITH {SIZES}, minor AS (SELECT class, n, CAST(ceil(((SELECT max(n) FROM per) - n) / n) AS BIGINT) AS each FROM per ORDER BY n, class LIMIT 1),
own AS (SELECT f.* FROM feat f JOIN minor USING (class)),
dist AS (SELECT a.sample_id, b.sample_id AS other, sum((a.value - b.value) * (a.value - b.value)) AS d FROM own a JOIN own b ON a.feature = b.feature AND a.sample_id <> b.sample_id GROUP BY ALL),
near AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY d, other) AS k FROM dist QUALIFY k <= 5),
draws AS (SELECT sample_id, draw, 1 + floor({u("1", "'near'", "sample_id", "draw")} * (SELECT least(5, n - 1) FROM minor)) AS k, {u("1", "'gap'", "sample_id", "draw")} AS gap FROM (SELECT DISTINCT sample_id FROM own), (SELECT unnest(range(1, each + 1)) AS draw FROM minor))
SELECT d.sample_id, CAST(draw AS INTEGER) AS draw, a.class, a.feature, round(a.value + gap * (b.value - a.value), 8) AS value FROM draws d JOIN near USING (sample_id, k) JOIN own a ON a.sample_id = d.sample_id JOIN own b ON b.sample_id = near.other AND b.feature = a.feature""")
def smote(spark, sf):
    return rounded(transforms.smote(fx.feature_matrix(spark, sf)), "value")


@query("rose", f"""WITH {SIZES}, kern AS (SELECT class, feature, pow(4.0::DOUBLE / (66 * count(value)), 1.0::DOUBLE / 68) * stddev_samp(value) AS h FROM feat GROUP BY ALL),
drawn AS (SELECT f.*, unnest(range(1, CAST(floor(2000::DOUBLE / 2 / n + {u("1", "'copies'", "sample_id")}) AS BIGINT) + 1)) AS draw FROM feat f JOIN per USING (class))
SELECT sample_id, CAST(draw AS INTEGER) AS draw, class, feature, round(value + h * sqrt(-2 * ln(1 - {u("1", "'u'", "sample_id", "draw", "feature")})) * cos(2 * pi() * {u("1", "'v'", "sample_id", "draw", "feature")}), 7) AS value FROM drawn JOIN kern USING (class, feature)""")
def rose(spark, sf):
    return rounded(transforms.rose(fx.feature_matrix(spark, sf), 2000), "value", digits=7)


BATCHED = FEATURES + ", bat AS (SELECT sample_id, sample_id % 3 AS batch, class, feature, value * (1 + (sample_id % 3) * 0.25::DOUBLE) + (sample_id % 3) * 0.5::DOUBLE AS value FROM feat)"


def batched(spark, sf):
    shift = F.col("sample_id") % 3
    return fx.feature_matrix(spark, sf).select("sample_id", shift.alias("batch"), "class", "feature", (F.col("value") * (1 + shift * 0.25) + shift * 0.5).alias("value"))


@query("combat", f"""WITH RECURSIVE {BATCHED}, cells AS (SELECT feature, batch, count(*) AS n, avg(value) AS mean, var_samp(value) AS var FROM bat GROUP BY ALL),
pooled AS (SELECT *, sum(n * mean) OVER f / sum(n) OVER f AS grand, sum((n - 1) * var) OVER f / sum(n) OVER f AS vp FROM cells WINDOW f AS (PARTITION BY feature)),
hats AS (SELECT feature, batch, n, grand, sqrt(vp) AS sd, (mean - grand) / sqrt(vp) AS gh, var / vp AS dh FROM pooled),
prior AS (SELECT batch, avg(gh) AS gbar, var_samp(gh) AS t2, avg(dh) AS m, var_samp(dh) AS s2 FROM hats GROUP BY batch),
it AS (SELECT h.*, gbar, t2, (2 * s2 + m * m) / s2 AS a, (m * s2 + m * m * m) / s2 AS b, gh AS g, dh AS d, 0 AS k FROM hats h JOIN prior USING (batch)
  UNION ALL SELECT feature, batch, n, grand, sd, gh, dh, gbar, t2, a, b, (t2 * n * gh + d * gbar) / (t2 * n + d), (((n - 1) * dh + n * pow(gh - (t2 * n * gh + d * gbar) / (t2 * n + d), 2)) / 2 + b) / (n / 2 + a - 1), k + 1 FROM it WHERE k < 50)
SELECT sample_id, bat.batch, class, bat.feature, round(((value - grand) / sd - g) / sqrt(d) * sd + grand, 7) AS value FROM bat JOIN it ON it.feature = bat.feature AND it.batch = bat.batch AND k = 50""")
def combat(spark, sf):
    return rounded(transforms.combat(batched(spark, sf)), "value", digits=7)


#: Class differences by regression within batches, and the table without them.
REST = """slope AS (SELECT feature, coalesce(regr_slope(v, x), 0) AS slope FROM (SELECT feature, value - avg(value) OVER w AS v, x - avg(x) OVER w AS x FROM (SELECT *, CASE WHEN class = 'Case' THEN 1.0::DOUBLE ELSE 0 END AS x FROM bat) WINDOW w AS (PARTITION BY feature, batch)) GROUP BY feature),
rest AS (SELECT sample_id, batch, class, feature, CASE WHEN class = 'Case' THEN slope ELSE 0 END AS part, value - part AS value FROM bat JOIN slope USING (feature)), cells AS ("""


@query("combat_class", ORACLES["combat"].replace("FROM bat ", "FROM rest ").replace("bat.", "rest.").replace("cells AS (", REST, 1).replace("+ grand, 7)", "+ grand + part, 7)"))
def combat_class(spark, sf):
    return rounded(transforms.combat(batched(spark, sf), by_class=True), "value", digits=7)


FOLDED = AUC.replace("g AS (SELECT feature, value AS score", "g AS (SELECT fold.f, feature, value AS score").replace("FROM feat GROUP BY ALL)", "FROM feat, range(5) fold(f) WHERE sample_id % 5 <> f GROUP BY ALL)").replace("roc AS (SELECT feature", "roc AS (SELECT f, feature").replace("PARTITION BY feature", "PARTITION BY f, feature")


@query("classloop", f"""WITH {FOLDED}, s AS (SELECT f, feature, sum(p * (neg - fp + n / 2) / neg) / max(pos) AS a FROM roc GROUP BY ALL), k AS (SELECT f, feature, greatest(a, 1 - a) AS auc, row_number() OVER (PARTITION BY f ORDER BY round(greatest(a, 1 - a), 10) DESC, feature) AS k FROM s)
SELECT feature, count(*) AS n_folds, round(avg(auc), 8) AS mean_auc FROM k WHERE k <= 11 GROUP BY feature""")
def classloop(spark, sf):
    return rounded(transforms.fold_ranking(fx.feature_matrix(spark, sf), F.col("sample_id") % 5, 11), "mean_auc")


@query("chi_squared", """WITH t AS (SELECT c_mktsegment AS r, c_nationkey % 4 = 0 AS c FROM customer), o AS (SELECT r, c, count(*) AS o FROM t GROUP BY ALL), nr AS (SELECT r, count(*) AS nr FROM t GROUP BY r), nc AS (SELECT c, count(*) AS nc FROM t GROUP BY c), k AS (SELECT count(*) AS n FROM t),
e AS (SELECT n, nr * nc / n AS e, abs(coalesce(o, 0) - nr * nc / n) AS off FROM nr CROSS JOIN nc CROSS JOIN k LEFT JOIN o USING (r, c)), f AS (SELECT ((SELECT count(*) FROM nr) - 1) * ((SELECT count(*) FROM nc) - 1) AS df),
s AS (SELECT n, df, sum(pow(CASE WHEN df = 1 THEN off - least(0.5, off) ELSE off END, 2) / e) AS x FROM e, f GROUP BY n, df)
SELECT n, df, round(x, 7) AS statistic, round(exp(-x / 2) * list_sum(list_transform(range(0, df // 2), lambda i: pow(x / 2, i) / gamma(i + 1))), 9) AS p_value FROM s""")
def chi_squared(spark, sf):
    t = fx.table(spark, sf, "customer").select("c_mktsegment", (F.col("c_nationkey") % 4 == 0).alias("case"))
    return rounded(rounded(transforms.chi_squared(t, "c_mktsegment", "case"), "statistic", digits=7), "p_value", digits=9)


@query("class_balance", "WITH c AS (SELECT count(*) AS n, count(*) FILTER (label = 0) AS cases FROM embeddings), t AS (SELECT *, least(cases, n - cases) AS few FROM c) SELECT n, cases, round(least(1, 2 * list_sum(list_transform(range(0, few + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))), 9) AS p_value FROM t")
def class_balance(spark, sf):
    """Are cases as many as controls? Exact binomial test."""
    return rounded(transforms.balance(fx.table(spark, sf, "embeddings").select(F.when(F.col("label") == 0, "Case").otherwise("Control").alias("class"))), "p_value", digits=9)


@query("association", f"""WITH {FEATURES}, k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rank FROM feat), x AS (SELECT sample_id, value AS x, rank AS rx FROM k WHERE feature = 'hsa.f00'),
a AS (SELECT feature, count(*) AS n, corr(value, x) AS pearson, corr(rank, rx) AS spearman, regr_slope(value, x) AS slope, regr_intercept(value, x) AS intercept, 1 - (1 - pow(corr(value, x), 2)) * (count(*) - 1) / (count(*) - 2) AS adjusted_r2 FROM k JOIN x USING (sample_id) WHERE feature <> 'hsa.f00' GROUP BY feature)
SELECT feature, n, {r('pearson', 'spearman', 'slope', 'intercept', 'adjusted_r2')}, round({t_p('pearson * sqrt((n - 2.0::DOUBLE) / (1 - pearson * pearson))', '(n - 2.0::DOUBLE)')}, 7) AS pearson_p, round({t_p('spearman * sqrt((n - 2.0::DOUBLE) / (1 - spearman * spearman))', '(n - 2.0::DOUBLE)')}, 7) AS spearman_p FROM a""")
def association(spark, sf):
    found = rounded(transforms.association(fx.feature_matrix(spark, sf), "hsa.f00"), "pearson", "spearman", "slope", "intercept", "adjusted_r2")
    return rounded(found, "pearson_p", "spearman_p", digits=7)


@query("heat_map", f"""WITH {FEATURES}, m AS (SELECT feature, avg(value) AS a, stddev_samp(value) AS s FROM feat GROUP BY feature), z AS (SELECT sample_id, class, feature, least(greatest((value - a) / s, -2.0::DOUBLE), 2.0::DOUBLE) AS z FROM feat JOIN m USING (feature))
SELECT sample_id, class, feature, round(z, 7) AS z, CAST(least(floor((z + 2) / (2.0::DOUBLE / 50)) + 1, 100) AS INTEGER) AS bin FROM z""")
def heat_map(spark, sf):
    return rounded(transforms.heat_map(fx.feature_matrix(spark, sf)), "z", digits=7)


@query("lasso")
def lasso(spark, sf):
    return models.lasso(fx.feature_matrix(spark, sf))


@query("wx")
def wx(spark, sf):
    return models.wx(fx.feature_matrix(spark, sf))


@query("forest_importance")
def forest_importance(spark, sf):
    return models.forest_importance(fx.feature_matrix(spark, sf))


@query("pca_scores")
def pca_scores(spark, sf):
    return models.pca_scores(fx.feature_matrix(spark, sf))


def renamed(spark, sf):
    """One alias row for two features in three: the feature's name, the next one's, and a blank."""
    f = lambda i: F.concat(F.lit("hsa.f"), F.lpad(i.cast("string"), 2, "0"))
    aliases = spark.range(64).where("id % 3 <> 2").select(F.col("id").alias("ord"), F.array(f(F.col("id")), f(F.col("id") + 1), F.lit("")).alias("aliases"))
    return assembly.correct_names(fx.feature_matrix(spark, sf).select("feature").distinct(), aliases)


@query("correct_names", """WITH RECURSIVE a AS (SELECT i AS ord, 'hsa.f' || lpad(CAST(i AS VARCHAR), 2, '0') AS alias, 'hsa.f' || lpad(CAST(i + 1 AS VARCHAR), 2, '0') AS "to" FROM range(64) t(i) WHERE i % 3 <> 2),
n AS (SELECT 'hsa.f' || lpad(CAST(i AS VARCHAR), 2, '0') AS feature, 'hsa.f' || lpad(CAST(i AS VARCHAR), 2, '0') AS corrected, -1::BIGINT AS at, 0 AS k FROM range(64) t(i)
  UNION ALL SELECT feature, a."to", a.ord, k + 1 FROM n JOIN a ON a.alias = n.corrected AND a.ord > n.at)
SELECT feature, max_by(corrected, k) AS corrected FROM n GROUP BY feature""")
def correct_names(spark, sf):
    return renamed(spark, sf)


@query("site_lookup", "SELECT s_suppkey, l.n_name FROM supplier LEFT JOIN (SELECT n_nationkey % 20 AS s_nationkey, min_by(n_name, n_nationkey) AS n_name FROM nation GROUP BY 1) l USING (s_nationkey)")
def site_lookup(spark, sf):
    sites = fx.table(spark, sf, "nation").select((F.col("n_nationkey") % 20).alias("s_nationkey"), "n_name", "n_nationkey")
    return assembly.first_match(fx.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), sites, "s_nationkey", "n_name", "n_nationkey").select("s_suppkey", "n_name")


@query("probe_sets", "WITH p AS (SELECT DISTINCT l_linestatus || l_returnflag AS file, l_partkey AS probe FROM lineitem) SELECT file, count(*) AS n_probes, count(*) = (SELECT count(DISTINCT probe) FROM p) AS complete FROM p GROUP BY file")
def probe_sets(spark, sf):
    return assembly.probe_sets(fx.table(spark, sf, "lineitem").select(F.concat("l_linestatus", "l_returnflag").alias("file"), F.col("l_partkey").alias("probe")), "file", "probe")


@query("assembled", """WITH c AS (SELECT l_suppkey AS sample_id, p_brand AS feature, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
m AS (SELECT sample_id, feature, CASE WHEN sample_id % 23 <> length(feature) THEN CAST(n AS DOUBLE) END AS value FROM c), a AS (SELECT feature, median(value) AS fill FROM m GROUP BY feature HAVING count(*) FILTER (value IS NULL) < 0.1 * count(*)),
f AS (SELECT sample_id, feature, coalesce(value, fill) AS value FROM m JOIN a USING (feature)), t AS (SELECT *, value / sum(value) OVER (PARTITION BY sample_id) * 1e6::DOUBLE AS cpm FROM f)
SELECT sample_id, feature, round(value, 6) AS value, round(log10(cpm + 0.001::DOUBLE), 7) AS log10tpm FROM t WHERE feature IN (SELECT feature FROM t GROUP BY feature HAVING var_samp(log10(cpm + 0.001::DOUBLE)) > 0)""")
def assembled(spark, sf):
    counts = fx.count_matrix(spark, sf).withColumn("value", F.when(F.col("sample_id") % 23 != F.length("feature"), F.col("value").cast("double")))
    return rounded(rounded(assembly.assemble(counts).select("sample_id", "feature", "value", "log10tpm"), "value", digits=6), "log10tpm", digits=7)


@query("feature_votes", f"""WITH {FEATURES}, d AS (SELECT sample_id % 7 AS run, feature, abs(avg(value) FILTER (class = 'Case') - avg(value) FILTER (class <> 'Case')) AS d FROM feat GROUP BY ALL),
k AS (SELECT run, feature, row_number() OVER (PARTITION BY run ORDER BY round(d, 10) DESC NULLS LAST, feature) AS rank FROM d),
v AS (SELECT size, feature, count(*) AS votes FROM k, range(3, 12) s(size) WHERE rank <= size GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY votes DESC, feature) AS r FROM v) SELECT CAST(size AS INTEGER) AS size, feature, votes FROM w WHERE r <= size""")
def feature_votes(spark, sf):
    value = lambda case: F.avg(F.when(F.col("class") == "Case" if case else F.col("class") != "Case", F.col("value")))
    gaps = fx.feature_matrix(spark, sf).groupBy((F.col("sample_id") % 7).alias("run"), "feature").agg(F.abs(value(True) - value(False)).alias("d"))
    ranked = gaps.withColumn("rank", F.row_number().over(Window.partitionBy("run").orderBy(F.desc_nulls_last(F.round("d", 10)), "feature")))
    return assembly.feature_votes(ranked, range(3, 12))


@query("describe_by_group", """SELECT source, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS sd, min(n_chars) AS min, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS q2, quantile_cont(n_chars, 0.75) AS q3, max(n_chars) AS max FROM documents GROUP BY source""")
def describe_by_group(spark, sf):
    n = "n_chars"
    figures = [F.count(n).alias("n"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_samp(n), 6).alias("sd"), F.min(n).alias("min"), *[F.percentile(n, q / 4).alias(f"q{q}") for q in (1, 2, 3)], F.max(n).alias("max")]
    return fx.table(spark, sf, "documents").groupBy("source").agg(*figures)


@query("forward_cfs")
def forward_cfs(spark, sf):
    return models.forward_cfs(fx.feature_matrix(spark, sf))


@query("recursive_elimination")
def recursive_elimination(spark, sf):
    return models.recursive_elimination(fx.feature_matrix(spark, sf), 11)


@query("benchmark")
def benchmark(spark, sf):
    """Two signatures by three algorithms, with metrics on each part of the split."""
    long = fx.feature_matrix(spark, sf)
    split = expression.stratified_split(long.select("sample_id", "class").distinct()).select("sample_id", "mix")
    formulas = {m: [f"hsa.f{i:02d}" for i in ids] for m, ids in (("first", range(11)), ("last", range(53, 64)))}
    return models.benchmark(long.join(split, "sample_id"), formulas)


@query("undersampled", f"WITH {SIZES} SELECT sample_id, class, count(*) AS n_features FROM feat WHERE class = 'Case' OR {u('1', chr(39) + 'under' + chr(39), 'sample_id')} < 2.0::DOUBLE * (SELECT n FROM per WHERE class = 'Case') / (SELECT n FROM per WHERE class <> 'Case') GROUP BY ALL")
def undersampled(spark, sf):
    """The under-sampled majority of classic SMOTE at 200 and 100 %: as many rows as there are synthetic ones."""
    long = fx.feature_matrix(spark, sf)
    return transforms.undersample(long, "Case", 2 * transforms.class_sizes(long).get("Case", 0)).groupBy("sample_id", "class").agg(F.count("*").alias("n_features"))


def split_matrix(spark, sf):
    long = fx.feature_matrix(spark, sf)
    return long.join(expression.stratified_split(long.select("sample_id", "class").distinct()).select("sample_id", "mix"), "sample_id")


@query("step_aic")
def step_aic(spark, sf):
    return wrappers.backward_logit(fx.feature_matrix(spark, sf))


@query("stepwise_p")
def stepwise_p(spark, sf):
    return wrappers.backward_logit(fx.feature_matrix(spark, sf), "p")


@query("boruta")
def boruta(spark, sf):
    return wrappers.boruta(fx.feature_matrix(spark, sf))


@query("forward_wrapper")
def forward_wrapper(spark, sf):
    return wrappers.forward_wrapper(fx.feature_matrix(spark, sf), F.col("sample_id") % 3, 2)


@query("propensity_match")
def propensity_match(spark, sf):
    customers = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), (F.col("c_custkey") % 4 == 0).cast("int").alias("label"), F.col("c_acctbal").cast("double").alias("balance"), "c_nationkey")
    return wrappers.matched(customers, ["balance", "c_nationkey"])


@query("feature_clusters")
def feature_clusters(spark, sf):
    return wrappers.feature_clusters(tables.distances(fx.feature_matrix(spark, sf)), 8)


@query("network_grid")
def network_grid(spark, sf):
    return wrappers.network_grid(split_matrix(spark, sf), [[3], [5], [5, 3]])
