"""Queries of the smaller table operations, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from helixmill.operators import evaluation as ev
from helixmill.operators import tables
from helixmill.plans.catalog import BENCH, FEATURES, SIGS, query, rounded, signatures_of
from helixmill.sources import fixtures as fx


@query("rbind_fill", "SELECT CAST(c_custkey AS BIGINT) AS id, c_acctbal AS balance, c_mktsegment AS segment, CAST(NULL AS BIGINT) AS nation FROM customer UNION ALL SELECT CAST(s_suppkey AS BIGINT), s_acctbal, NULL, CAST(s_nationkey AS BIGINT) FROM supplier")
def rbind_fill(spark, sf):
    customers = fx.table(spark, sf, "customer").select(F.col("c_custkey").cast("bigint").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return tables.stack(customers, fx.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("bigint").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("bigint").alias("nation")))


@query("barcode_parts", "WITH b AS (SELECT o_orderkey, 'TCGA-' || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || '-' || lpad(CAST(o_orderkey % 14 AS VARCHAR), 2, '0') || 'A' AS barcode FROM orders) SELECT o_orderkey, substr(barcode, 1, 12) AS participant, CAST(substr(split_part(barcode, '-', 4), 1, 2) AS INTEGER) AS sample_type, CAST(substr(split_part(barcode, '-', 4), 1, 2) AS INTEGER) < 10 AS tumour FROM b")
def barcode_parts(spark, sf):
    part = lambda c, n: F.lpad(c.cast("string"), n, "0")
    barcode = F.concat_ws("-", F.lit("TCGA"), part(F.col("o_custkey") % 100, 2), part(F.col("o_orderkey") % 10000, 4), F.concat(part(F.col("o_orderkey") % 14, 2), F.lit("A")))
    return fx.table(spark, sf, "orders").select("o_orderkey", *tables.barcode_parts(barcode))


@query("known_symbols", "SELECT p_partkey, p_brand AS symbol, CAST(p_partkey AS VARCHAR) AS gene_id FROM part WHERE p_partkey % 7 <> 0")
def known_symbols(spark, sf):
    gene = F.concat_ws("|", F.when(F.col("p_partkey") % 7 == 0, "?").otherwise(F.col("p_brand")), F.col("p_partkey").cast("string"))
    return tables.known_symbols(fx.table(spark, sf, "part").select("p_partkey", gene.alias("gene")), "gene").drop("gene")


@query("agreeing_probes", "SELECT l_returnflag, l_partkey, count(*) AS n, count(DISTINCT l_linestatus) = 1 AS agree FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def agreeing_probes(spark, sf):
    return tables.agreeing_probes(fx.table(spark, sf, "lineitem"), "l_returnflag", "l_partkey", "l_linestatus")


@query("union_pivot", """SELECT l_suppkey AS probe, sum(l_quantity) FILTER (l_returnflag = 'A') AS "A_reads", count(*) FILTER (l_returnflag = 'A') AS "A_rows", sum(l_quantity) FILTER (l_returnflag = 'R') AS "R_reads", count(*) FILTER (l_returnflag = 'R') AS "R_rows", sum(l_quantity) FILTER (l_returnflag = 'N') AS "N_reads", count(*) FILTER (l_returnflag = 'N') AS "N_rows" FROM lineitem GROUP BY 1""")
def union_pivot(spark, sf):
    """Two values a file over the union of probes."""
    wide = fx.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("probe")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity").alias("reads"), F.count("l_suppkey").alias("rows"))
    return wide.fillna(0, ["A_rows", "N_rows", "R_rows"])


@query("without_partial", f"WITH {FEATURES}, f AS (SELECT DISTINCT feature FROM feat), h AS (SELECT feature, p, count(*) OVER (PARTITION BY p) AS n FROM f, (VALUES ('hsa.f0'), ('hsa.f63'), ('hsa.f07'), ('miR')) t(p) WHERE starts_with(feature, p)) SELECT feature FROM f WHERE feature NOT IN (SELECT feature FROM h WHERE n = 1 OR feature = p)")
def without_partial(spark, sf):
    return tables.without_partial(fx.feature_matrix(spark, sf).select("feature").distinct(), ["hsa.f0", "hsa.f63", "hsa.f07", "miR"])


@query("membership", f"WITH {SIGS} SELECT method, count(DISTINCT feature) FILTER (feature IN ('hsa.f00', 'hsa.f01', 'hsa.f02')) > 0 AS has_any, count(DISTINCT feature) FILTER (feature IN ('hsa.f00', 'hsa.f01', 'hsa.f02')) = 3 AS has_all FROM signatures GROUP BY method")
def membership(spark, sf):
    return tables.membership(signatures_of(spark, sf), ["hsa.f00", "hsa.f01", "hsa.f02"])


@query("diverging_breaks", f"WITH {FEATURES}, e AS (SELECT feature, least(min(value), 0) AS lo, greatest(max(value), 0) AS hi FROM feat GROUP BY feature) SELECT feature, CAST(i AS INTEGER) AS i, round(CASE WHEN i <= 50 THEN lo - lo * i / 50 ELSE hi * (i - 50) / 50 END, 8) AS at FROM e, range(101) t(i)")
def diverging_breaks(spark, sf):
    return rounded(tables.diverging_breaks(fx.feature_matrix(spark, sf)), "at")


@query("distances", f"WITH {FEATURES} SELECT a.feature AS feature_a, b.feature AS feature_b, round(sqrt(sum((a.value - b.value) * (a.value - b.value))), 7) AS distance FROM feat a JOIN feat b ON a.sample_id = b.sample_id AND a.feature < b.feature GROUP BY ALL")
def distances(spark, sf):
    return rounded(tables.distances(fx.feature_matrix(spark, sf)), "distance", digits=7)


@query("fisher_pairs", f"""WITH {FEATURES}, s AS (SELECT a.feature AS fa, b.feature AS fb, a.class, count(*) AS n, avg(a.value) AS mx, avg(b.value) AS my, var_samp(a.value) AS vx, var_samp(b.value) AS vy, covar_samp(a.value, b.value) AS c FROM feat a JOIN feat b ON a.sample_id = b.sample_id AND a.feature < b.feature GROUP BY ALL),
p AS (SELECT k.fa, k.fb, k.mx - o.mx AS dx, k.my - o.my AS dy, ((k.n - 1) * k.vx + (o.n - 1) * o.vx) / (k.n + o.n - 2) AS a, ((k.n - 1) * k.vy + (o.n - 1) * o.vy) / (k.n + o.n - 2) AS b, ((k.n - 1) * k.c + (o.n - 1) * o.c) / (k.n + o.n - 2) AS c FROM s k JOIN s o ON k.fa = o.fa AND k.fb = o.fb AND k.class = 'Case' AND o.class <> 'Case')
SELECT fa AS feature_a, fb AS feature_b, round((dx * dx * b - 2 * dx * dy * c + dy * dy * a) / (a * b - c * c), 7) AS criterion FROM p""")
def fisher_pairs(spark, sf):
    return rounded(tables.fisher_pairs(fx.feature_matrix(spark, sf)), "criterion", digits=7)


@query("wx_scores", f"WITH {FEATURES}, m AS (SELECT class, feature, avg(value) AS m, CASE WHEN class = 'Case' THEN 1 ELSE -0.5::DOUBLE END * (1 + CAST(substr(feature, 6, 2) AS INTEGER) % 5) AS w FROM feat GROUP BY class, feature) SELECT a.feature, round(sum(abs(a.m * (a.w - b.w))), 8) AS score FROM m a JOIN m b ON a.feature = b.feature AND a.class <> b.class GROUP BY a.feature")
def wx_scores(spark, sf):
    long = fx.feature_matrix(spark, sf)
    weight = F.when(F.col("class") == "Case", 1.0).otherwise(-0.5) * (1 + F.substring("feature", 6, 2).cast("int") % 5)
    return rounded(tables.wx_scores(long, long.select("class", "feature").distinct().withColumn("weight", weight)), "score")


@query("correlated_with_class", f"WITH {FEATURES}, c AS (SELECT feature, corr(value, CASE WHEN class = 'Case' THEN 1.0::DOUBLE ELSE 0 END) AS r FROM feat GROUP BY feature) SELECT feature, round(r, 8) AS r FROM c WHERE abs(r) >= 0.05")
def correlated_with_class(spark, sf):
    return rounded(tables.correlated_with_class(fx.feature_matrix(spark, sf), 0.05), "r")


@query("ensemble_weights", "SELECT l_partkey, CAST(sum(l_quantity) AS DOUBLE) / (1 + count(l_quantity)) AS weight FROM lineitem GROUP BY l_partkey")
def ensemble_weights(spark, sf):
    return tables.ensemble_weights(fx.table(spark, sf, "lineitem"), "l_partkey", "l_quantity")


@query("unfinished", "SELECT p_partkey + 1 AS cell, CAST(p_partkey // 250 AS BIGINT) AS batch FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def unfinished(spark, sf):
    """Parts, as cells numbered from 1, are done once a line has fifty of them."""
    done = fx.table(spark, sf, "lineitem").where("l_quantity = 50").select((F.col("l_partkey") + 1).alias("cell"))
    return tables.unfinished(fx.table(spark, sf, "part").select((F.col("p_partkey") + 1).alias("cell")), done, "cell")


@query("worth_saving", f"""WITH {BENCH}, a AS (SELECT method, algorithm, max(value) FILTER (split = 'train') AS train, max(value) FILTER (split = 'test') AS test, max(value) FILTER (split = 'valid') AS valid FROM bench WHERE metric = 'Accuracy' GROUP BY ALL),
m AS (SELECT method, algorithm, 3 / (1 / train + 1 / test + 1 / valid) AS metaindex FROM a WHERE train > 0.7 AND test > 0.6)
SELECT method, algorithm, round(metaindex, 8) AS metaindex, CAST(row_number() OVER (ORDER BY round(metaindex, 10) DESC, method, algorithm) AS INTEGER) AS rank FROM m""")
def worth_saving(spark, sf):
    return rounded(tables.worth_saving(ev.leaderboard(fx.benchmark_long(spark, sf)), 0.7, 0.6).select("method", "algorithm", "metaindex", "rank"), "metaindex")


@query("model_grid", "SELECT method, algorithm, row_number() OVER (ORDER BY method, algorithm) AS cell FROM (SELECT DISTINCT 'sig' || CAST(o_custkey % 12 AS VARCHAR) AS method FROM orders), (VALUES ('mlp'), ('rf'), ('svmLinear'), ('rpart')) a(algorithm)")
def model_grid(spark, sf):
    """Formulas by algorithms, numbered: the cells of a benchmark."""
    methods = fx.table(spark, sf, "orders").select(F.concat(F.lit("sig"), (F.col("o_custkey") % 12).cast("string")).alias("method")).distinct()
    cells = methods.select("method", F.explode(F.array(*[F.lit(x) for x in ("mlp", "rf", "svmLinear", "rpart")])).alias("algorithm"))
    return cells.withColumn("cell", F.row_number().over(Window.orderBy("method", "algorithm")).cast("bigint"))
