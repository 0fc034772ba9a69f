"""Queries of predicates, lookups, selections and stored tables, with their SQL. Stored tables are written to a new folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.operators import evaluation as ev
from helixmill.operators import expression as ex
from helixmill.operators import preparation as pr
from helixmill.plans.catalog import AUC, BENCH, COUNTS, DE, FEATURES, MISSING, ORACLES, SIGS, query, rounded, scored, signatures_of
from helixmill.sources import fixtures as fx
from helixmill.sources import stores

_CLASS = "CASE WHEN label = 0 THEN 'Case' ELSE 'Control' END"


def samples(spark, sf):
    return fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), F.when(F.col("label") == 0, "Case").otherwise("Control").alias("class"))


@query("label_sets", f"SELECT vec_id % 4 AS grp, count(DISTINCT {_CLASS}) = 2 AS equal FROM embeddings GROUP BY 1")
def label_sets(spark, sf):
    return pr.label_set_is(samples(spark, sf).withColumn("grp", F.col("sample_id") % 4), ("Control", "Case"), ("grp",))


@query("same_sets", "WITH a AS (SELECT DISTINCT l_partkey k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey k FROM lineitem WHERE l_returnflag = 'R'), f AS (SELECT a.k AS ak, b.k AS bk FROM a FULL JOIN b ON a.k = b.k) SELECT count(*) FILTER (ak IS NOT NULL AND bk IS NOT NULL) AS n_both, count(*) FILTER (bk IS NULL) AS n_a, count(*) FILTER (ak IS NULL) AS n_b, count(*) FILTER (ak IS NULL OR bk IS NULL) = 0 AS equal FROM f")
def same_sets(spark, sf):
    lines = fx.table(spark, sf, "lineitem")
    return pr.same_sets(lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'R'"), "l_partkey")


@query("cohort", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND regexp_matches(c_name, '[02468]$')")
def cohort(spark, sf):
    return pr.cohort(fx.table(spark, sf, "customer"), {"c_mktsegment": "BUILDING"}, {"c_name": "[02468]$"}).select("c_custkey")


@query("platforms", "SELECT doc_id, CASE WHEN n_chars < 2300 THEN 'old' WHEN n_chars >= 2300 THEN 'new' END AS platform FROM documents")
def platforms(spark, sf):
    return pr.by_size(fx.table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", 2300).select("doc_id", "platform")


@query("newest_archive", """WITH a AS (SELECT o_custkey AS file_name, 'lab.' || CAST(o_custkey % 3 AS VARCHAR) || '.Level_3.' || CAST(o_orderkey % 7 AS VARCHAR) || '.' || CAST(o_orderkey % 12 AS VARCHAR) || '.0.tar.gz' AS archive, o_orderkey % 7 AS v1, o_orderkey % 12 AS v2 FROM orders),
k AS (SELECT file_name, archive, row_number() OVER (PARTITION BY file_name ORDER BY v1 DESC, v2 DESC, archive DESC) AS r FROM a) SELECT file_name, archive FROM k WHERE r = 1""")
def newest_archive(spark, sf):
    name = F.concat(F.lit("lab."), (F.col("o_custkey") % 3).cast("string"), F.lit(".Level_3."), (F.col("o_orderkey") % 7).cast("string"), F.lit("."), (F.col("o_orderkey") % 12).cast("string"), F.lit(".0.tar.gz"))
    return pr.newest_archive(fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("file_name"), name.alias("archive")), "file_name", "archive")


@query("cut_metadata", "SELECT doc_id, source FROM documents WHERE (lang IS NULL OR doc_id % 3 = 0) AND (n_chars IS NULL OR doc_id % 5 <> 0)")
def cut_metadata(spark, sf):
    """Documents of which a third has no language and four fifths have no length."""
    docs = fx.table(spark, sf, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("meta.1.lang"), F.when(F.col("doc_id") % 5 == 0, F.col("n_chars")).alias("meta.1.n"))
    return pr.cut_metadata(docs)


@query("names", "SELECT p_partkey, replace(replace(p_brand, '#', '.'), '.', '-') AS dashed, split_part(p_brand || ',' || p_type, ',', 1) AS first FROM part")
def names(spark, sf):
    p = fx.table(spark, sf, "part")
    return p.select("p_partkey", pr.dashes(F.regexp_replace("p_brand", "#", ".")).alias("dashed"), pr.first_name(F.concat_ws(",", "p_brand", "p_type")).alias("first"))


@query("without_summaries", "SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN NULL ELSE o_orderpriority END AS gene FROM orders WHERE o_orderkey % 9 = 0 OR o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
def without_summaries(spark, sf):
    o = fx.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).alias("gene"), "o_comment" if "o_comment" in fx.table(spark, sf, "orders").columns else F.lit(1).alias("o_comment"))
    return pr.without_summaries(o, "gene", ("1-URGENT", "5-LOW"), ("o_comment",))


@query("preview", "SELECT o_orderkey, o_custkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 30)")
def preview(spark, sf):
    return pr.preview(fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), 30, 2, "o_orderkey")


@query("suffix_columns", "SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS cust, CAST(o_totalprice AS DOUBLE) AS total FROM orders")
def suffix_columns(spark, sf):
    o = fx.table(spark, sf, "orders")
    return pr.with_suffix(o.select("o_orderkey", F.col("o_custkey").cast("bigint").alias("cust_norm"), F.col("o_totalprice").cast("double").alias("total_norm"), F.lit(1).alias("raw")), "_norm", ("o_orderkey",))


@query("named_columns", "SELECT n_name, n_nationkey FROM nation")
def named_columns(spark, sf):
    return pr.named(fx.table(spark, sf, "nation"), ["n_name", "n_nationkey"])


@query("whitelisted", f"WITH {FEATURES} SELECT sample_id, feature, value FROM feat WHERE feature IN ('hsa.f01', 'hsa.f07', 'hsa.f63')")
def whitelisted(spark, sf):
    listed = spark.createDataFrame([("hsa.f01",), ("hsa.f07",), ("hsa.f63",), ("hsa.none",)], "feature string")
    return pr.whitelisted(fx.feature_matrix(spark, sf), listed).select("sample_id", "feature", "value")


@query("with_clinical", "SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def with_clinical(spark, sf):
    return pr.with_clinical(fx.table(spark, sf, "documents").select("doc_id", "source"), fx.table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id")


@query("metadata_and_features", f"WITH {FEATURES}, m AS (SELECT DISTINCT sample_id, class FROM feat) SELECT m.sample_id, m.class, f.feature, f.value FROM m JOIN feat f ON m.sample_id = f.sample_id")
def metadata_and_features(spark, sf):
    """Metadata and features, joined by an explicit sample id where file order would do it."""
    return samples(spark, sf).join(fx.feature_matrix(spark, sf).drop("class"), "sample_id")


@query("labelled_samples", f"SELECT e.vec_id AS sample_id, {_CLASS} AS class, d.source FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id")
def labelled_samples(spark, sf):
    return samples(spark, sf).join(fx.table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), "source"), "sample_id")


@query("benchmark_row", f"WITH {BENCH} SELECT * FROM bench WHERE method = 'sig3'")
def benchmark_row(spark, sf):
    return pr.cohort(fx.benchmark_long(spark, sf), {"method": "sig3"})


@query("scale_bounds", f"WITH c AS (SELECT count(*) FILTER (label <> 0)::DOUBLE / count(*) FILTER (label = 0) AS ratio FROM embeddings) SELECT ratio, CASE WHEN ratio > 1 THEN 0.0::DOUBLE ELSE ratio * 0.5 END AS low, CASE WHEN ratio > 1 THEN ratio * 2 ELSE 5.0::DOUBLE END AS high FROM c")
def scale_bounds(spark, sf):
    return pr.scale_bounds(samples(spark, sf))


@query("formula_features", f"WITH {SIGS} SELECT method, 'Class' AS response, CAST(row_number() OVER (PARTITION BY method ORDER BY feature) - 1 AS INTEGER) AS position, feature FROM signatures")
def formula_features(spark, sf):
    """Formulas of all methods, written one folder a method, read back and taken apart."""
    chosen = signatures_of(spark, sf).groupBy("method").agg(F.concat(F.lit("Class ~ "), F.array_join(F.array_sort(F.collect_list("feature")), " + ")).alias("formula"))
    path = stores.new_folder(spark, "formulas")
    stores.write_formulas(chosen, path)
    return pr.parse_formulas(stores.read_formulas(spark, path))


@query("unvisited", "WITH c AS (SELECT o_custkey % 20 AS x, o_orderkey % 15 AS y FROM orders), s AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM c) SELECT a, b FROM s WHERE NOT (a % 3 = 0 AND b % 2 = 0)")
def unvisited(spark, sf):
    pair = F.array((F.col("o_custkey") % 20).cast("string"), (F.col("o_orderkey") % 15).cast("string"))
    found = fx.table(spark, sf, "orders").select(pair.alias("features"))
    low, high = (f(F.transform("features", lambda x: x.cast("int"))) for f in (F.array_min, F.array_max))
    out = pr.unvisited(found, found.where((low % 3 == 0) & (high % 2 == 0)), "features")
    return out.select(low.cast("bigint").alias("a"), high.cast("bigint").alias("b"))


@query("validation_share", f"WITH s AS (SELECT vec_id AS sample_id, {_CLASS} AS class FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5('1|' || CAST(sample_id AS VARCHAR)), sample_id) AS r, count(*) OVER (PARTITION BY class) AS n FROM s) SELECT sample_id, class, CASE WHEN r <= floor(n * 0.3::DOUBLE) THEN 'valid' ELSE 'train' END AS part FROM k")
def validation_share(spark, sf):
    return pr.validation_share(samples(spark, sf), 0.3)


@query("top_auc", f"""WITH {AUC}, v AS (SELECT *, (neg - fp + n / 2) / neg AS v10 FROM roc), s AS (SELECT feature, max(pos) AS pos, sum(p * v10) AS s1 FROM v GROUP BY feature), a AS (SELECT feature, round(greatest(s1 / pos, 1 - s1 / pos), 8) AS auc FROM s),
k AS (SELECT *, CAST(row_number() OVER (ORDER BY auc DESC, feature) AS INTEGER) AS rank FROM a) SELECT rank, feature, auc FROM k WHERE rank <= 11""")
def top_auc(spark, sf):
    return pr.top_features(rounded(ev.auc(scored(spark, sf)), "auc").select("feature", "auc"), "auc", 11)


@query("top_su", f"WITH u AS ({ORACLES['symmetrical_uncertainty']}), k AS (SELECT feature, su, CAST(row_number() OVER (ORDER BY su DESC, feature) AS INTEGER) AS rank FROM u) SELECT rank, feature, su FROM k WHERE rank <= 11")
def top_su(spark, sf):
    return pr.top_features(rounded(ev.symmetrical_uncertainty(fx.feature_matrix(spark, sf)), "su").select("feature", "su"), "su", 11)


def _of_significant(score: str, sql: str) -> str:
    return f"""WITH t AS ({sql}), g AS (WITH {SIGS} SELECT feature FROM signatures WHERE method = 'sig'),
k AS (SELECT feature, {score}, CAST(row_number() OVER (ORDER BY {score} DESC, feature) AS INTEGER) AS rank FROM t WHERE feature IN (SELECT feature FROM g)) SELECT rank, feature, {score} FROM k WHERE rank <= 11"""


def significant_of(spark, sf):
    return ex.significant(ex.differential_expression(fx.feature_matrix(spark, sf)))


@query("top_auc_sig", _of_significant("auc", f"WITH {AUC}, v AS (SELECT *, (neg - fp + n / 2) / neg AS v10 FROM roc), s AS (SELECT feature, max(pos) AS pos, sum(p * v10) AS s1 FROM v GROUP BY feature) SELECT feature, round(greatest(s1 / pos, 1 - s1 / pos), 8) AS auc FROM s"))
def top_auc_sig(spark, sf):
    """The best AUC among significant features."""
    scores = rounded(ev.auc(scored(spark, sf)), "auc").select("feature", "auc")
    return pr.top_features(pr.only_selected(scores, significant_of(spark, sf)), "auc", 11)


@query("top_su_sig", _of_significant("su", f"SELECT feature, su FROM ({ORACLES['symmetrical_uncertainty']})"))
def top_su_sig(spark, sf):
    """The best symmetrical uncertainty among significant features."""
    scores = rounded(ev.symmetrical_uncertainty(fx.feature_matrix(spark, sf)), "su").select("feature", "su")
    return pr.top_features(pr.only_selected(scores, significant_of(spark, sf)), "su", 11)


@query("all_features", f"WITH {FEATURES}, f AS (SELECT DISTINCT feature FROM feat) SELECT feature, CAST(row_number() OVER (ORDER BY feature) AS INTEGER) AS rank FROM f")
def all_features(spark, sf):
    return pr.all_features(fx.feature_matrix(spark, sf))


@query("best_reports", f"WITH {BENCH}, m AS (SELECT method, round(avg(value), 8) AS score FROM bench GROUP BY method), k AS (SELECT method AS feature, score, CAST(row_number() OVER (ORDER BY score DESC, method) AS INTEGER) AS rank FROM m) SELECT size, rank, feature, score FROM k, (VALUES (3), (6), (20)) s(size) WHERE rank <= size")
def best_reports(spark, sf):
    """The best 3, 6 and 20 methods."""
    scores = rounded(fx.benchmark_long(spark, sf).groupBy(F.col("method").alias("feature")).agg(F.avg("value").alias("score")), "score")
    return pr.top_features(scores, "score", 20).select(F.explode(F.array(F.lit(3), F.lit(6), F.lit(20))).alias("size"), "rank", "feature", "score").where("rank <= size")


@query("without_redundant", f"""WITH {FEATURES}, c AS (SELECT a.feature AS fa, b.feature AS fb, abs(corr(a.value, b.value)) AS r FROM feat a JOIN feat b ON a.sample_id = b.sample_id AND a.feature < b.feature GROUP BY ALL),
m AS (SELECT f, round(avg(r), 10) AS m FROM (SELECT fa AS f, r FROM c UNION ALL SELECT fb, r FROM c) GROUP BY f),
o AS (SELECT CASE WHEN x.m > y.m OR (x.m = y.m AND fa > fb) THEN fa ELSE fb END AS f FROM c JOIN m x ON x.f = fa JOIN m y ON y.f = fb WHERE r > 0.06)
SELECT DISTINCT feature FROM feat WHERE feature NOT IN (SELECT f FROM o)""")
def without_redundant(spark, sf):
    long = fx.feature_matrix(spark, sf)
    return pr.without_redundant(long, ex.correlations(long), 0.06)


@query("trimmed_means", f"WITH {FEATURES}, k AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) AS r, count(*) OVER (PARTITION BY feature) AS n FROM feat) SELECT feature, round(avg(value), 8) AS trimmed FROM k WHERE r > floor(n * 0.1::DOUBLE) AND r <= n - floor(n * 0.1::DOUBLE) GROUP BY feature")
def trimmed_means(spark, sf):
    return rounded(pr.trimmed_means(fx.feature_matrix(spark, sf)), "trimmed")


@query("fully_observed", f"WITH {MISSING} SELECT sample_id, count(*) AS n_features FROM miss GROUP BY sample_id HAVING count(CASE WHEN value IS NULL AND sample_id % 4 <> 0 THEN 0 ELSE value END) = count(*)")
def fully_observed(spark, sf):
    """Of the missing values only those of every fourth sample stay missing."""
    long = fx.missing_matrix(spark, sf)
    return pr.complete(long.withColumn("value", F.coalesce("value", F.when(F.col("sample_id") % 4 != 0, 0.0))))


@query("fill_mode", "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN lang END AS lang FROM documents), m AS (SELECT lang FROM d WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1) SELECT doc_id, coalesce(lang, (SELECT lang FROM m)) AS lang FROM d")
def fill_mode(spark, sf):
    """Documents of which every seventh has lost its language."""
    return pr.fill_mode(fx.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("lang")), "lang")


@query("grid_parts", "SELECT s_suppkey AS study, CAST(x AS INTEGER) AS layer1, CAST(0 AS INTEGER) AS layer2, a AS activation FROM supplier, range(3, 12) t(x), (VALUES ('relu'), ('selu')) s(a) UNION ALL SELECT s_suppkey, CAST(x AS INTEGER), CAST(y AS INTEGER), a FROM supplier, range(3, 12) t(x), range(3, 6) u(y), (VALUES ('relu'), ('selu')) s(a)")
def grid_parts(spark, sf):
    """Networks of one and of two hidden layers, for every study."""
    studies = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("study"))
    one = ev.grid(studies, layer1=list(range(3, 12)), layer2=[0], activation=["relu", "selu"])
    return one.unionByName(ev.grid(studies, layer1=list(range(3, 12)), layer2=list(range(3, 6)), activation=["relu", "selu"]))


SPLIT = f"mix_of AS ({ORACLES['stratified_split']})"


def split_wide(spark, sf):
    long = fx.feature_matrix(spark, sf)
    features = [f"hsa.f{i:02d}" for i in range(64)]
    return stores.to_wide(long, features).join(ex.stratified_split(samples(spark, sf)).select("sample_id", "mix"), "sample_id"), features


def unpivoted(wide, features):
    return wide.unpivot(["sample_id", "class", "mix"], [F.col(f"`{f}`") for f in features], "feature", "value")


@query("stored_splits", f"WITH {FEATURES}, {SPLIT} SELECT f.sample_id, f.class, m.mix, f.feature, f.value FROM feat f JOIN mix_of m ON f.sample_id = m.sample_id")
def stored_splits(spark, sf):
    """Train, test and valid written as files, read back with their checks."""
    wide, features = split_wide(spark, sf)
    path = stores.new_folder(spark, "splits")
    stores.write_splits(wide, path)
    return unpivoted(stores.read_splits(spark, path, wide.schema), features)


@query("merged_splits", f"WITH {FEATURES}, {SPLIT}, u AS (SELECT f.sample_id, f.class, m.mix, f.feature, f.value FROM feat f JOIN mix_of m ON f.sample_id = m.sample_id) SELECT mix, class, feature, count(*) AS n, round(sum(value), 7) AS total FROM (SELECT * FROM u UNION ALL SELECT sample_id, class, 'train_balanced', feature, value FROM u WHERE mix = 'train' AND (class = 'Case' OR sample_id % 4 = 0)) GROUP BY ALL")
def merged_splits(spark, sf):
    """The splits and a balanced training set, computed and written at the first read, then read as one table."""
    wide, features = split_wide(spark, sf)
    balanced = wide.where("mix = 'train' and (class = 'Case' or sample_id % 4 = 0)").withColumn("mix", F.lit("train_balanced"))
    path = stores.new_folder(spark, "merged")
    for _ in range(2):  # the second time it is only read
        merged = stores.scan_or_compute(spark, path, lambda: wide.unionByName(balanced))
    return unpivoted(merged, features).groupBy("mix", "class", "feature").agg(F.count("*").alias("n"), F.round(F.sum("value"), 7).alias("total"))


@query("unsplit", f"WITH {FEATURES} SELECT feature, mix, count(*) AS n FROM feat, (VALUES ('train'), ('test'), ('valid')) m(mix) GROUP BY ALL")
def unsplit(spark, sf):
    return stores.without_split(fx.feature_matrix(spark, sf)).groupBy("feature", "mix").agg(F.count("*").alias("n"))


@query("own_split", f"SELECT vec_id AS sample_id, {_CLASS} AS class, CASE vec_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' ELSE 'valid' END AS mix FROM embeddings")
def own_split(spark, sf):
    """A split that the table brings along, checked."""
    table = samples(spark, sf).withColumn("mix", F.element_at(F.array(F.lit("train"), F.lit("test"), F.lit("valid")), (F.col("sample_id") % 3 + 1).cast("int")))
    stores.check_splits(table)
    return table


def stored(spark, df, name: str, sep: str = ","):
    path = stores.new_folder(spark, name)
    stores.write_table(df, path, sep)
    return stores.read_table(spark, path, df.schema, sep)


@query("de_table", f"WITH {DE} SELECT feature, n1, n0, round(p_value, 8) AS p_value, round(p_bh, 8) AS p_bh, round(diff / log10(2), 8) AS log2fc FROM de")
def de_table(spark, sf):
    found = ex.differential_expression(fx.feature_matrix(spark, sf)).select("feature", "n1", "n0", "p_value", "p_bh", "log2fc")
    return rounded(stored(spark, found, "de"), "p_value", "p_bh", "log2fc")


@query("normalised_table", f"WITH {FEATURES}, m AS (SELECT feature, avg(value) AS a, stddev_samp(value) AS s FROM feat GROUP BY feature) SELECT sample_id, class, feature, round((value - a) / s, 7) AS value FROM feat JOIN m USING (feature)")
def normalised_table(spark, sf):
    return rounded(stored(spark, ex.z_scores(fx.feature_matrix(spark, sf)).select("sample_id", "class", "feature", "value"), "normalised"), "value", digits=7)


@query("counts_tables", f"WITH {COUNTS} SELECT sample_id, feature, value, round(log10(value / sum(value) OVER (PARTITION BY sample_id) * 1e6 + 0.001), 8) AS log10tpm FROM cnt")
def counts_tables(spark, sf):
    """Counts and log10 TPM, each a table of its own."""
    both = ex.log10_tpm(fx.count_matrix(spark, sf))
    counts, tpm = stored(spark, both.select("sample_id", "feature", "value"), "counts"), stored(spark, both.select("sample_id", "feature", "log10tpm"), "logtpm")
    return rounded(counts.join(tpm, ["sample_id", "feature"]), "log10tpm")


@query("filtered_table", f"WITH {COUNTS}, e AS (SELECT feature FROM cnt GROUP BY feature HAVING count(*) FILTER (value < 24) <= 0.5 * count(*)) SELECT sample_id, feature, value FROM cnt SEMI JOIN e USING (feature)")
def filtered_table(spark, sf):
    counts = fx.count_matrix(spark, sf)
    return stored(spark, counts.join(ex.expressed(counts, 24), "feature", "left_semi").select("sample_id", "feature", "value"), "filtered", "\t")


@query("descriptives_table", f"WITH {FEATURES} SELECT feature, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS min, round(max(value), 6) AS max FROM feat GROUP BY feature")
def descriptives_table(spark, sf):
    return rounded(stored(spark, ex.describe(fx.feature_matrix(spark, sf)).select("feature", "n", "mean", "sd", "min", "max"), "descriptives"), "mean", "sd", "min", "max", digits=6)


@query("feature_export", f"WITH {FEATURES} SELECT sample_id, class, max(value) FILTER (feature = 'hsa.f05') AS f05, max(value) FILTER (feature = 'hsa.f21') AS f21 FROM feat GROUP BY ALL")
def feature_export(spark, sf):
    wide, _ = split_wide(spark, sf)
    back = stored(spark, pr.named(wide, ["sample_id", "class", "hsa.f05", "hsa.f21"]), "export")
    return back.toDF("sample_id", "class", "f05", "f21")


@query("formula_table", f"{ORACLES['merge_formulas']}")
def formula_table(spark, sf):
    return stored(spark, ev.merge_formulas(signatures_of(spark, sf)), "merged-formulas")


@query("benchmark_cells", f"WITH {BENCH} SELECT method, algorithm, split, metric, value FROM bench")
def benchmark_cells(spark, sf):
    """Results put in cell by cell (method and algorithm), some of them twice: each counts once, with its last values."""
    bench, path = fx.benchmark_long(spark, sf), stores.new_folder(spark, "cells")
    stores.put_cells(bench.where("algorithm in ('rf', 'mlp')").withColumn("value", F.when(F.col("algorithm") == "mlp", 0.0).otherwise(F.col("value"))), path, ("method", "algorithm"))
    stores.put_cells(bench.where("algorithm <> 'rf'"), path, ("method", "algorithm"))
    return spark.read.parquet(path).select("method", "algorithm", "split", "metric", "value")


@query("folder_scan", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(NULL AS BIGINT) AS region, 0 AS file FROM nation UNION ALL SELECT CAST(n_nationkey AS BIGINT), NULL, CAST(n_regionkey AS BIGINT), 1 FROM nation WHERE n_regionkey < 3")
def folder_scan(spark, sf):
    n = fx.table(spark, sf, "nation")
    paths = [stores.new_folder(spark, "scan") for _ in range(2)]
    stores.write_table(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), paths[0])
    stores.write_table(n.where("n_regionkey < 3").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region")), paths[1])
    found = stores.read_folder(spark, paths)
    return found.select(F.col("id").cast("bigint").alias("id"), "name", F.col("region").cast("bigint").alias("region"), "file")
