"""Queries of selectors that search: discretisation and rankings on its bins, with their SQL, and correlation-based sets, which the tests hold against independent searches, as SQL does not express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.operators import bayes_search, boosting, discretise, discriminant, dispatch, expression, imputation, networks, penalised, perturbation, search, tuner
from helixmill.plans.catalog import FEATURES, query, rounded
from helixmill.sources import fixtures as fx
from helixmill.sources import stores


def entropy(a: str, b: str) -> str:
    part = lambda x: f"CASE WHEN {x} > 0 THEN -({x}) / ({a} + {b})::DOUBLE * log2(({x}) / ({a} + {b})::DOUBLE) ELSE 0 END"
    return f"({part(a)} + {part(b)})"


def kinds(a: str, b: str) -> str:
    return f"(CASE WHEN {a} > 0 THEN 1 ELSE 0 END + CASE WHEN {b} > 0 THEN 1 ELSE 0 END)"


#: The telling matrix, and the recursion of its cuts: an interval's best cut by a window, its two parts as the next rows.
TELLING = FEATURES + ", tell AS (SELECT sample_id, class, feature, value + CASE WHEN class = 'Case' AND CAST(substr(feature, 6, 2) AS INT) % 5 = 0 THEN 0.05::DOUBLE * (1 + CAST(substr(feature, 6, 2) AS INT) % 4) ELSE 0 END AS value FROM feat)"
CUTS = TELLING + f""",
g AS (SELECT feature, value, count(*) FILTER (class = 'Case') AS n1, count(*) FILTER (class <> 'Case') AS n0 FROM tell GROUP BY ALL),
pre AS (SELECT feature, value, lead(value) OVER w AS next, sum(n1) OVER w AS c1, sum(n0) OVER w AS c0 FROM g WINDOW w AS (PARTITION BY feature ORDER BY value)),
iv AS (WITH RECURSIVE r AS (
  SELECT feature, '-infinity'::DOUBLE AS lo, 'infinity'::DOUBLE AS hi, 0::HUGEINT AS s1, 0::HUGEINT AS s0, max(c1) AS e1, max(c0) AS e0, NULL::DOUBLE AS cut, -1 AS level FROM pre GROUP BY feature
  UNION ALL SELECT feature, CASE WHEN side = 0 THEN lo ELSE value END, CASE WHEN side = 0 THEN value ELSE hi END, CASE WHEN side = 0 THEN s1 ELSE c1 END, CASE WHEN side = 0 THEN s0 ELSE c0 END, CASE WHEN side = 0 THEN c1 ELSE e1 END, CASE WHEN side = 0 THEN c0 ELSE e0 END, (value + next) / 2, level + 1
  FROM (SELECT *, {entropy('(e1 - s1)', '(e0 - s0)')} AS whole, {entropy('(c1 - s1)', '(c0 - s0)')} AS hl, {entropy('(e1 - c1)', '(e0 - c0)')} AS hr, row_number() OVER (PARTITION BY feature, lo ORDER BY round(h, 12), value) AS k
    FROM (SELECT r.*, value, next, c1, c0, (e1 + e0 - s1 - s0)::DOUBLE AS n, ((c1 + c0 - s1 - s0) * {entropy('(c1 - s1)', '(c0 - s0)')} + (e1 + e0 - c1 - c0) * {entropy('(e1 - c1)', '(e0 - c0)')}) / (e1 + e0 - s1 - s0)::DOUBLE AS h
      FROM r JOIN pre USING (feature) WHERE value > lo AND value < hi AND next IS NOT NULL AND c1 + c0 < e1 + e0 AND e1 > s1 AND e0 > s0)), (VALUES (0), (1)) t(side)
  WHERE k = 1 AND whole - h > (log2(n - 1) + log2(pow(3, {kinds('(e1 - s1)', '(e0 - s0)')}) - 2) - ({kinds('(e1 - s1)', '(e0 - s0)')} * whole - {kinds('(c1 - s1)', '(c0 - s0)')} * hl - {kinds('(e1 - c1)', '(e0 - c0)')} * hr)) / n)
  SELECT * FROM r),
cuts AS (SELECT DISTINCT feature, cut, level FROM iv WHERE cut IS NOT NULL),
bins AS (SELECT t.feature, t.class, t.sample_id, (SELECT count(*) FROM cuts c WHERE c.feature = t.feature AND c.cut < t.value) AS bin FROM tell t WHERE t.feature IN (SELECT feature FROM cuts)),
cell AS (SELECT feature, bin, class, count(*) AS n, sum(count(*)) OVER (PARTITION BY feature) AS total FROM bins GROUP BY feature, bin, class),
xy AS (SELECT feature, -sum(n / total * log2(n / total)) AS h FROM cell GROUP BY feature),
x AS (SELECT feature, -sum(n / total * log2(n / total)) AS h FROM (SELECT feature, bin, sum(n) AS n, max(total) AS total FROM cell GROUP BY ALL) GROUP BY feature),
y AS (SELECT feature, -sum(n / total * log2(n / total)) AS h FROM (SELECT feature, class, sum(n) AS n, max(total) AS total FROM cell GROUP BY ALL) GROUP BY feature)"""
ALL = "(SELECT DISTINCT feature FROM tell) f"


@query("mdl_cuts", f"WITH {CUTS} SELECT feature, cut, level FROM cuts")
def mdl_cuts(spark, sf):
    return discretise.mdl_cuts(fx.telling_matrix(spark, sf))


@query("su_mdl", f"WITH {CUTS} SELECT feature, round(coalesce(2 * (x.h + y.h - xy.h) / (x.h + y.h), 0), 8) AS su, round(coalesce(x.h + y.h - xy.h, 0), 8) AS gain FROM {ALL} LEFT JOIN xy USING (feature) LEFT JOIN x USING (feature) LEFT JOIN y USING (feature)")
def su_mdl(spark, sf):
    return rounded(discretise.su_mdl(fx.telling_matrix(spark, sf)), "su", "gain")


@query("auc_mdl", f"""WITH {CUTS}, b AS (SELECT feature, bin, coalesce(sum(n) FILTER (class = 'Case'), 0) AS p, coalesce(sum(n) FILTER (class <> 'Case'), 0) AS q FROM cell GROUP BY ALL),
s AS (SELECT feature, sum(p * (below + q / 2)) / (sum(p) * sum(q)) AS a FROM (SELECT *, coalesce(sum(q) OVER (PARTITION BY feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b) GROUP BY feature),
v AS (SELECT feature, coalesce(greatest(a, 1 - a), 0.5) AS auc FROM {ALL} LEFT JOIN s USING (feature)),
k AS (SELECT feature, auc, CAST(row_number() OVER (ORDER BY round(auc, 12) DESC, feature) AS INTEGER) AS rank FROM v) SELECT feature, round(auc, 8) AS auc, rank FROM k WHERE rank <= 11""")
def auc_mdl(spark, sf):
    return rounded(discretise.auc_mdl(fx.telling_matrix(spark, sf)), "auc")


@query("cfs")
def cfs(spark, sf):
    return discretise.best_first_cfs(fx.telling_matrix(spark, sf))


@query("fcfs")
def fcfs(spark, sf):
    return discretise.forward_cfs_mdl(fx.telling_matrix(spark, sf))


@query("corrsf_mdl")
def corrsf_mdl(spark, sf):
    """The first eleven of the forward search."""
    return discretise.forward_cfs_mdl(fx.telling_matrix(spark, sf), 11)


def fold():
    """Ten folds by a hash of the sample, as all engines with md5 give it."""
    return F.conv(F.substring(F.md5(F.col("sample_id").cast("string")), 1, 4), 16, 10).cast("int") % 10


@query("cv_lasso")
def cv_lasso(spark, sf):
    return rounded(penalised.cv_lasso(fx.telling_matrix(spark, sf), fold(), 10, n_penalties=30, least=1e-2), "coefficient", digits=6)


@query("lasso_path")
def lasso_path(spark, sf):
    return rounded(penalised.as_table(spark, penalised.penalty_path(fx.telling_matrix(spark, sf), fold(), 10, n_penalties=30, least=1e-2)), "penalty", "deviance", "error", digits=6)


@query("elastic_net")
def elastic_net(spark, sf):
    """Three mixes of twenty penalties each; the operator's default is seventeen of a hundred."""
    return rounded(penalised.elastic_net(fx.telling_matrix(spark, sf), fold(), 10, (0.1, 0.5, 0.9), n_penalties=20, least=1e-2), "coefficient", digits=6)


def split_telling(spark, sf):
    long = fx.telling_matrix(spark, sf)
    return long.join(expression.stratified_split(long.select("sample_id", "class").distinct()).select("sample_id", "mix"), "sample_id")


@query("selected")
def selected(spark, sf):
    """Four selectors, run as cells within a limit."""
    path = stores.new_folder(spark, "selected")
    dispatch.select(split_telling(spark, sf).where("mix = 'train'").drop("mix"), path, ["cfs", "SU_MDL", "AUC_MDL_sig", "AUCSMOTE"], limit=3_600)
    return dispatch.selected(spark, path)


@query("tuned_benchmark")
def tuned_benchmark(spark, sf):
    """Two feature sets by four tuned algorithms."""
    path = stores.new_folder(spark, "tuned")
    formulas = {m: [f"hsa.f{i:02d}" for i in ids] for m, ids in (("telling", range(0, 64, 5)), ("first", range(11)))}
    tuner.benchmark(split_telling(spark, sf), formulas, path, ("logistic", "tree", "svm", "bayes"), draws=3, limit=3_600)
    figures = [f"{mix}_{c}" for mix in ("train", "test", "valid") for c in tuner.FIGURES] + ["train_auc", "train_auc_low", "train_auc_high"]
    return rounded(tuner.board(spark, path).drop("model"), *figures, digits=6)


@query("fisher_beam")
def fisher_beam(spark, sf):
    return rounded(discriminant.fisher_beam(fx.telling_matrix(spark, sf)), "accuracy")


@query("step_lda")
def step_lda(spark, sf):
    """With a smaller least improvement than the operator's own, so that there is more than a step."""
    return rounded(discriminant.step_lda(fx.telling_matrix(spark, sf), 0.01), "accuracy")


@query("impute_pmm")
def impute_pmm(spark, sf):
    """Two rounds over the matrix with one value in eleven missing."""
    return rounded(imputation.impute_pmm(fx.missing_matrix(spark, sf).drop("class"), rounds=2), "value")


@query("boosted_stability")
def boosted_stability(spark, sf):
    return rounded(boosting.stability(fx.telling_matrix(spark, sf), rounds=40), "share", "coefficient", digits=6)


@query("network_search")
def network_search(spark, sf):
    """Four networks trained together: layers, dropout, penalties and a code of eight units."""
    long = split_telling(spark, sf)
    shapes = {"small": networks.Shape((16,), "relu", (0.2,)), "deep": networks.Shape((16, 8, 4), "selu"), "sparse": networks.Shape((12, 6), "tanh", penalised=(True, True)), "coded": networks.Shape((8,), "sigmoid", autoencoder=8)}
    made, _ = networks.train(long, shapes, epochs=25, patience=10, rate=0.03)
    return rounded(networks.board(long, made), "cutoff", "loss", "train_auc", *[f"{mix}_{c}" for mix in networks.MIXES for c in ("accuracy", "sensitivity", "specificity", "ppv", "npv", "f1")], digits=4)


@query("network_transfer")
def network_transfer(spark, sf):
    """A network of the telling matrix, stored, read and fitted further on the matrix as it is, its first layer frozen."""
    (network,), _ = networks.train(split_telling(spark, sf), {"first": networks.Shape((12, 6), "relu")}, epochs=20, patience=10, rate=0.03)
    path = stores.new_folder(spark, "network")
    networks.save(spark, network, path)
    plain = fx.feature_matrix(spark, sf)
    plain = plain.join(expression.stratified_split(plain.select("sample_id", "class").distinct()).select("sample_id", "mix"), "sample_id")
    _, told = networks.transfer(plain, networks.load(spark, path), (1, 1), epochs=20, patience=10, rate=0.03)
    stores.remove(spark, path)
    return rounded(told, "cutoff", "accuracy", "sensitivity", "specificity", "ppv", "npv", "f1", digits=4)


@query("genetic")
def genetic(spark, sf):
    """Five folds; the operator's population and generations."""
    return search.genetic(fx.telling_matrix(spark, sf), fold() % 5, 5).features(spark)


@query("annealing")
def annealing(spark, sf):
    return rounded(search.annealing(fx.telling_matrix(spark, sf), fold() % 5, 5).history(spark).drop("features"), "internal", "external")


@query("perturbed_weights")
def perturbed_weights(spark, sf):
    """Five steps of two slopes; about 500 queries a step."""
    return rounded(perturbation.ranked(fx.telling_matrix(spark, sf), iterations=5, slopes=2, queries=500), "weight", digits=6)


@query("boosted_search")
def boosted_search(spark, sf):
    """Three first trials and two further ones of five rounds each, on the telling features."""
    features = [f"hsa.f{i:02d}" for i in range(0, 64, 5)]
    found = bayes_search.boosted_trees(split_telling(spark, sf), features, fold() % 3, 3, stores.new_folder(spark, "boosted-search"), first=3, further=2, rounds=5)
    return rounded(found.drop("model"), "value", "cutoff", *[f"{mix}_{c}" for mix in stores.MIXES for c in tuner.FIGURES], digits=6)
