"""Fitted selectors, matching, clustering and networks against brute force or a table with one telling feature; edge cases of table operations."""

import pytest
from pyspark.sql import functions as F

from helixmill.operators import tables, trees, wrappers


@pytest.fixture(scope="module")
def long(spark):
    rows = [(i, "Case" if i % 3 == 0 else "Control", [(i * 7) % 5, 3 * (i % 3 == 0) + (i * 13 % 17) * 0.25, (i * 5) % 7]) for i in range(90)]
    return spark.createDataFrame([(i, c, f"hsa.{j}", float(x)) for i, c, values in rows for j, x in enumerate(values)], "sample_id bigint, class string, feature string, value double").persist()


def test_backward_logit_keeps_the_feature_that_tells(long):
    for by in ("aic", "p"):
        rows = wrappers.backward_logit(long, by).orderBy("step").collect()
        assert rows[0].n_features == 3 and rows[0].removed is None
        assert "hsa.1" not in {r.removed for r in rows}
    aic = [r.aic for r in wrappers.backward_logit(long).orderBy("step").collect()]
    assert aic == sorted(aic, reverse=True)


def test_backward_logit_equals_one_fit_a_step(spark, monkeypatch):
    """The rows of spark.ml's models, one fit a step, in far fewer jobs; also where no step is foreseen."""
    from pyspark.ml.feature import VectorSlicer
    from pyspark.ml.regression import GeneralizedLinearRegression

    from helixmill.operators import models

    u = lambda i, j: (i * 7919 * (j + 3) + j * 104729) % 1009 / 1009
    rows = [(i, "Case" if u(i, 20) + 0.5 * u(i, 0) - 0.4 * u(i, 1) > 0.6 else "Control", f"f{j:02d}", u(i, j) + (u(i, 2) if j == 7 else 0.0)) for i in range(400) for j in range(12)]
    table = spark.createDataFrame(rows, "sample_id bigint, class string, feature string, value double").persist()
    data, left, removed, want = models.vectors(table)[0].persist(), list(range(12)), None, []
    while left:
        summary = GeneralizedLinearRegression(featuresCol="v", family="binomial", maxIter=50).fit(VectorSlicer(inputCol="x", outputCol="v", indices=left).transform(data)).summary
        p = list(summary.pValues)[: len(left)]
        want.append((len(want), len(left), removed, pytest.approx(summary.aic, rel=1e-9), max(p)))
        removed = f"f{left.pop(p.index(max(p))):02d}"
    for by in ("p", "aic"):
        end = next(i for i, r in enumerate(want) if (r[4] <= 0.05 if by == "p" else i + 1 < 12 and want[i + 1][3].expected > r[3].expected))
        spark.sparkContext.setJobGroup(f"backward {by}", "")
        got = wrappers.backward_logit(table, by).orderBy("step").collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        assert [tuple(r) for r in got] == [r[:4] for r in want[: end + 1]] and len(got) > 6
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"backward {by}")) < 5 * len(got)
    spark.sparkContext.setJobGroup("", "")
    monkeypatch.setattr(wrappers, "AHEAD", 1)
    assert [tuple(r) for r in wrappers.backward_logit(table, "p").orderBy("step").collect()] == [r[:4] for r in want[: next(i for i, r in enumerate(want) if r[4] <= 0.05) + 1]]


def test_backward_logit_of_features_that_tell_the_same(spark):
    """A feature without variance and one of two equal ones go first; separable classes end."""
    rows = [(i, "Case" if i % 7 < 3 else "Control", f, v) for i in range(70) for f, v in (("a", float(i % 5)), ("b", float(i % 5)), ("c", 1.0), ("d", float(i % 7) + i % 3))]
    table = spark.createDataFrame(rows, "sample_id bigint, class string, feature string, value double")
    got = wrappers.backward_logit(table, "p").orderBy("step").collect()
    assert {r.removed for r in got[1:3]} in ({"a", "c"}, {"b", "c"})
    told = wrappers.backward_logit(table.withColumn("value", F.when(F.col("feature") == "d", (F.col("sample_id") % 7).cast("double")).otherwise(F.col("value"))), "p").collect()
    assert "d" not in {r.removed for r in told} and min(r.aic for r in told) < 20


def test_boruta_confirms_the_feature_that_tells(long):
    got = {r.feature: r for r in wrappers.boruta(long, rounds=8, trees=10).collect()}
    assert got["hsa.1"].decision == "Confirmed" and got["hsa.1"].hits == 8
    assert got["hsa.0"].decision != "Confirmed" and got["hsa.2"].decision != "Confirmed"


def test_shadows_are_a_permutation(long):
    from helixmill.operators import models

    data, names = models.vectors(long)
    rows = wrappers.shadowed(data, 1).collect()
    n = len(names)
    assert len(rows) == 90
    assert sorted(tuple(r.x[:n]) for r in rows) == sorted(tuple(r.x[n:]) for r in rows)
    assert any(tuple(r.x[:n]) != tuple(r.x[n:]) for r in rows)


def test_forward_wrapper(long):
    assert wrappers.forward_wrapper(long, F.col("sample_id") % 2, 1, 3, 2).first().feature == "hsa.1"


def test_trees_tell_what_those_of_spark_ml_tell(spark):
    """A step has as many jobs for one feature tried as for all; accuracies as from one fit a feature and fold."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorSlicer

    from helixmill.operators import models

    u = lambda i, j: (i * 7919 * (j + 3) + j * 104729) % 1009 / 1009
    rows = [(i, "Case" if u(i, 9) + 0.4 * u(i, 0) + (0.3 if u(i, 1) > 0.6 else 0.0) * (i % 2) > 0.85 else "Control", f"f{j}", u(i, j) if j < 4 else float(i % 3) if j == 4 else 1.0) for i in range(700) for j in range(6)]
    table = spark.createDataFrame(rows, "sample_id bigint, class string, feature string, value double").persist()
    fold = F.when(F.col("sample_id") % 10 < 9, F.col("sample_id") % 3)
    data = models.vectors(table)[0].withColumn("f", fold).persist()

    def fitted(cut):
        sliced, right = VectorSlicer(inputCol="x", outputCol="v", indices=cut).transform(data), 0
        for f in range(3):
            tree = DecisionTreeClassifier(featuresCol="v", maxDepth=3, seed=1).fit(sliced.where(F.col("f") != f))
            right += tree.transform(sliced.where(F.col("f") == f)).where("prediction = label").count()
        return right

    dealt = trees.binned(data, 3, 6)
    for tried in ([[i] for i in range(5)], [[0, 1], [1, 4], [3, 2]], [[0, 1, 5], [4, 2, 3]]):
        assert trees.right_told(dealt, tried, 3, 6).tolist() == [fitted(cut) for cut in tried]

    def jobs(candidates):
        spark.sparkContext.setJobGroup(f"forward {candidates}", "")
        got = wrappers.forward_wrapper(table, fold, 1, candidates).collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forward {candidates}"))

    (few, begun), (every, more) = jobs(1), jobs(6)
    spark.sparkContext.setJobGroup("", "")
    assert every[0].accuracy == max(fitted([i]) for i in range(6)) / 700 >= few[0].accuracy
    assert more <= begun + 5


def test_matching_is_greedy_and_uses_controls_once(spark):
    samples = spark.createDataFrame([(i, int(i % 3 == 0), float(i * 7 % 31), float(i * 11 % 13)) for i in range(60)] + [(99, 1, None, 1.0)], "sample_id bigint, label int, a double, b double")
    got = wrappers.matched(samples, ["a", "b"]).collect()
    assert len({r.control_id for r in got}) == len({r.case_id for r in got}) == 20
    assert 99 not in {r.case_id for r in got}
    free = {r.control_id: r.control_score for r in got}
    for r in sorted(got, key=lambda r: (-r.case_score, r.case_id)):
        # every control that is matched later was free, and no nearer
        assert abs(r.control_score - r.case_score) <= min(abs(s - r.case_score) for s in free.values()) + 1e-12
        del free[r.control_id]


def test_average_linkage_by_brute_force(spark):
    at = {f"f{i}": x for i, x in enumerate([0.0, 0.4, 5.0, 5.3, 5.9, 20.0, 20.2, 9.1])}
    names = sorted(at)
    d = {(a, b): abs(at[a] - at[b]) for a in names for b in names if a < b}
    groups = [[f] for f in names]
    while len(groups) > 3:
        mean = lambda x, y: sum(abs(at[a] - at[b]) for a in x for b in y) / len(x) / len(y)
        _, i, j = min((mean(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        groups[i] = groups[i] + groups.pop(j)
    table = spark.createDataFrame([(a, b, x) for (a, b), x in d.items()], "feature_a string, feature_b string, distance double")
    found = {}
    for r in wrappers.feature_clusters(table, 3).collect():
        found.setdefault(r.cluster, []).append(r.feature)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups))
    assert wrappers.feature_clusters(table.limit(0), 3).count() == 0


def test_networks_learn(long):
    mixed = long.withColumn("mix", F.when(F.col("sample_id") < 60, "train").otherwise("test"))
    rows = wrappers.network_grid(mixed, [[3], [4, 3]]).collect()
    assert {(r.model_id, r.mix) for r in rows} == {(m, x) for m in (1, 2) for x in ("train", "test")}
    assert all(r.accuracy > 0.6 for r in rows if r.mix == "train")


def test_table_operations_with_nulls(spark):
    b = spark.createDataFrame([(None,), ("TCGA-AA-0001-01A",), ("TCGA-AA-0001-11A",), ("odd",)], "b string").select("b", *tables.barcode_parts(F.col("b")))
    assert {(r.b, r.sample_type, r.tumour) for r in b.collect()} == {(None, None, False), ("TCGA-AA-0001-01A", 1, True), ("TCGA-AA-0001-11A", 11, False), ("odd", None, False)}
    probes = spark.createDataFrame([("f", "p", None), ("f", "p", "1"), ("f", "q", None), ("f", "q", None), ("f", "r", "2")], "file string, probe string, v string")
    assert {(r.probe, r.agree) for r in tables.agreeing_probes(probes, "file", "probe", "v").collect()} == {("p", False), ("q", True)}
    one = spark.createDataFrame([(1, "Case", "a", 1.0), (1, "Case", "b", 2.0)], "sample_id int, class string, feature string, value double")
    assert tables.fisher_pairs(one).first().criterion is None
    assert tables.fisher_pairs(one.limit(0)).count() == 0


def test_fitted_queries_see_every_feature(spark, monkeypatch):
    from helixmill.plans import transforms

    seen = lambda long, *_: long.select("feature").distinct().count()
    monkeypatch.setattr(wrappers, "backward_logit", seen)
    monkeypatch.setattr(wrappers, "network_grid", seen)
    assert [q(spark, "/root/testdata/sf0.001") for q in (transforms.step_aic, transforms.stepwise_p, transforms.network_grid)] == [64, 64, 64]


def test_nearest_is_the_same_in_any_number_of_blocks(spark):
    from helixmill.operators import transforms

    rows = [(i, [float(i * 37 % 101), float(i * 53 % 89)]) for i in range(120)]
    table = spark.createDataFrame(rows, "sample_id bigint, x array<double>")
    want = {i: [j for _, j in sorted((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in rows if j != i)[:5]] for i, x in rows}
    for blocks in (1, 4):
        assert {r.sample_id: r.near for r in transforms.nearest(table, 5, blocks).collect()} == want
    assert [r.near for r in transforms.nearest(table.limit(1), 5, 3).collect()] == [[]]


def test_forward_wrapper_tries_features_of_no_correlation(spark):
    """What tells is the size of a feature without correlation with the class; six others correlate a little."""
    rows = []
    for i in range(72):
        case, sign = i % 3 == 0, 1 if i // 6 % 2 else -1
        rows += [(i, "Case" if case else "Control", f"hsa.{j}", float(x)) for j, x in enumerate([*[(i * (2 * j + 3)) % 17 + case for j in range(6)], sign * (3 if case else 1)])]
    table = spark.createDataFrame(rows, "sample_id bigint, class string, feature string, value double")
    got = wrappers.forward_wrapper(table, F.col("sample_id") % 4 % 2, 1, folds=2).first()
    assert got.feature == "hsa.6" and got.accuracy == 1.0


@pytest.mark.parametrize("block", [100_000, 700, 90])
def test_matching_leaves_no_case_beside_a_free_control(spark, monkeypatch, block):
    """Cases of mostly large scores: strata alone would have few controls for them."""
    import random

    rng = random.Random(4)
    rows = [(i, int(rng.random() < (0.9 if x > 0.7 else 0.06)), x, 1.0) for i in range(3_000) for x in [rng.random()]] + [(9_000 + i, i % 2, 0.8, 1.0) for i in range(400)]
    samples = spark.createDataFrame(rows, "sample_id bigint, label int, a double, b double")
    monkeypatch.setattr(wrappers, "MATCHED", block)
    got = wrappers.matched(samples, ["a"]).collect()
    cases, controls = {r[0] for r in rows if r[1]}, {r[0] for r in rows if not r[1]}
    assert len(cases) < len(controls)
    assert {r.case_id for r in got} == cases and len(got) == len(cases) == len({r.control_id for r in got})
    assert {r.control_id for r in got} <= controls
    few = wrappers.matched(samples.where("label = 1 or sample_id % 9 = 0"), ["a"]).collect()
    free = {r[0] for r in rows if not r[1] and r[0] % 9 == 0}
    assert {r.control_id for r in few} == free and len({r.case_id for r in few}) == len(free)


def test_nearest_free_equals_a_search_of_all():
    import random

    import numpy as np

    rng = random.Random(1)
    for n, m in ((0, 3), (5, 0), (30, 12), (20, 40), (200, 150)):
        pool = np.array(sorted(rng.choice([0.25, 0.5, rng.random()]) for _ in range(n)))
        cases = np.array([rng.choice([0.25, rng.random(), 2.0]) for _ in range(m)])
        free, got = set(range(n)), wrappers._nearest_free(cases, pool)
        for s, j in zip(cases, got, strict=True):
            if not free:
                assert j == -1
                continue
            assert j in free and abs(pool[j] - s) == min(abs(pool[i] - s) for i in free)
            free.remove(j)
