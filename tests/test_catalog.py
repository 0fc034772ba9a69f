"""Every registered query against its SQL, over the smallest tables; statistics against known values; edge cases."""

import math
import os
from decimal import Decimal, getcontext

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.functions import stats
from helixmill.operators import evaluation as ev
from helixmill.operators import expression as ex
from helixmill.operators import assembly, models
from helixmill.operators import transforms as tr
from helixmill.plans import catalog, preparation, tables, transforms  # noqa: F401 (registers their queries)
from helixmill.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return c


def plain(value):
    if value is None or value != value:
        return None
    return float(value) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sql, name):
    got = catalog.QUERIES[name](spark, SF)
    want = sql.sql(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted(repr([plain(row[c]) for c in columns]) for row in got.collect())
    b = sorted(repr([plain(x) for x in row]) for row in want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert a == b


def exact_p(t: int, df: int) -> float:
    """Student's two-sided p of even df by its finite series, in 400 digits."""
    getcontext().prec = 400
    x = Decimal(t) ** 2 / (df + Decimal(t) ** 2)  # sine squared
    term, total = Decimal(1), Decimal(1)
    for i in range(1, df // 2):
        term *= (1 - x) * (2 * i - 1) / (2 * i)
        total += term
    return float(1 - x.sqrt() * total)


@pytest.mark.parametrize("df", [2, 10, 60, 500, 4000])
@pytest.mark.parametrize("t", [0, 1, 2, 8, 20, -3])
def test_t_two_sided(spark, t, df):
    got = spark.range(1).select(stats.t_two_sided(F.lit(float(t)), F.lit(float(df)))).first()[0]
    assert math.isclose(got, exact_p(abs(t), df), rel_tol=1e-8)
    assert math.isclose(spark.range(1).select(stats.t_two_sided(F.lit(12.706204736432095), F.lit(1.0))).first()[0], 0.05, rel_tol=1e-9)


def test_gram_over_blocks(spark):
    rows = [(s, "k" if s % 2 else "o", f"f{i:02d}", None if (s * i) % 7 == 3 else float((s * 31 + i * 17) % 23)) for s in range(40) for i in range(12)]
    long = spark.createDataFrame(rows, "sample_id int, class string, feature string, value double")
    key = lambda df: sorted(map(tuple, df.collect()))
    one, many = (key(ex.gram(long, "class", block=b)) for b in (512, 4))
    assert len(one) == len(many) == 2 * 66
    for a, b in zip(one, many, strict=True):  # centred values are no whole numbers: sums may differ in their last bits
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-12, abs=1e-9)


def test_no_significant_feature_keeps_all(spark):
    de = spark.createDataFrame([("a", 0.2), ("b", 0.9)], "feature string, p_value double")
    assert ex.significant(de).count() == 2
    de = spark.createDataFrame([("a", 0.02), ("b", 0.9)], "feature string, p_value double")
    assert [r.feature for r in ex.significant(de).collect()] == ["a"]


def test_adjust_with_ties(spark):
    de = spark.createDataFrame([("a", 0.01), ("b", 0.01), ("c", 0.04)], "feature string, p_value double")
    rows = {r.feature: r for r in stats.adjust(de).collect()}
    assert rows["a"].p_bh == pytest.approx(0.015)
    assert rows["b"].p_bh == pytest.approx(0.015)
    assert rows["a"].p_holm == pytest.approx(0.03)
    assert rows["c"].p_bonferroni == pytest.approx(0.12)


def test_auc_of_ties_is_half(spark):
    scored = spark.createDataFrame([("f", 1.0, 1), ("f", 1.0, 0), ("f", 1.0, 0)], "feature string, score double, label int")
    assert ev.auc(scored).first().auc == 0.5


def test_harmonic_of_zero(spark):
    assert spark.range(1).select(stats.harmonic(F.lit(0.0), F.lit(1.0))).first()[0] == 0.0


def test_unique_names():
    assert fx.unique_names(["hsa-miR-21-5p", "hsa.miR.21.5p", "1a", ".2", "Class"]) == ["hsa.miR.21.5p", "hsa.miR.21.5p.1", "X1a", "X.2", "Class"]


def test_wide_to_long_needs_features(spark):
    df = spark.createDataFrame([(1, "Case", 2.0)], "id int, Class string, x double")
    with pytest.raises(ValueError, match="no column begins with hsa"):
        fx.wide_to_long(df, "id", "Class")
    df = spark.createDataFrame([(1, "Case", 2.0)], "id int, Class string, `hsa.1` double")
    assert fx.wide_to_long(df, "id", "Class").first().value == 2.0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 64
    assert set(entry.oracle_sql()) <= set(entry.queries())


def long_table(spark, rows):
    return spark.createDataFrame([(i, c, f"hsa.{j}", float(x)) for i, c, values in rows for j, x in enumerate(values)], "sample_id bigint, class string, feature string, value double")


def test_smote_edges(spark):
    lone = long_table(spark, [(1, "Case", [5, 6]), (2, "Control", [0, 1]), (3, "Control", [1, 0]), (4, "Control", [1, 1])])
    got = tr.smote(lone).collect()
    assert sorted((r.draw, r.feature, r.value) for r in got) == [(1, "hsa.0", 5.0), (1, "hsa.1", 6.0), (2, "hsa.0", 5.0), (2, "hsa.1", 6.0)]
    assert tr.smote(lone.where("sample_id < 3")).count() == 0
    assert tr.smote(lone.limit(0)).count() == 0


def test_combat_takes_shifts_out(spark):
    long = spark.createDataFrame([(s, s % 2, "Case", f"hsa.{j}", ((s * 7 + j * 3) % 11) * (1.0 + s % 2) + 10 * (s % 2)) for s in range(44) for j in range(6)], "sample_id bigint, batch bigint, class string, feature string, value double")
    means = {r.batch: r.m for r in tr.combat(long).groupBy("batch").agg(F.avg("value").alias("m")).collect()}
    assert abs(means[0] - means[1]) < 0.5
    flat = long.withColumn("value", F.lit(3.0))
    assert tr.combat(flat).select("value").distinct().collect()[0].value == 3.0


def test_combat_with_classes_against_a_design_matrix(spark):
    """Least squares on batch and class columns, then the empirical Bayes steps, in numpy."""
    rng = np.random.default_rng(5)
    n, p = 60, 7
    batch, case = np.arange(n) % 3, rng.random(n) < 0.2 + 0.25 * (np.arange(n) % 3)
    x = rng.normal(0, 1, (n, p)) * (1 + batch[:, None]) + 1e4 + 3 * batch[:, None] + 2 * case[:, None] * np.arange(p)
    design = np.column_stack([*(batch == b for b in range(3)), case]).astype(float)
    beta = np.linalg.lstsq(design, x, rcond=None)[0]
    sizes = design[:, :3].sum(0)
    stand = (sizes / n) @ beta[:3] + np.outer(case, beta[3])
    sd = np.sqrt(((x - design @ beta) ** 2).mean(0))
    z = (x - stand) / sd
    want = np.zeros_like(z)
    for b in range(3):
        own, k = z[batch == b], sizes[b]
        g, d = own.mean(0), own.var(0, ddof=1)
        gbar, t2, m, s2 = g.mean(), g.var(ddof=1), d.mean(), d.var(ddof=1)
        shift, scale = g, d
        for _ in range(50):
            shift = (t2 * k * g + scale * gbar) / (t2 * k + scale)
            scale = (((own - shift) ** 2).sum(0) / 2 + (m * s2 + m**3) / s2) / (k / 2 + (2 * s2 + m * m) / s2 - 1)
        want[batch == b] = (own - shift) / np.sqrt(scale)
    want = want * sd + stand
    long = spark.createDataFrame([(i, int(batch[i]), "Case" if case[i] else "Control", f"f{j}", float(x[i, j])) for i in range(n) for j in range(p)] + [(99, 0, "Case", "f0", None)], "sample_id bigint, batch bigint, class string, feature string, value double")
    got = {(r.sample_id, r.feature): r.value for r in tr.combat(long, by_class=True).collect()}
    assert len(got) == n * p + 1 and got[99, "f0"] is None
    assert np.array([[got[i, f"f{j}"] for j in range(p)] for i in range(n)]) == pytest.approx(want, rel=1e-9)
    one = long.withColumn("class", F.when(F.col("batch") == 0, "Case").otherwise("Control"))  # no batch has both
    assert {r.slope for r in tr.class_slopes(one).collect()} == {0.0}


def test_models_find_the_feature_that_tells(spark):
    long = long_table(spark, [(i, "Case" if i % 3 == 0 else "Control", [(i * 7) % 5, 3 * (i % 3 == 0) + (i % 4) * 0.1, (i * 5) % 7]) for i in range(60)])
    for select in (models.lasso, models.wx, models.forest_importance):
        assert select(long).first().feature == "hsa.1"
    assert models.pca_scores(long, 2).count() == 60
    assert models.forward_cfs(long, 2).first().feature == "hsa.1"
    assert {r.feature for r in models.recursive_elimination(long, 1).where("size = 1").collect()} == {"hsa.1"}
    told = models.benchmark(long.withColumn("mix", F.when(F.col("sample_id") < 40, "train").otherwise("test")), {"one": ["hsa.1"]})
    assert {(r.algorithm, r.mix, r.accuracy) for r in told.collect()} == {(a, m, 1.0) for a in ("logistic", "tree", "forest") for m in ("train", "test")}


def test_names_change_in_order_of_rows(spark):
    names = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "feature string")
    aliases = spark.createDataFrame([(0, ["b", "c", ""]), (1, ["a", "b"]), (2, ["c", "d"]), (3, [])], "ord bigint, aliases array<string>")
    got = {r.feature: r.corrected for r in assembly.correct_names(names, aliases).collect()}
    assert got == {"a": "b", "b": "d", "z": "z", None: None}
    assert assembly.correct_names(names.limit(0), aliases).count() == 0


def test_only_selected_counts_repeats_once(spark):
    scores = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0), ("c", None)], "feature string, score double")
    selected = spark.createDataFrame([("a",), ("a",), ("c",), (None,), ("z",)], "feature string")
    assert sorted(r.feature for r in preparation.pr.only_selected(scores, selected).collect()) == ["a", "c"]
    assert preparation.pr.only_selected(scores, selected.limit(0)).count() == 0


def test_entry_needs_no_session_to_be_imported():
    import subprocess
    import sys
    from pathlib import Path

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)
