"""Cells that fail, are late or are resumed; tuned benchmarks against models fitted by hand."""

import time

import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.sql import functions as F

from helixmill.operators import dispatch, evaluation, models, tuner
from helixmill.sources import stores


@pytest.fixture(scope="module")
def long(spark):
    rows = [(i, "Case" if i % 3 == 0 else "Control", f"hsa.{j}", float(x), ("train", "train", "test", "valid")[i * 7 % 4 if i % 2 else i // 2 % 4]) for i in range(240) for j, x in enumerate([(i * 7) % 5, 2.0 * (i % 3 == 0) + (i * 13 % 17) * 0.2, (i * 5) % 7])]
    return spark.createDataFrame(rows, "sample_id bigint, class string, feature string, value double, mix string").persist()


def test_cells_fail_and_are_late_alone_and_resume(spark):
    path, ran, broken = stores.new_folder(spark, "cells"), [], [True]

    def good(name, n):
        def make():
            ran.append(name)
            return spark.range(n).withColumn("name", F.lit(name))

        return make

    def bad():
        ran.append("bad")
        if broken[0]:
            raise RuntimeError("no such luck\nsecond line")
        return spark.range(2).withColumn("name", F.lit("bad"))

    def slow():
        ran.append("slow")
        if broken[0]:
            wait = F.udf(lambda x: (time.sleep(60), x)[1], "bigint")
            spark.range(8).select(wait("id")).collect()
        return spark.range(1).withColumn("name", F.lit("slow"))

    cells = {"a/b c": good("a/b c", 3), "bad": bad, "slow": slow, "empty": good("empty", 0)}
    began = time.time()
    got = {r.cell: r for r in dispatch.run_cells(spark, cells, path, limit=8, at_once=2).collect()}
    assert time.time() - began < 45
    assert {c: r.state for c, r in got.items()} == {"a/b c": "done", "bad": "failed", "slow": "late", "empty": "done"}
    assert got["bad"].error == "RuntimeError: no such luck" and "8 s" in got["slow"].error
    assert dispatch.results(spark, path).count() == 3
    broken[0] = False
    ran.clear()
    got = {r.cell: r.state for r in dispatch.run_cells(spark, cells, path, limit=60).collect()}
    assert sorted(ran) == ["bad", "slow"] and set(got.values()) == {"done"}
    assert dispatch.results(spark, path).count() == 6
    assert dispatch.results(spark, stores.new_folder(spark, "none")) is None


def test_waiting_for_cores_is_not_being_late(spark):
    """Two cells in turn hold all cores for 5 s each; neither the second nor a small one is late at 9 s."""

    def hold():
        wait = F.udf(lambda x: (time.sleep(5), x)[1], "bigint")
        return spark.range(0, 8, 1, spark.sparkContext.defaultParallelism).select(wait("id"))

    def small():
        time.sleep(1)
        return spark.range(1)

    cells = {"one": hold, "two": hold, "small": small}
    got = {r.cell: r.state for r in dispatch.run_cells(spark, cells, stores.new_folder(spark, "cells"), limit=9, at_once=3).collect()}
    assert got == dict.fromkeys(cells, "done")


def test_selectors_share_their_inputs(spark, long):
    path = stores.new_folder(spark, "selected")
    train = long.where("mix = 'train'").drop("mix")
    got = {r.cell: r.state for r in dispatch.select(train, path, ["all", "cfs", "SU_MDL_sig", "AUCSMOTE", "AUCSMOTE_sig", "stepLDA", "bounce_sig"]).collect()}
    assert got == dict.fromkeys(got, "done") and len(got) == 7
    rows = {}
    for r in dispatch.selected(spark, path).orderBy("rank").collect():
        rows.setdefault(r.method, []).append(r.feature)
    assert rows["all"] == ["hsa.0", "hsa.1", "hsa.2"] and rows["cfs"] == ["hsa.1"]
    assert rows["stepLDA"][0] == rows["bounce_sig"][0] == "hsa.1"
    assert rows["AUCSMOTE"][0] == "hsa.1" and rows["SU_MDL_sig"] == rows["AUCSMOTE_sig"] == ["hsa.1"]
    balanced = spark.read.parquet(f"{path}/inputs/balanced").groupBy("class").agg(F.count_distinct("sample_id").alias("n")).collect()
    assert len({r.n for r in balanced}) == 1 or max(r.n for r in balanced) < 1.1 * min(r.n for r in balanced)
    with pytest.raises(ValueError, match="no such selector"):
        dispatch.select(train, path, ["nonsense"])


def test_benchmark_tunes_on_test_and_judges_each_part(spark, long):
    path = stores.new_folder(spark, "tuned")
    formulas = {"good": ["hsa.0", "hsa.1"], "gone": ["hsa.9"]}
    got = {r.cell: r for r in tuner.benchmark(long, formulas, path, ("tree", "logistic"), draws=4).collect()}
    assert {c: r.state for c, r in got.items()} == {"good|tree": "done", "good|logistic": "done", "gone|tree": "failed", "gone|logistic": "failed"}
    assert "missing" in got["gone|tree"].error
    rows = {r.algorithm: r for r in tuner.board(spark, path).collect()}
    # the tree by hand
    data = tuner.part(long, formulas["good"])
    scaler = StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True).fit(data.where("mix = 'train'"))
    best = None
    for i, tree in enumerate(tuner.candidates("tree", 4, 1)):
        assert isinstance(tree, DecisionTreeClassifier)
        fitted = tree.fit(scaler.transform(data.where("mix = 'train'")))
        auc = evaluation.auc(tuner.scored(fitted, "tree", scaler.transform(data.where("mix = 'test'")), F.lit(i).alias("feature")), turned=False).first().auc
        best = max(best or (-1, 0, None, None), (round(auc, 12), -i, tuner.settings(tree), fitted), key=lambda x: x[:2])
    assert rows["tree"].settings == best[2]
    for mix in ("train", "test", "valid"):
        told = tuner.scored(best[3], "tree", scaler.transform(data.where(F.col("mix") == mix))).collect()
        assert rows["tree"][f"{mix}_accuracy"] == pytest.approx(sum(r.label == r.predicted for r in told) / len(told))
        assert rows["tree"][f"{mix}_sensitivity"] == pytest.approx(sum(r.predicted for r in told if r.label) / sum(r.label for r in told))
    assert rows["tree"].train_auc_low <= rows["tree"].train_auc <= rows["tree"].train_auc_high
    new = tuner.apply_best(spark, path, long.where("mix = 'valid'"), formulas)
    want = max(r.valid_accuracy for r in rows.values())
    assert new.agg(F.avg((F.col("label") == F.col("predicted")).cast("double"))).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("name", sorted(tuner.SPACES))
def test_every_algorithm_fits_and_scores(spark, long, name):
    rows = tuner.cell(long, "m", ["hsa.0", "hsa.1"], name, stores.new_folder(spark, "models"), draws=2).collect()
    assert sorted(r.mix for r in rows) == ["test", "train", "valid"]
    assert all(r.auc > 0.7 for r in rows)
    assert models.vectors(long)[1] == ["hsa.0", "hsa.1", "hsa.2"]
