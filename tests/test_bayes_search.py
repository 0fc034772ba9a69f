"""The process against closed forms, the search on a known surface with failures and resumption, and boosted trees end to end."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import functions as F

from helixmill.operators import bayes_search as bs
from helixmill.sources import stores


def test_posterior_and_improvement():
    rng = np.random.default_rng(2)
    x, y = rng.random((12, 5)), rng.random(12)
    mean, deviation = bs.posterior(x, y, x)
    assert mean == pytest.approx(y, abs=0.01) and deviation.max() < 0.02 * y.std() + 0.01
    far, wide = bs.posterior(x, y, np.full((1, 5), 50.0))
    assert far[0] == pytest.approx(y.mean()) and wide[0] == pytest.approx(y.std())
    draws = rng.normal(0.3, 0.2, 400_000)
    assert bs.improvement(np.array([0.3]), np.array([0.2]), 0.4)[0] == pytest.approx(np.maximum(draws - 0.4, 0).mean(), rel=0.02)
    assert bs.improvement(np.array([0.3]), np.array([0.0]), 0.4)[0] == 0
    square = bs.latin(10, rng)
    assert all(sorted((square[:, j] * 10).astype(int)) == list(range(10)) for j in range(5))
    low, high = bs.parameters(np.zeros(5)), bs.parameters(np.ones(5))
    assert all(low[n] == pytest.approx(a) and high[n] == pytest.approx(b) for n, a, b, _ in bs.SPACE)


def test_search_climbs_fails_alone_and_resumes(spark):
    path, ran = stores.new_folder(spark, "bayes"), []

    def objective(settings):
        ran.append(settings)
        if len(ran) == 2:
            raise RuntimeError("lost")
        return spark.range(1).select(F.lit(-abs(np.log(settings["stepSize"] / 0.1)) - abs(settings["maxDepth"] - 3)).alias("value"))

    short = bs.search(spark, objective, path, 4, 1, at_once=1)
    assert len(short) == 5 and [v is None for *_, v in short] == [False, True, False, False, False]
    told = bs.search(spark, objective, path, 4, 5, at_once=1)
    assert told[:5] == short and len(ran) == 9
    assert max(v for *_, v in told[4:]) >= max(v for *_, v in told[:4] if v is not None)
    assert bs.search(spark, objective, path, 4, 5, at_once=1) == told and len(ran) == 9
    with pytest.raises(ValueError, match="no trial"):
        bs.search(spark, lambda s: 1 / 0, stores.new_folder(spark, "bayes"), 2, 1)


def test_boosted_trees_are_tuned_and_stored(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (160, 2))
    y = x[:, 0] * x[:, 1] > 0
    rows = [(i, "Case" if y[i] else "Control", f"f{j}", float(x[i, j]), ("train", "train", "test", "valid")[i % 4]) for i in range(160) for j in range(2)]
    long = spark.createDataFrame(rows, "sample_id bigint, class string, feature string, value double, mix string")
    path = stores.new_folder(spark, "boosted-search")
    told = bs.boosted_trees(long, ["f0", "f1"], F.floor(F.col("sample_id") / 4) % 2, 2, path, first=2, further=1, rounds=4).orderBy("trial").collect()
    assert [r.trial for r in told] == [0, 1, 2] and all(0 <= r.value <= 1 for r in told)
    (best,) = [r for r in told if r.chosen]
    assert best.value == max(r.value for r in told) and best.train_accuracy > 0.7 and best.valid_accuracy is not None
    assert GBTClassificationModel.load(best.model).getMaxIter() == 4
