"""Accuracies of feature sets against discriminants fitted by hand; what the searches find."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.operators import search


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (240, 9)) * [1, 2, 0.1, 1, 1, 5, 1, 1, 0] + [0, 1000, 0, 0, 3, 0, 0, 0, 4]
    y = x[:, 0] + (x[:, 1] - 1000) / 2 + 10 * x[:, 2] + rng.normal(0, 0.4, 240) > 0.5
    return x, y


@pytest.fixture(scope="module")
def long(spark, numbers):
    x, y = numbers
    rows = [(i, "Case" if y[i] else "Control", f"f{j}", float(x[i, j])) for i in range(240) for j in range(9)] + [(500, "Case", "f0", 1.0), (501, "Case", "f1", None)]
    return spark.createDataFrame(rows, "sample_id bigint, class string, feature string, value double").repartition(3).persist()


def fold():
    return F.col("sample_id") % 4


def by_hand(x, y, chosen, train, held):
    a, b = x[train & ~y][:, chosen], x[train & y][:, chosen]
    scale = x.std(0, ddof=1)[list(chosen)]
    scale = np.where(scale > 0, scale, 1)
    a, b, z = a / scale, b / scale, x[held][:, chosen] / scale
    within = ((a - a.mean(0)).T @ (a - a.mean(0)) + (b - b.mean(0)).T @ (b - b.mean(0))) / (len(a) + len(b) - 2)
    beta = np.linalg.solve(within + 1e-6 * np.eye(len(chosen)), b.mean(0) - a.mean(0))
    return ((z - (a.mean(0) + b.mean(0)) / 2) @ beta + np.log(len(b) / len(a)) >= 0) == y[held]


def test_accuracies_equal_discriminants_by_hand(long, numbers):
    x, y = numbers
    f, samples = np.arange(240) % 4, search.Folds(long, fold(), 4)
    asked = [[(0, 1, 2), (3,), (0, 8)], [(0, 1, 2)], [(4, 5)], [tuple(range(9))], [(0, 1, 2), (5, 6, 7)]]
    try:
        told = samples.judge(asked)
    finally:
        samples.close()
    for r, sets in enumerate(asked):
        assert set(told[r]) == set(sets)
        for s in sets:
            inner = np.concatenate([by_hand(x, y, s, (f != r) & (f != k), f == k) for k in range(4) if k != r])
            assert told[r][s][0] == pytest.approx(inner.mean(), abs=1e-12)
            assert told[r][s][1] == (None if r == 4 else pytest.approx(by_hand(x, y, s, f != r, f == r).mean(), abs=1e-12))


def test_generations():
    rng = np.random.default_rng(0)
    told = {(0,): (0.9, None), (1, 2): (0.5, None), (0, 3): (0.9, None), (4,): (0.1, None)}
    for _ in range(50):
        new = search.bred(list(told), told, 5, rng, 0.8, 0.5)
        assert new[0] == (0,) and len(new) == 4 and all(s and set(s) <= set(range(5)) for s in new)
    same = search.bred(list(told), told, 5, rng, 0.0, 0.0)
    assert set(same) <= set(told)
    assert search.accepts(0.6, 0.5, 9, 0.99) and not search.accepts(0.4, 0.5, 9, 0.99) and search.accepts(0.4, 0.5, 1, 0.8)


def test_genetic_search_finds_what_tells(spark, long):
    found = search.genetic(long, fold(), 4, generations=6, population=16)
    again = search.genetic(long.repartition(7, "value"), fold(), 4, generations=6, population=16)
    assert found.steps == again.steps and found.chosen == again.chosen
    assert {"f0", "f1", "f2"} <= {r.feature for r in found.features(spark).collect()}
    rows = found.history(spark).collect()
    assert len(rows) == 30 and {r.external is None for r in rows if r.run == 4} == {True}
    for run in range(5):
        best = [r.internal for r in sorted(rows, key=lambda r: r.step) if r.run == run]
        assert best == sorted(best)  # the best set stays
    means = {g: np.mean([r.external for r in rows if r.step == g and r.run < 4]) for g in range(1, 7)}
    assert {r.step for r in rows if r.chosen} == {max(means, key=lambda g: (round(means[g], 12), -g))}


def test_annealing_improves_and_goes_back(spark, long):
    found = search.annealing(long, fold(), 4, iterations=12, chains=6, improve=3)
    rows = found.history(spark).collect()
    assert len(rows) == 60
    best = {r.run: [] for r in rows}
    for r in sorted(rows, key=lambda r: r.step):
        best[r.run].append(r.internal)
    assert all(max(x) > x[0] - 1e-12 for x in best.values()) and np.mean([max(x) - x[0] for x in best.values()]) > 0
    one = search.annealing(long.where("feature = 'f0'"), fold(), 4, iterations=2, chains=2)
    assert one.chosen == (0,)


def test_odd_tables(spark, long):
    with pytest.raises(ValueError, match="three folds"):
        search.genetic(long, fold(), 2)
    with pytest.raises(ValueError, match="no sample"):
        search.genetic(long.limit(0), fold(), 4)
    with pytest.raises(ValueError, match="two samples"):
        search.annealing(long.where("class = 'Case'"), fold(), 4)
