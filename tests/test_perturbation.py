"""Neighbours' accuracies against brute force, and weights that find what tells."""

import numpy as np
import pytest

from helixmill.operators import perturbation as pt


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (400, 8)) * [1, 1, 1, 1, 30, 1, 1, 0] + 2
    x[:, 3] = np.round(x[:, 3])  # ties
    return x, x[:, 0] + x[:, 4] / 30 > 2 + 2 / 30


@pytest.fixture(scope="module")
def long(spark, numbers):
    x, y = numbers
    rows = [(i, "Case" if y[i] else "Control", f"f{j}", float(x[i, j])) for i in range(400) for j in range(8)] + [(500, "Case", "f0", 1.0)]
    return spark.createDataFrame(rows, "sample_id bigint, class string, feature string, value double").repartition(5).persist()


@pytest.mark.parametrize("asked", [10_000, 90])
def test_accuracies_equal_brute_force(long, monkeypatch, asked):
    monkeypatch.setattr(pt, "CELLS", 20_000)
    monkeypatch.setattr(pt, "CHUNK", 64)
    samples = pt.Neighbours(long, 5)
    sets = [(0, 4), (3,), (7,), tuple(range(8)), (1, 2, 3, 5)]
    try:
        queries = samples.drawn(asked, 1, 0)
        got = samples.accuracies(sets, queries)
        rows = samples.rows.collect()
    finally:
        samples.close()
    n = len(queries[0])
    assert len(rows) == 400 and (n == 400 if asked > 400 else 50 < n < 140)
    x, h, y = (np.array([r.x for r in rows]) - samples.mean) / samples.scale, np.array([r.h for r in rows]), np.array([r.y for r in rows])
    for s, share in zip(sets, got, strict=True):
        right = 0
        for a, label, point in zip(*queries, strict=True):
            d = np.round(((x[:, s] - point[list(s)]) ** 2).sum(1), 7)
            near = [j for j in np.lexsort((h, d)) if h[j] != a][:5]
            right += (2 * y[near].sum() >= 5) == (label == 1)
        assert share == pytest.approx(right / n, abs=0.011 if s == (3,) else 1e-12)


def test_gain_and_choice():
    assert pt.chosen(np.array([0.2, 0.4, 0.1])) == (1,) and pt.chosen(np.array([0.5, 0.4, 0.9])) == (0, 2)
    assert pt.gain(np.zeros(2), np.ones(2), 0.7) == 0.7 and pt.gain(np.ones(2), np.zeros(2), 0.7) == 0.7
    assert pt.gain(np.ones(2), np.ones(2), 0.7) == 1 and pt.gain(np.ones(2), np.full(2, 0.1), 0.7) == 2 and pt.gain(np.ones(2), np.full(2, 99.0), 0.7) == 0.1


def test_weights_find_what_tells(spark, long):
    names, found, steps = pt.weights(long, iterations=8, slopes=6, queries=200)
    again = pt.weights(long.repartition(2), iterations=8, slopes=6, queries=200)
    assert again[2] == steps and (again[1] == found).all()
    assert len(steps) == 9 and max(s[2] for s in steps) > steps[0][2]
    rest = [found[i] for i, f in enumerate(names) if f not in ("f0", "f4")]
    assert min(found[0], found[4]) > np.mean(rest)
    rows = pt.ranked(long, most=3, iterations=8, slopes=6, queries=200).collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and {"f0", "f4"} <= {r.feature for r in rows}
    with pytest.raises(ValueError, match="both classes"):
        pt.ranked(long.where("class = 'Case'"))
    with pytest.raises(ValueError, match="both classes"):
        pt.ranked(long.limit(0))
