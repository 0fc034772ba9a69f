"""Predictive mean matching against a plain loop over regressions and donors."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from helixmill.operators import imputation


def uniform(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:7], 16) / 2**28


def brute(seen, rounds, donors, seed):
    """(samples, features) with nan for what is missing; the features are few, so every round is one pass."""
    means = np.nanmean(seen, axis=0)
    x = np.where(np.isnan(seen), means, seen)
    for k in range(rounds):
        new = x.copy()
        for j in range(x.shape[1]):
            there = ~np.isnan(seen[:, j])
            if there.all():
                continue
            z = np.hstack([np.ones((len(x), 1)), np.delete(x - means, j, axis=1)])
            slope = np.linalg.lstsq(z[there], x[there, j] - means[j], rcond=None)[0]
            told = z @ slope
            for i in np.flatnonzero(~there):
                near = sorted((abs(told[d] - told[i]), d) for d in np.flatnonzero(there))[:donors]
                new[i, j] = x[near[int(uniform(seed, k, "donor", j, i) * len(near))][1], j]
        x = new
    return x


@pytest.mark.parametrize("bucket", [200_000, 40])
def test_imputation_equals_a_plain_loop(spark, monkeypatch, bucket):
    monkeypatch.setattr(imputation, "BUCKET", bucket)
    rng = np.random.default_rng(4)
    n = 160
    x = rng.normal(0, 1, (n, 4)) + [0, 5, -3, 100]
    x[:, 1] += 2 * x[:, 0]
    x[:, 3] -= x[:, 1]
    gone = rng.random((n, 4)) < [0.2, 0.1, 0.0, 0.3]
    seen = np.where(gone, np.nan, x)
    rows = [(i, f"f{j}", None if gone[i, j] else float(x[i, j]), 1) for i in range(n) for j in range(4)] + [(i, "none", None, 2) for i in range(3)]
    table = spark.createDataFrame(rows, "sample_id bigint, feature string, value double, x int").repartition(3)
    got = {(r.sample_id, r.feature): r.value for r in imputation.impute_pmm(table, rounds=2, seed=7).collect()}
    assert len(got) == len(rows) and all(got[i, "none"] is None for i in range(3))
    want = brute(seen, 2, 5, 7)
    wrong = 0
    for i in range(n):
        for j in range(4):
            if gone[i, j]:
                assert got[i, f"f{j}"] in set(seen[~gone[:, j], j])
                wrong += got[i, f"f{j}"] != pytest.approx(want[i, j])
            else:
                assert got[i, f"f{j}"] == x[i, j]
    assert wrong == 0
    assert imputation.impute_pmm(table.where("false")).count() == 0


def test_donors_with_ties():
    rng = random.Random(3)
    rows = [(i, rng.choice([0.0, 1.0, 1.5, rng.random()]), None if i % 4 == 0 else float(i), rng.random()) for i in range(120)]
    block = pd.DataFrame(rows, columns=["sample_id", "predicted", "value", "u"])
    got = imputation.nearest_donors(block, 5).set_index("sample_id").value
    for i, s, v, u in rows:
        if v is None:
            near = sorted((abs(p - s), d, w) for d, p, w, _ in rows if w is not None)[:5]
            assert got[i] == near[int(u * 5)][2]
    few = imputation.nearest_donors(block[block.sample_id < 4], 5)
    assert few.value.isin([1.0, 2.0, 3.0]).all()
