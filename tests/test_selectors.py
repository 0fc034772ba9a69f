"""Discretisation and the searches on its bins against plain recursion and exhaustive search; sums of values far from zero against numpy; ranks within groups against sorting."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.operators import discretise, expression, ranks, tables


def entropy(labels):
    n = len(labels)
    return -sum(c / n * math.log2(c / n) for c in (labels.count(x) for x in set(labels))) if n else 0.0


def recursion(rows):
    """Cuts of sorted (value, label) rows."""
    labels = [y for _, y in rows]
    whole, n, best = entropy(labels), len(rows), None
    for i in range(1, n):
        if rows[i - 1][0] < rows[i][0]:
            h = round((i * entropy(labels[:i]) + (n - i) * entropy(labels[i:])) / n, 12)
            if best is None or h < best[0]:
                best = (h, i)
    if best is None or len(set(labels)) < 2:
        return []
    h, i = best
    kinds = lambda x: len(set(x))
    cost = math.log2(3 ** kinds(labels) - 2) - (kinds(labels) * whole - kinds(labels[:i]) * entropy(labels[:i]) - kinds(labels[i:]) * entropy(labels[i:]))
    if whole - h <= (math.log2(n - 1) + cost) / n:
        return []
    return [*recursion(rows[:i]), (rows[i - 1][0] + rows[i][0]) / 2, *recursion(rows[i:])]


@pytest.fixture(scope="module")
def table():
    rng = random.Random(2)
    rows = {}
    for s in range(300):
        y = int(rng.random() < 0.4)
        a, b = rng.gauss(1.5 * y, 1), rng.gauss(0, 1)
        rows[s] = (y, {"f0": a, "f1": a + rng.gauss(0, 0.2), "f2": b, "f3": abs(b) + y * (rng.random() < 0.5), "f4": float(rng.randrange(3) + (s % 7 == 0) * y), "f5": (-1) ** y * rng.random() * (rng.random() < 0.7), "f6": float(rng.randrange(2)), "f7": 1.0, "f8": (s % 5) * 0.2 + (0.9 if y else -0.9) * (s % 3)})
    return rows


@pytest.fixture(scope="module")
def long(spark, table):
    rows = [(s, "Case" if y else "Control", f, None if f == "f2" and s % 11 == 0 else v, 3) for s, (y, values) in table.items() for f, v in values.items()]
    return spark.createDataFrame(rows, "sample_id bigint, class string, feature string, value double, bin int").persist()


def brute_cuts(table):
    out = {}
    for f in table[0][1]:
        out[f] = recursion(sorted((v[f], y) for s, (y, v) in table.items() if not (f == "f2" and s % 11 == 0)))
    return out


def test_cuts_equal_a_recursion(long, table, monkeypatch):
    want = {f: c for f, c in brute_cuts(table).items() if c}
    assert any(len(c) > 1 for c in want.values()) and "f7" not in want
    for buckets in (64, 3):
        monkeypatch.setattr(ranks.in_buckets, "__defaults__", (buckets,))
        got = {}
        for r in discretise.mdl_cuts(long).collect():
            got.setdefault(r.feature, []).append(r.cut)
        assert set(got) == set(want)
        for f, c in want.items():
            assert sorted(got[f]) == pytest.approx(c)
    assert discretise.mdl_cuts(long.where("false")).count() == 0
    assert discretise.mdl_cuts(long.where("class = 'Case'")).count() == 0


def uncertainty(x, y):
    hx, hy, hxy = entropy(x), entropy(y), entropy(list(zip(x, y, strict=True)))
    return 2 * (hx + hy - hxy) / (hx + hy) if hx + hy else 0.0


def brute_su(table):
    cuts = brute_cuts(table)
    kept = {f: {s for s in table if not (f == "f2" and s % 11 == 0)} for f in cuts}
    bins = {f: {s: sum(c < table[s][1][f] for c in cuts[f]) for s in kept[f]} for f in cuts}
    to_class = {f: uncertainty([bins[f][s] for s in sorted(kept[f])], [table[s][0] for s in sorted(kept[f])]) for f in cuts}
    both = {}
    for a, b in itertools.combinations(sorted(f for f in cuts if cuts[f]), 2):
        on = sorted(kept[a] & kept[b])
        both[a, b] = uncertainty([bins[a][s] for s in on], [bins[b][s] for s in on])
    return to_class, both


def merit(chosen, to_class, both):
    k = len(chosen)
    return sum(to_class[f] for f in chosen) / math.sqrt(k + 2 * sum(both[p] for p in itertools.combinations(sorted(chosen), 2)))


def test_uncertainties_and_searches(long, table):
    to_class, both = brute_su(table)
    cuts = discretise.mdl_cuts(long).persist()
    assert {r.feature: r.su for r in discretise.su_mdl(long, cuts).collect()} == pytest.approx(to_class)
    assert {(r.feature_a, r.feature_b): r.su for r in discretise.su_pairs(long, cuts).collect()} == pytest.approx(both)
    usable = sorted(f for f, x in to_class.items() if x > 0)
    best = max((merit(c, to_class, both), c) for k in range(1, len(usable) + 1) for c in itertools.combinations(usable, k))
    got = discretise.best_first_cfs(long).collect()
    assert got[0].merit == pytest.approx(best[0]) and sorted(r.feature for r in got) == sorted(best[1])
    chosen = []
    while True:
        options = [(merit([*chosen, f], to_class, both), f) for f in usable if f not in chosen]
        if not options or (chosen and max(options)[0] <= merit(chosen, to_class, both) + 1e-12):
            break
        chosen.append(max(options)[1])
    forward = discretise.forward_cfs_mdl(long).orderBy("rank").collect()
    assert [r.feature for r in forward] == chosen
    assert [r.merit for r in forward] == pytest.approx([merit(chosen[: i + 1], to_class, both) for i in range(len(chosen))])
    top = discretise.auc_mdl(long, 9, cuts).orderBy("rank").collect()
    assert len(top) == 9 and top[-1].auc == 0.5 and top[0].auc > 0.7
    assert discretise.best_first_cfs(long.where("false")).count() == discretise.forward_cfs_mdl(long.where("false")).count() == 0


def test_sums_of_values_far_from_zero(spark):
    rng = np.random.default_rng(5)
    n = 400
    for offset in (0.0, 1e6, 1e8):
        x = offset + rng.exponential(1.0, (n, 4))
        x[:, 1] = x[:, 0] * 0.5 + offset / 2 + rng.normal(0, 1, n)
        rows = [(i, "Case" if i % 3 == 0 else "Control", f"f{j}", float(x[i, j])) for i in range(n) for j in range(4)]
        long = spark.createDataFrame(rows, "sample_id bigint, class string, feature string, value double")
        for r in expression.describe(long).collect():
            v = x[:, int(r.feature[1])]
            c, sd = v - v.mean(), v.std(ddof=1)
            assert (r.skew, r.kurtosis) == pytest.approx(((c**3).mean() / sd**3, (c**4).mean() / sd**4 - 3), rel=1e-7)
        want = np.corrcoef(x.T)
        for block in (512, 2):
            g = expression.gram(long, block=block)
            c, va, vb = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n"), F.col("saa") - F.col("sa") ** 2 / F.col("n"), F.col("sbb") - F.col("sb") ** 2 / F.col("n")
            got = g.select("feature_a", "feature_b", (c / F.sqrt(va * vb)).alias("r")).collect()
            assert len(got) == 6
            for r in got:
                assert r.r == pytest.approx(want[int(r.feature_a[1]), int(r.feature_b[1])], rel=1e-8, abs=1e-8)
        for r in tables.distances(long).collect():
            a, b = int(r.feature_a[1]), int(r.feature_b[1])
            assert r.distance == pytest.approx(np.linalg.norm(x[:, a] - x[:, b]), rel=1e-8)
        case = np.arange(n) % 3 == 0
        for r in tables.fisher_pairs(long).collect():
            v = x[:, [int(r.feature_a[1]), int(r.feature_b[1])]]
            s = (np.cov(v[case].T) * (case.sum() - 1) + np.cov(v[~case].T) * ((~case).sum() - 1)) / (n - 2)
            d = v[case].mean(0) - v[~case].mean(0)
            assert r.criterion == pytest.approx(d @ np.linalg.solve(s, d), rel=1e-5)


def test_a_repeated_feature_counts_with_its_smallest_value(spark):
    rows = [(i, "Case", f, float(v)) for i in range(6) for f, v in (("a", i), ("b", i * i), ("b", i * i + 5), ("b", i * i + 1))]
    long = spark.createDataFrame(rows, "sample_id bigint, class string, feature string, value double").repartition(5)
    mean = sum(i * i + 2 for i in range(6)) / 6
    r = expression.gram(long).first()
    assert (r.n, r.sb) == (6, pytest.approx(sum(i * i - mean for i in range(6))))


def test_ranks_and_medians_in_any_number_of_buckets(spark):
    rng = random.Random(9)
    rows = [(g, rng.choice([1.0, 2.5, rng.random(), None, 1e9]), i) for g in "abc" for i in range(120)] + [("d", None, 1), ("e", 4.0, 1), ("f", 7.0, 1), ("f", 9.0, 2)]
    table = spark.createDataFrame(rows, "g string, v double, i int")
    for buckets in (1, 7, 64):
        got = {(r.g, r.i): r.r for r in ranks.ranked(table, ("g",), "v", "r", ("i",), buckets).collect()}
        for g in "abcef":
            inside = sorted((v, i) for h, v, i in rows if h == g and v is not None)
            assert [got[g, i] for _, i in inside] == list(range(1, len(inside) + 1))
    got = {r.g: (r.m, r.low) for r in ranks.medians(table, ("g",), m=F.col("v"), low=F.when(F.col("v") < 3, F.col("v"))).collect()}
    for g in "abcef":
        v = [v for h, v, _ in rows if h == g and v is not None]
        low = [x for x in v if x < 3]
        assert got[g] == (np.median(v), np.median(low) if low else None)


def test_buckets_are_the_same_for_any_partitions(spark):
    """Plans work them out more than once, with tasks that end in any order; a group with few values often repeated keeps its rows."""
    rows = spark.range(240_000).select((F.col("id") % 2).alias("g"), (F.hash("id") / 7.0).alias("v")).union(spark.range(9_000).select(F.lit(2), F.lit(1.5))).union(spark.range(5).select(F.lit(3), F.lit(None).cast("double")))
    for buckets in (32, 100):
        dealt = [ranks.in_buckets(rows.repartition(n, F.hash("v", F.lit(n))), ("g",), "v", buckets).groupBy("g", "_b").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("g", "_b").collect() for n in (3, 16)]
        assert dealt[0] == dealt[1]
        n = [r.n for r in dealt[0] if r.g < 2]
        assert len(n) == 2 * buckets and max(n) < 1.7 * 120_000 / buckets
        assert [(r.g, r.n) for r in dealt[0] if r.g > 1] == [(2, 9_000), (3, 5)]


def proximal(x, y, lam, mix, steps=60_000):
    """The penalised logistic model by accelerated proximal gradients on standardised features; coefficients as given."""
    mean, sd = x.mean(0), x.std(0)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / sd])
    rate = 4 * len(x) / np.linalg.norm(z, 2) ** 2
    b = np.zeros(z.shape[1])
    v, t = b.copy(), 1.0
    l1, l2 = np.r_[0, np.full(x.shape[1], lam * mix)], np.r_[0, np.full(x.shape[1], lam * (1 - mix))]
    for _ in range(steps):
        g = z.T @ (1 / (1 + np.exp(-(z @ v))) - y) / len(x)
        u = v - rate * g
        new = np.sign(u) * np.maximum(np.abs(u) - rate * l1, 0) / (1 + rate * l2)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - b)
        if np.abs(new - b).max() < 1e-13:
            break
        b, t = new, t2
    slope = b[1:] / sd
    return np.r_[b[0] - slope @ mean, slope]


@pytest.mark.parametrize("mix", [1.0, 0.4])
def test_penalty_path_equals_another_solver(spark, monkeypatch, mix):
    from helixmill.operators import penalised

    rng = np.random.default_rng(3)
    n, p, folds = 240, 6, 4
    x = rng.normal(0, 1, (n, p)) * [1, 2, 0.1, 5, 1, 1] + [0, 3, 0, -8, 0, 100]
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.8 * (x[:, 1] - 3) + 6 * x[:, 2])))).astype(float)
    rows = [(i, "Case" if y[i] else "Control", f"f{j}", float(x[i, j])) for i in range(n) for j in range(p)] + [(n + 1, "Case", "f0", 1.0)]
    long = spark.createDataFrame(rows, "sample_id bigint, class string, feature string, value double")
    monkeypatch.setattr(penalised, "BYTES", 4_000)  # several blocks of penalties
    monkeypatch.setattr(penalised, "ROWS", 100)  # and tasks
    path = penalised.penalty_path(long, F.col("sample_id") % folds, folds, mix, n_penalties=7, least=1e-2)
    assert not path.coefficients[0, 1:].any() and path.coefficients[-1, 1:4].all()
    fold = np.arange(n) % folds
    for i, lam in enumerate(path.penalties):
        assert path.coefficients[i] == pytest.approx(proximal(x, y, lam, mix), abs=1e-4)
        dev = []
        for k in range(folds):
            b = proximal(x[fold != k], y[fold != k], lam, mix)
            mu = 1 / (1 + np.exp(-(b[0] + x[fold == k] @ b[1:])))
            dev.append(-2 * np.mean(np.log(np.where(y[fold == k] == 1, mu, 1 - mu))))
        assert path.deviance[i] == pytest.approx(np.mean(dev), abs=1e-4)
        assert path.error[i] == pytest.approx(np.std(dev) / math.sqrt(folds - 1), abs=1e-4)
    assert path.least == path.deviance.argmin() and path.sparse <= path.least
    got = penalised.chosen(spark, path, path.least).collect()
    assert "f2" in {r.feature for r in got} and [abs(r.coefficient) for r in got] == sorted((abs(r.coefficient) for r in got), reverse=True)
    with pytest.raises(ValueError, match="both classes"):
        penalised.penalty_path(long.where("class = 'Case'"), F.col("sample_id") % folds, folds)


def left_out(x, y):
    """Accuracy of discriminants fitted again without each sample."""
    right = 0
    for i in range(len(y)):
        xs, ys = np.delete(x, i, 0), np.delete(y, i)
        means = [xs[ys == g].mean(0) for g in (0, 1)]
        s = sum((xs[ys == g] - means[g]).T @ (xs[ys == g] - means[g]) for g in (0, 1)) / (len(ys) - 2)
        d = [math.log((ys == g).mean()) - 0.5 * (x[i] - means[g]) @ np.linalg.solve(s, x[i] - means[g]) for g in (0, 1)]
        right += (d[1] >= d[0]) == (y[i] == 1)
    return right / len(y)


def test_discriminants_equal_refitting_each_left_out_sample(spark, monkeypatch):
    from helixmill.operators import discriminant

    rng = np.random.default_rng(8)
    n, p = 70, 6
    y = (np.arange(n) % 3 == 0).astype(int)
    x = rng.normal(0, 1, (n, p)) + np.outer(y, [0.8, 0, 1.0, 0.3, 0, 0]) + [0, 1e5, 3, 0, 0, 0]
    x[:, 4] = x[:, 0] * 2  # no set with both can be inverted
    rows = [(i, "Case" if y[i] else "Control", f"f{j}", float(x[i, j])) for i in range(n) for j in range(p)] + [(n, "Case", "f0", 1.0)]
    long = spark.createDataFrame(rows, "sample_id bigint, class string, feature string, value double").repartition(3)
    monkeypatch.setattr(discriminant, "CELLS", 500)
    want = {s: left_out(x[:, s], y) for k in (1, 2, 3) for s in itertools.combinations(range(p), k) if not {0, 4} <= set(s)}
    got = discriminant.fisher_beam(long, 3, 4).collect()
    beam = [()]
    for turn in (1, 2, 3):
        sets = sorted({tuple(sorted((*s, j))) for s in beam for j in range(p) if j not in s} & set(want))
        beam = sorted(sets, key=lambda s: (-round(want[s], 12), s))[:4]
        told = sorted((r for r in got if r.turn == turn), key=lambda r: r.rank)
        assert [tuple(int(f[1]) for f in r.features) for r in told] == beam
        assert [r.accuracy for r in told] == pytest.approx([want[s] for s in beam])
    steps = discriminant.step_lda(long, 0.001).orderBy("step").collect()
    now, best = set(), max(y.mean(), 1 - y.mean())
    for r in steps:
        now ^= {int(r.feature[1])}
        assert r.action == ("in" if int(r.feature[1]) in now else "out") and r.accuracy > best
        assert r.accuracy == pytest.approx(left_out(x[:, sorted(now)], y))
        best = r.accuracy
    assert 0 in now or 2 in now or 4 in now
    assert discriminant.step_lda(long, 2.0).count() == 0
    with pytest.raises(ValueError, match="two samples"):
        discriminant.fisher_beam(long.where("class = 'Case'"))


def test_exact_tails(spark):
    """Chi-squared tails against closed forms and a fine quadrature, binomial tails against sums of whole numbers."""
    from helixmill.functions import stats

    rows = [(x, df) for df in (1, 2, 3, 4, 7, 30, 101, 1_000) for x in (0.0, 1e-3, 0.5, df * 0.7, float(df), df + 2.0, df * 1.5 + 9, df * 2.0 + 60)]
    table = spark.createDataFrame(rows, "x double, df bigint").withColumn("p", stats.chi_squared_upper(F.col("x"), F.col("df")))
    for r in table.collect():
        h = r.x / 2
        if r.df % 2 == 0:
            want = math.fsum(math.exp(-h + i * math.log(h) - math.lgamma(i + 1)) if h else float(i == 0) for i in range(r.df // 2))
        else:
            want = math.erfc(math.sqrt(h)) + math.fsum(math.exp(-h + (i + 0.5) * math.log(h) - math.lgamma(i + 1.5)) if h else 0.0 for i in range(r.df // 2))
        assert r.p == pytest.approx(want, rel=1e-9, abs=1e-14)
    assert spark.range(1).select(stats.chi_squared_upper(F.lit(2.0), F.lit(0)).alias("p")).first().p is None
    rows = [(k, n) for n in (0, 1, 2, 7, 20, 101, 2_000) for k in sorted({0, n // 7, n // 3, n // 2, (n + 1) // 2, n - n // 5, n})]
    for r in spark.createDataFrame(rows, "k bigint, n bigint").withColumn("p", stats.binomial_even(F.col("k"), F.col("n"))).collect():
        few = min(r.k, r.n - r.k)
        want = 1.0 if 2 * few >= r.n else min(1.0, 2 * sum(math.comb(r.n, i) for i in range(few + 1)) / 2**r.n)
        assert r.p == pytest.approx(want, rel=1e-10)


def test_boosting_equals_a_plain_loop(spark):
    from helixmill.operators import boosting, models

    rng = np.random.default_rng(6)
    n, p, b = 200, 5, 4
    x = rng.normal(0, 1, (n, p)) * [1, 3, 0.2, 1, 0] + [0, 10, 5, -1, 2]
    y = (rng.random(n) < 1 / (1 + np.exp(-2 * x[:, 0] + 6 * (x[:, 2] - 5)))).astype(float)
    rows = [(i, "Case" if y[i] else "Control", f"f{j}", float(x[i, j])) for i in range(n) for j in range(p)] + [(n, "Case", "f0", 1.0)]
    long = spark.createDataFrame(rows, "sample_id bigint, class string, feature string, value double").repartition(3)
    w = np.array([r.w for r in boosting.weighted(models.vectors(long)[0], b, 1).orderBy("sample_id").collect()], float)
    assert w.shape == (n, b + 1) and (w[:, 0] == 1).all() and abs(w[:, 1:].mean() - 1) < 0.15 and w.max() >= 3
    names, got = boosting.paths(long, b, rounds=30, patience=4)
    sd = x.std(0, ddof=1)
    z = (x - x.mean(0)) / np.where(sd > 0, sd, 1)
    for k in range(b + 1):
        v = w[:, k]
        share = (v * y).sum() / v.sum()
        base, beta, best, kept, since = math.log(share / (1 - share)), np.zeros(p), math.inf, None, 0
        for _ in range(31):
            eta = base + z @ beta
            mu = 1 / (1 + np.exp(-eta))
            aic = -2 * (v * np.log(np.where(y == 1, mu, 1 - mu))).sum() + 2 * (beta != 0).sum()
            if aic < best - 1e-9:
                best, kept, since = aic, beta.copy(), 0
            else:
                since += 1
            if since >= 4:
                break
            g, h = z.T @ (v * (y - mu)), (z * z).T @ v
            j = int(np.argmax(np.where(h > 1e-9, g * g / np.maximum(h, 1e-9), 0)))
            beta = beta.copy()
            beta[j] += 0.4 * g[j] / h[j]
        assert got[:, k] == pytest.approx(kept, abs=1e-9)
    rows = boosting.stability(long, bootstraps=b, rounds=30).collect()
    assert {"f0", "f2"} <= {r.feature for r in rows} and "f4" not in {r.feature for r in rows}
    with pytest.raises(ValueError, match="both classes"):
        boosting.stability(long.where("class = 'Case'"))
