"""Networks against numeric derivatives and a plain loop; dropout, early stopping, autoencoders, transfer and stored models."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from helixmill.operators import networks as nets
from helixmill.sources import stores


@pytest.fixture(scope="module")
def long(spark):
    """Class by the product of two features' signs, which no straight line tells; f2 is noise on another scale, f3 constant."""
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(0, 1, (360, 2)), rng.normal(50, 9, 360), np.ones(360)])
    y = x[:, 0] * x[:, 1] > 0
    rows = [(i, "Case" if y[i] else "Control", f"f{j}", float(x[i, j]), ("train", "train", "test", "valid")[i % 4]) for i in range(360) for j in range(4)]
    rows += [(900, "Case", "f0", 1.0, "train"), (901, "Case", "f0", None, "test")]
    return spark.createDataFrame(rows, "sample_id bigint, class string, feature string, value double, mix string").repartition(3).persist()


@pytest.mark.parametrize("kind", ["class", "copy"])
@pytest.mark.parametrize("activation", [a for a in nets.ACTIVATIONS if a != "linear"])
def test_gradients_equal_differences(kind, activation):
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(0, 1, (20, 4)), (rng.random(20) < 0.5).astype(float), rng.random(20) + 0.5
    out = 1 if kind == "class" else 4
    layers = (nets.dense(rng, 4, 6, activation, 0.3), replace(nets.dense(rng, 6, 5, "tanh"), frozen=True), nets.dense(rng, 5, 3, activation), nets.dense(rng, 3, out, "linear"))
    layers = tuple(replace(x, bias=rng.normal(0, 0.3, x.bias.size)) for x in layers)  # no unit rests where relu has no derivative
    drop = nets.masks(layers, (1, 2, 3), np.arange(20, dtype="u8") * np.uint64(7919))
    assert drop[1] is None and set(np.unique(drop[0]).round(9)) == {0, round(1 / 0.7, 9)}
    _, got = nets.gradients(layers, kind, x, y, w, drop)
    flat, want = nets._flat(layers), []
    for i in range(len(flat)):
        side = []
        for d in (1e-6, -1e-6):
            moved = flat.copy()
            moved[i] += d
            out_, _ = nets.forward(nets._with(layers, moved), x, drop)
            side.append((nets.losses(kind, out_, x, y)[0] * w).sum())
        want.append((side[0] - side[1]) / 2e-6)
    assert len(got) == len(flat) and got == pytest.approx(np.array(want), abs=2e-5)


def test_masks_keep_their_share():
    layer = nets.dense(np.random.default_rng(0), 3, 40, "relu", 0.25)
    samples = np.arange(5_000, dtype="u8")
    (a,), (b,) = nets.masks((layer,), (1, 0, 0), samples), nets.masks((layer,), (1, 1, 0), samples)
    assert abs((a == 0).mean() - 0.25) < 0.005 and abs(((a == 0) == (b == 0)).mean() - (0.25**2 + 0.75**2)) < 0.01
    assert np.abs((a == 0).mean(0) - 0.25).max() < 0.03
    assert (nets.masks((layer,), (1, 0, 0), samples[100:200])[0] == a[100:200]).all()  # whatever other samples a task has


def plain(long, shape, epochs, patience, rate, seed):
    """A single loop in numpy."""
    names = ("f0", "f1", "f2", "f3")
    rows = nets.matrix(long, names).select("sample_id", F.xxhash64(F.col("sample_id").cast("string")).alias("h"), "label", "mix", vector_to_array("v").alias("x")).orderBy("sample_id").collect()
    x, y, mix, h = np.array([r.x for r in rows]), np.array([r.label for r in rows], float), np.array([r.mix for r in rows]), np.array([r.h for r in rows]).view("u8")
    mean, sd = x[mix == "train"].mean(0), x[mix == "train"].std(0, ddof=1)
    x = (x - mean) / np.where(sd > 0, sd, 1)
    layers = nets.classifier(shape, 4, np.random.default_rng([seed, 0]))
    t, e, n = mix == "train", mix == "test", (mix == "train").sum()
    m = v = 0
    best, since = (None, np.inf, 0), 0
    for epoch in range(epochs + 1):
        watched = nets.losses("class", nets.forward(layers, x[e])[0], x[e], y[e])[0].mean()
        best, since = ((layers, watched, epoch), 0) if watched < best[1] - 1e-9 else (best, since + 1)
        if since >= patience:
            break
        g = nets.gradients(layers, "class", x[t], y[t], np.ones(n), nets.masks(layers, (seed, epoch, 0), h[t]))[1] / n
        g = g + np.concatenate([np.concatenate([layer.l1 * np.sign(layer.weights).ravel(), np.zeros(layer.bias.size)]) for layer in layers])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        layers = nets._with(layers, nets._flat(layers) - rate * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.999 ** (epoch + 1))) + 1e-8))
    return best


def test_training_equals_a_plain_loop(long):
    shape = nets.Shape((6, 3), "tanh", (0.2,), (True,))
    (got,), failed = nets.train(long, {"a": shape}, epochs=12, patience=3, rate=0.05)
    layers, loss, at = plain(long, shape, 12, 3, 0.05, 1)
    assert not failed and got.epochs == at and got.loss == pytest.approx(loss, rel=1e-9)
    assert nets._flat(got.layers) == pytest.approx(nets._flat(layers), rel=1e-7, abs=1e-9)


@pytest.fixture(scope="module")
def grid(long):
    shapes = {"wide": nets.Shape((12, 6), "relu"), "coded": nets.Shape((8,), "tanh", autoencoder=3), "bad": nets.Shape((4,), "none"), "deep": nets.Shape((4, 4, 4, 4))}
    return nets.train(long, shapes, epochs=60, patience=20, rate=0.05)


def test_grid_learns_and_failures_cost_no_other(long, grid):
    made, failed = grid
    assert [x.name for x in made] == ["wide", "coded"] and set(failed) == {"bad", "deep"} and "activation" in failed["bad"]
    rows = {r.model: r for r in nets.board(long, made).collect()}
    assert rows["wide"].test_accuracy > 0.85 and rows["wide"].train_auc > 0.93 and rows["wide"].worth_saving
    assert rows["coded"].layers == "7-3-8-1"
    told = nets.predictions(long, made).where("model = 'wide' and mix = 'train'").collect()
    assert len(told) == 180 and 900 not in {r.sample_id for r in told}
    best = max(np.unique([r.score for r in told]), key=lambda c: (round(sum(r.score >= c for r in told if r.label) / sum(r.label for r in told) - sum(r.score >= c for r in told if not r.label) / sum(1 - r.label for r in told), 12), c))
    assert made[0].cutoff == best
    with pytest.raises(ValueError, match="both classes"):
        nets.train(long.where("class = 'Case'"), {"a": nets.Shape((2,))})


def test_autoencoder_copies_better_than_means(long):
    samples = nets.Samples(long)
    try:
        start = nets.coder(nets.Shape((2,), "tanh", autoencoder=3), 4, np.random.default_rng(1))
        found, failed = samples.descend({0: start}, "copy", 80, 80, 0.05, 1)
        sums = samples.sums({0: found[0][0]}, "copy", (1, 0), np.ones(2), samples.mean, samples.scale)[0]
    finally:
        samples.close()
    rows = nets.matrix(long.where("mix = 'test'"), samples.names).select(vector_to_array("v").alias("x")).collect()
    x = (np.array([r.x for r in rows]) - samples.mean) / samples.scale
    assert not failed and found[0][1] < 0.75 * np.abs(x).mean() and sums[1] / samples.tested == pytest.approx(found[0][1])


def test_divergence_is_an_error_of_one(long):
    samples = nets.Samples(long)
    try:
        rng = np.random.default_rng(1)
        broken = (replace(nets.dense(rng, 4, 2, "relu"), bias=np.array([np.nan, 0])), nets.dense(rng, 2, 1, "linear"))
        found, failed = samples.descend({0: broken, 1: nets.classifier(nets.Shape((2,)), 4, rng)}, "class", 2, 5, 0.01, 1)
    finally:
        samples.close()
    assert set(found) == {1} and failed == {0: "diverged in epoch 0"}


def test_stored_networks_predict_new_data(spark, long, grid):
    network, path = grid[0][0], stores.new_folder(spark, "network")
    nets.save(spark, network, path, long)
    nets.save(spark, network, path, long)
    again = nets.load(spark, path)
    key = lambda df: sorted((r.sample_id, r.score, r.predicted) for r in df.collect())
    assert key(nets.predict(long, again)) == key(nets.predictions(long, [network]))
    assert spark.read.option("header", True).csv(f"{path}/predictions").count() == 360
    blind = long.drop("class", "mix").withColumn("extra", F.lit(1))
    told = nets.predict(blind, again)
    assert key(told) == key(nets.predict(long, again)) and {(r.label, r.mix) for r in told.collect()} == {(None, None)}
    assert {r.predicted for r in nets.predict(blind, again, cutoff=2.0).collect()} == {0}
    moved = long.withColumn("value", F.col("value") * 10 + 3)
    for mended in (nets.rescaled(again, moved.where("mix = 'train'")), again):
        same = [r[1] for r in key(nets.predict(moved, mended))] == pytest.approx([r[1] for r in key(nets.predict(long, again))], abs=1e-6)
        assert same == (mended is not again)
    assert nets.predict(long.limit(0), again).count() == 0
    with pytest.raises(ValueError, match="no sample"):
        nets.rescaled(again, long.where("feature = 'f0'"))


def test_transfer_keeps_frozen_layers(spark, long, grid):
    network = grid[0][0]
    turned = long.withColumn("class", F.when(F.col("class") == "Case", "Control").otherwise("Case"))
    new, told = nets.transfer(turned, network, (1, 2), epochs=60, patience=60, rate=0.05)
    for i in (0, 1):
        assert (new.layers[i].weights == network.layers[i].weights).all()
    assert (new.layers[2].weights != network.layers[2].weights).any()
    rows = {(r.scenario, r.mix): r for r in told.collect()}
    assert len(rows) == 6 and rows["recalibrated", "test"].accuracy > 0.8 > 0.6 > rows["crude", "test"].accuracy
    _, whole = nets.transfer(turned, network, (1, 3), epochs=5)  # nothing is open: nothing changes
    rows = {(r.scenario, r.mix): r.accuracy for r in whole.collect()}
    assert rows["crude", "test"] == rows["recalibrated", "test"]


def test_merged_runs(spark, long, grid):
    one, path = nets.board(long, grid[0], 0.5, 0.5), stores.new_folder(spark, "merged")
    top = nets.merged_runs([one, one.drop("loss")], path, k=3)
    assert top.count() <= 3 and {r.id for r in top.collect()} <= {"1-wide", "2-wide", "1-coded", "2-coded"}
    assert spark.read.option("header", True).csv(f"{path}/names").count() == 4
    r = top.where("id = '1-wide'").first()
    assert r.metaindex == pytest.approx(3 / (1 / r.train_accuracy + 1 / r.test_accuracy + 1 / r.valid_accuracy))
