"""Feed-forward networks on long tables (sample_id, class, feature, value, mix): grids of them, autoencoders, dropout, early stopping, stored models, predictions for new data and transfer.

An epoch is one pass of Spark over the samples, in which every task adds up the gradients of all open networks; the driver moves the weights (Adam), of which it holds a copy a network, never a sample. So results do not depend on how samples are spread, but for the rounding of sums. Dropout masks are hashes of (seed, epoch, network, layer, unit, sample): a lost task is done again with the same masks. Early stopping watches the loss on the test part (on train, if there is no test part) and keeps the best weights. The head is one logit, which is what two softmax units amount to.

Defined cases: samples with a missing value, or that lack a feature, are left out; features that do not vary on train are centred only; a shape that cannot be built or whose loss is no number costs no other one and is a row with its error; train samples of one class only are an error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators import evaluation, models
from helixmill.sources import stores

#: Numbers of a task's working arrays.
CELLS = 4_000_000
MIXES = ("train", "test", "valid")
ACTIVATIONS = ("linear", "relu", "selu", "sigmoid", "softmax", "tanh")
SELU_SCALE, SELU_ALPHA = 1.0507009873554805, 1.6732632423543772
L1, CODER_L1 = 0.001, 0.01


@dataclass(frozen=True)
class Layer:
    weights: np.ndarray  # inputs by units
    bias: np.ndarray
    activation: str
    dropout: float = 0.0
    l1: float = 0.0
    frozen: bool = False


@dataclass(frozen=True)
class Shape:
    """One to three hidden layers. ``penalised`` hidden layers have an L1 penalty; ``autoencoder`` is the number of units of a softmax code that replaces the features (0: none; negative: with an L1 penalty)."""

    hidden: tuple[int, ...]
    activation: str = "relu"
    dropout: tuple[float, ...] = ()
    penalised: tuple[bool, ...] = ()
    autoencoder: int = 0


@dataclass(frozen=True)
class Network:
    name: str
    features: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[Layer, ...]
    cutoff: float = 0.5
    epochs: int = 0
    loss: float = math.nan  # the best on the part that early stopping watches


def activate(kind: str, z: np.ndarray) -> np.ndarray:
    if kind == "relu":
        return np.maximum(z, 0)
    if kind == "selu":
        return SELU_SCALE * np.where(z > 0, z, SELU_ALPHA * np.expm1(np.minimum(z, 0)))
    if kind == "sigmoid":
        return 0.5 + 0.5 * np.tanh(z / 2)
    if kind == "softmax":
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)
    return np.tanh(z) if kind == "tanh" else z


def back(kind: str, z: np.ndarray, a: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The gradient with regard to ``z`` from ``g``, that with regard to ``a = activate(kind, z)``."""
    if kind == "relu":
        return g * (z > 0)
    if kind == "selu":
        return g * np.where(z > 0, SELU_SCALE, a + SELU_SCALE * SELU_ALPHA)
    if kind == "sigmoid":
        return g * a * (1 - a)
    if kind == "softmax":
        return a * (g - (g * a).sum(1, keepdims=True))
    return g * (1 - a * a) if kind == "tanh" else g


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def masks(layers: tuple[Layer, ...], key: tuple[int, ...], samples: np.ndarray) -> list:
    """For each layer None or what its units are multiplied by: 0, or 1 / (1 - dropout) so that sums keep their expectation. ``samples`` are 64-bit hashes, ``key`` names seed, epoch and network."""
    out = []
    for at, layer in enumerate(layers):
        if not layer.dropout:
            out.append(None)
            continue
        start = np.uint64(0)
        for part in (*key, at):
            start = _mix(np.array([start ^ np.uint64(part % (1 << 64))]) + np.uint64(0x9E3779B97F4A7C15))[0]
        units = _mix(start ^ (np.arange(len(layer.bias), dtype="u8") + np.uint64(1)))
        u = (_mix(samples[:, None] ^ units[None, :]) >> np.uint64(11)).astype(float) / (1 << 53)
        out.append(np.where(u >= layer.dropout, 1 / (1 - layer.dropout), 0.0))
    return out


def forward(layers: tuple[Layer, ...], x: np.ndarray, drop: list | None = None) -> tuple[np.ndarray, list]:
    """The last layer's output, and (input, z, a) of each layer."""
    steps = []
    for at, layer in enumerate(layers):
        z = x @ layer.weights + layer.bias
        a = activate(layer.activation, z)
        steps.append((x, z, a))
        x = a if drop is None or drop[at] is None else a * drop[at]
    return x, steps


def losses(kind: str, out: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each sample's loss, and its gradient with regard to ``out``: "class" (cross-entropy of a logit) or "copy" (mean absolute error against ``x``)."""
    if kind == "class":
        z = out[:, 0]
        return np.logaddexp(0, z) - y * z, (0.5 + 0.5 * np.tanh(z / 2) - y)[:, None]
    return np.abs(out - x).mean(1), np.sign(out - x) / x.shape[1]


def gradients(layers: tuple[Layer, ...], kind: str, x: np.ndarray, y: np.ndarray, w: np.ndarray, drop: list | None = None) -> tuple[float, np.ndarray]:
    """The weighted sum of losses, and its gradient with regard to the weights and biases of the layers that are not frozen, one after another."""
    out, steps = forward(layers, x, drop)
    loss, g = losses(kind, out, x, y)
    g, parts = g * w[:, None], []
    lowest = next((i for i, layer in enumerate(layers) if not layer.frozen), len(layers))
    for at in range(len(layers) - 1, lowest - 1, -1):
        layer, (given, z, a) = layers[at], steps[at]
        if drop is not None and drop[at] is not None:
            g = g * drop[at]
        g = back(layer.activation, z, a, g)
        if not layer.frozen:
            parts.append(np.concatenate([(given.T @ g).ravel(), g.sum(0)]))
        g = g @ layer.weights.T
    return float((loss * w).sum()), np.concatenate([*reversed(parts)]) if parts else np.zeros(0)


def _flat(layers: tuple[Layer, ...]) -> np.ndarray:
    open_ = [np.concatenate([x.weights.ravel(), x.bias]) for x in layers if not x.frozen]
    return np.concatenate(open_) if open_ else np.zeros(0)


def _with(layers: tuple[Layer, ...], flat: np.ndarray) -> tuple[Layer, ...]:
    out, at = [], 0
    for layer in layers:
        if not layer.frozen:
            n, m = layer.weights.size, layer.bias.size
            layer = replace(layer, weights=flat[at : at + n].reshape(layer.weights.shape), bias=flat[at + n : at + n + m])
            at += n + m
        out.append(layer)
    return tuple(out)


def _penalty(layers: tuple[Layer, ...]) -> tuple[float, np.ndarray]:
    """The L1 penalty of the open layers, and its gradient in the order of ``_flat``."""
    parts = [np.concatenate([layer.l1 * np.sign(layer.weights).ravel(), np.zeros(layer.bias.size)]) for layer in layers if not layer.frozen]
    return sum(layer.l1 * float(np.abs(layer.weights).sum()) for layer in layers if not layer.frozen), np.concatenate(parts) if parts else np.zeros(0)


class Samples:
    """The train and test samples as a written table, with the train part's scaling."""

    def __init__(self, long: DataFrame, features: tuple[str, ...] | None = None):
        self.spark = long.sparkSession
        self.names = features or tuple(r.feature for r in long.select("feature").distinct().orderBy("feature").collect())
        data = matrix(long.where("mix in ('train', 'test')"), self.names)
        self.mean, self.scale, self.n = scaling(data.where("mix = 'train'"))
        if not self.n.min():
            raise ValueError("train samples of both classes are needed")
        self.path = stores.new_folder(self.spark, "networks")
        self.rows = stores.written(data.select(F.xxhash64(F.col("sample_id").cast("string")).alias("h"), F.col("label").cast("double").alias("y"), (F.col("mix") == "train").alias("train"), vector_to_array("v").alias("x")), self.path)
        self.tested = self.rows.where("not train").count()

    def close(self) -> None:
        stores.remove(self.spark, self.path)

    def sums(self, open_: dict[int, tuple[Layer, ...]], kind: str, key: tuple[int, ...], weights: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> dict[int, np.ndarray]:
        """Per network: weighted loss and gradient on train, and loss on test."""
        sizes = {i: 2 + len(_flat(layers)) for i, layers in open_.items()}
        widest = max([len(mean), *(layer.bias.size for layers in open_.values() for layer in layers)])

        def add(batches):
            held = {i: np.zeros(n) for i, n in sizes.items()}
            for batch in batches:
                step = max(1, CELLS // widest)
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    x = (part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(mean)) - mean) / scale
                    h, y, train = part.column(0).to_numpy().view("u8"), part.column(1).to_numpy(), part.column(2).to_numpy(zero_copy_only=False)
                    for i, layers in open_.items():
                        w = np.where(y[train] == 1, weights[1], weights[0])
                        loss, g = gradients(layers, kind, x[train], y[train], w, masks(layers, (*key, i), h[train]))
                        held[i][0] += loss
                        held[i][2:] += g
                        if not train.all():
                            told = losses(kind, forward(layers, x[~train])[0], x[~train], y[~train])[0]
                            held[i][1] += (told * np.where(y[~train] == 1, weights[1], weights[0])).sum()
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([*held.values()]).tobytes()], pa.binary())], ["sums"])

        total = sum(np.frombuffer(r.sums) for r in self.rows.mapInArrow(add, "sums binary").toLocalIterator())  # one task's at a time
        ends = np.cumsum([*sizes.values()])
        return dict(zip(sizes, np.split(total, ends[:-1]), strict=True))

    def descend(self, starts: dict[int, tuple[Layer, ...]], kind: str, epochs: int, patience: int, rate: float, seed: int, balanced: bool = False, scaling: tuple | None = None) -> tuple[dict[int, tuple], dict[int, str]]:
        """(layers, best loss, epochs) of each network, and the errors of those that diverged."""
        mean, scale = scaling or (self.mean, self.scale)
        weights = self.n.sum() / (2 * self.n) if balanced else np.ones(2)
        n = float((self.n * weights).sum())
        now, open_ = dict(starts), set(starts)
        first = {i: np.zeros_like(_flat(x)) for i, x in starts.items()}
        second = {i: np.zeros_like(_flat(x)) for i, x in starts.items()}
        best, failed, since = {i: (x, math.inf, 0) for i, x in starts.items()}, {}, dict.fromkeys(starts, 0)
        for epoch in range(epochs + 1):  # the last pass judges the last step
            if not open_:
                break
            told = self.sums({i: now[i] for i in sorted(open_)}, kind, (seed, epoch), weights, mean, scale)
            for i, sums in told.items():
                penalty, pull = _penalty(now[i])
                watched = float(sums[1]) / self.tested if self.tested else float(sums[0]) / n + penalty
                if not np.isfinite(sums).all():
                    failed[i] = f"diverged in epoch {epoch}"
                    open_.discard(i)
                    continue
                better = watched < best[i][1] - 1e-9
                best[i] = (now[i], watched, epoch) if better else best[i]
                since[i] = 0 if better else since[i] + 1
                if since[i] >= patience or not len(pull):
                    open_.discard(i)
                    continue
                g = sums[2:] / n + pull
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                step = rate * (first[i] / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(second[i] / (1 - 0.999 ** (epoch + 1))) + 1e-8)
                now[i] = _with(now[i], _flat(now[i]) - step)
        return {i: x for i, x in best.items() if i not in failed}, failed


def matrix(long: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(sample_id, label, mix, v) with a vector of the features in the order of ``names``, of the samples that have each once (or the same value again). Label and mix are null where ``long`` has no class or mix."""
    some = lambda c, of: F.first(of, ignorenulls=True) if c in long.columns else F.lit(None).cast("string")
    held = F.collect_set(F.when(F.col("value").isNotNull(), F.struct("feature", "value")))
    once = F.size(F.array_distinct(F.transform("held", lambda x: x["feature"]))) == len(names)
    label = some("class", (F.col("class") == "Case").cast("int")).cast("int").alias("label")
    rows = long.where(F.col("feature").isin(*names)).groupBy("sample_id").agg(label, some("mix", F.col("mix")).alias("mix"), held.alias("held")).where((F.size("held") == len(names)) & once)
    values = F.transform(F.array(*[F.lit(x) for x in names]), lambda f: F.element_at(F.map_from_entries("held"), f))
    return rows.select("sample_id", "label", "mix", models.array_to_vector(values).alias("v"))


def scaling(data: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and deviations (1 for none) of the features of ``matrix``'s rows, and how many are of class 0 and 1."""
    n = [F.count_if(F.col("label") == g) for g in (0, 1)]
    seen = data.groupBy(F.lit("all")).agg(Summarizer.metrics("mean", "std").summary(F.col("v")).alias("s"), F.array(*n).alias("n")).first()
    if seen is None:
        raise ValueError("no sample has all features; samples of both classes are needed to train")
    std = seen.s.std.toArray()
    return seen.s.mean.toArray(), np.where(std > 0, std, 1.0), np.array(seen.n, float)


def dense(rng: np.random.Generator, given: int, units: int, activation: str, dropout: float = 0.0, l1: float = 0.0) -> Layer:
    """A layer with weights drawn evenly between the ends that keep variances alike, and no bias."""
    if activation not in ACTIVATIONS:
        raise ValueError(f"no such activation: {activation}")
    if units < 1 or not 0 <= dropout < 1:
        raise ValueError(f"no such layer: {units} units, dropout {dropout}")
    end = math.sqrt(6 / (given + units))
    return Layer(rng.uniform(-end, end, (given, units)), np.zeros(units), activation, dropout, l1)


def coder(shape: Shape, given: int, rng: np.random.Generator) -> tuple[Layer, ...]:
    """The autoencoder's four layers, of which the first two give the code."""
    wide, l1 = max(7, -(-given // 2)), CODER_L1 if shape.autoencoder < 0 else 0.0
    sizes = [(given, wide, shape.activation), (wide, abs(shape.autoencoder), "softmax"), (abs(shape.autoencoder), wide, shape.activation)]
    return (*(dense(rng, a, b, kind, 0.0, l1) for a, b, kind in sizes), dense(rng, wide, given, "linear"))


def classifier(shape: Shape, given: int, rng: np.random.Generator) -> tuple[Layer, ...]:
    if not 1 <= len(shape.hidden) <= 3:
        raise ValueError("one to three hidden layers")
    drop = [*shape.dropout, 0.0, 0.0, 0.0]
    l1 = [*(L1 if p else 0.0 for p in shape.penalised), 0.0, 0.0, 0.0]
    sizes = [given, *shape.hidden]
    return (*(dense(rng, sizes[i], n, shape.activation, drop[i], l1[i]) for i, n in enumerate(shape.hidden)), dense(rng, sizes[-1], 1, "linear"))


def train(long: DataFrame, shapes: dict[str, Shape], epochs: int = 2_000, patience: int = 50, rate: float = 0.01, seed: int = 1, balanced: bool = False) -> tuple[list[Network], dict[str, str]]:
    """The networks of a grid, trained together, and the errors of those that could not be. ``balanced`` weighs classes alike. Each has the cut-off of the largest Youden index on train."""
    names, samples, failed = list(shapes), Samples(long), {}
    try:
        coders, starts = {}, {}
        rngs = {i: np.random.default_rng([seed, i]) for i in range(len(names))}
        for i, name in enumerate(names):
            try:
                if shapes[name].autoencoder:
                    coders[i] = coder(shapes[name], len(samples.names), rngs[i])
                starts[i] = classifier(shapes[name], abs(shapes[name].autoencoder) or len(samples.names), rngs[i])
            except ValueError as e:
                failed[name] = str(e)
                coders.pop(i, None)
        coded, lost = samples.descend(coders, "copy", epochs, patience, rate, seed)
        for i, (layers, *_) in coded.items():
            starts[i] = (*(replace(x, frozen=True) for x in layers[:2]), *starts[i])
        found, diverged = samples.descend({i: x for i, x in starts.items() if i not in lost}, "class", epochs, patience, rate, seed, balanced)
        failed |= {names[i]: e for i, e in (lost | diverged).items()}
        made = [Network(names[i], samples.names, samples.mean, samples.scale, layers, 0.5, at, loss) for i, (layers, loss, at) in sorted(found.items())]
    finally:
        samples.close()
    return with_cutoffs(long, made), failed


def with_cutoffs(long: DataFrame, networks: list[Network]) -> list[Network]:
    if not networks:
        return []
    told = predictions(long.where("mix = 'train'"), networks)
    cutoffs = {r.model: r.cutoff for r in evaluation.youden(told, ("model",)).collect()}  # a row a network
    return [replace(x, cutoff=float(cutoffs[x.name])) for x in networks]


def predictions(long: DataFrame, networks: list[Network]) -> DataFrame:
    """(model, sample_id, label, mix, score, predicted) of every network, a pass for those on the same features; label and mix are null for data that has none."""
    out = None
    for features in sorted({x.features for x in networks}):
        chosen = [x for x in networks if x.features == features]
        data = matrix(long, features).select("sample_id", "label", "mix", vector_to_array("v").alias("x"))

        def score(batches, chosen=chosen):
            for batch in batches:
                raw = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(chosen[0].features))
                for network in chosen:
                    p = activate("sigmoid", forward(network.layers, (raw - network.mean) / network.scale)[0][:, 0])
                    columns = [pa.array([network.name] * batch.num_rows, pa.string()), *batch.columns[:3], pa.array(p), pa.array((p >= network.cutoff).astype("i4"))]
                    yield pa.RecordBatch.from_arrays(columns, ["model", "sample_id", "label", "mix", "score", "predicted"])

        kind = data.schema["sample_id"].dataType.simpleString()
        told = data.mapInArrow(score, f"model string, sample_id {kind}, label int, mix string, score double, predicted int")
        out = told if out is None else out.unionByName(told)
    return out


def board(long: DataFrame, networks: list[Network], least_train: float = 0.85, least_test: float = 0.8) -> DataFrame:
    """(model, cutoff, epochs, loss, layers, AUC on train, figures of each mix, worth_saving): a row a network."""
    told = predictions(long, networks)
    figures = ("accuracy", "sensitivity", "specificity", "ppv", "npv", "f1")
    of = lambda mix, c: F.max(F.when(F.col("mix") == mix, F.col(c))).alias(f"{mix}_{c}")
    wide = evaluation.confusion(told, ("model", "mix")).groupBy("model").agg(*[of(mix, c) for mix in MIXES for c in figures])
    area = evaluation.auc(told.where("mix = 'train'"), ("model",), turned=False).select("model", F.col("auc").alias("train_auc"))
    facts = long.sparkSession.createDataFrame([(x.name, x.cutoff, x.epochs, x.loss, "-".join(str(layer.bias.size) for layer in x.layers)) for x in networks], "model string, cutoff double, epochs int, loss double, layers string")
    saving = F.coalesce((F.col("train_accuracy") > least_train) & (F.col("test_accuracy") > least_test), F.lit(False))
    return facts.join(area, "model", "left").join(wide, "model", "left").withColumn("worth_saving", saving)


# stored networks

STORED = "name string, features array<string>, mean array<double>, scale array<double>, cutoff double, epochs int, loss double, layers array<struct<inputs: int, units: int, weights: array<double>, bias: array<double>, activation: string, dropout: double, l1: double, frozen: boolean>>"


def save(spark: SparkSession, network: Network, path: str, long: DataFrame | None = None) -> None:
    """``path``/model with weights, scaling and cut-off, and, of ``long``, ``path``/predictions as gzipped CSV. A repeated write replaces."""
    layers = [(*x.weights.shape, x.weights.ravel().tolist(), x.bias.tolist(), x.activation, x.dropout, x.l1, x.frozen) for x in network.layers]
    row = (network.name, list(network.features), network.mean.tolist(), network.scale.tolist(), network.cutoff, network.epochs, network.loss, layers)
    spark.createDataFrame([row], STORED).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    if long is not None:
        predictions(long, [network]).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{path}/predictions")


def load(spark: SparkSession, path: str) -> Network:
    r = spark.read.schema(STORED).parquet(f"{path}/model").first()
    layers = tuple(Layer(np.array(x.weights).reshape(x.inputs, x.units), np.array(x.bias), x.activation, x.dropout, x.l1, x.frozen) for x in r.layers)
    return Network(r.name, tuple(r.features), np.array(r["mean"]), np.array(r["scale"]), layers, r.cutoff, r.epochs, r.loss)


def rescaled(network: Network, long: DataFrame) -> Network:
    """``network`` with the scaling of ``long``: new data on another scale, or the old train table whose scaling is to be restored."""
    mean, scale, _ = scaling(matrix(long, network.features))
    return replace(network, mean=mean, scale=scale)


def predict(long: DataFrame, network: Network, cutoff: float | None = None) -> DataFrame:
    """(model, sample_id, label, mix, score, predicted) of new data, by the stored cut-off or ``cutoff``."""
    return predictions(long, [network if cutoff is None else replace(network, cutoff=cutoff)])


def transfer(long: DataFrame, network: Network, frozen: tuple[int, int] = (0, 0), new_scaling: bool = False, epochs: int = 5_000, patience: int = 200, rate: float = 0.01, seed: int = 1, balanced: bool = False) -> tuple[Network, DataFrame]:
    """``network`` fitted further on another table, and what that changed: (scenario, mix, cutoff, tp, ... f1) of the network as it was ("crude") and of the new one ("recalibrated"), each with its cut-off of the largest Youden index on the new train part. Layers ``frozen`` (from, to; counted from 1, 0 for none) keep their weights, the others are open, an encoder's too unless it is frozen."""
    if new_scaling:
        network = rescaled(network, long.where("mix = 'train'"))
    held = tuple(replace(x, frozen=frozen[0] <= i <= frozen[1] and frozen[0] > 0) for i, x in enumerate(network.layers, 1))
    samples = Samples(long, network.features)
    try:
        found, failed = samples.descend({0: held}, "class", epochs, patience, rate, seed, balanced, (network.mean, network.scale))
    finally:
        samples.close()
    if failed:
        raise ValueError(failed[0])
    layers, loss, at = found[0]
    both = with_cutoffs(long, [replace(network, name="crude"), replace(network, name="recalibrated", layers=layers, epochs=at, loss=loss)])
    cutoffs = F.create_map(*[F.lit(x) for n in both for x in (n.name, n.cutoff)])
    told = evaluation.confusion(predictions(long, both), ("model", "mix")).withColumnRenamed("model", "scenario").withColumn("cutoff", cutoffs[F.col("scenario")])
    return replace(both[1], name=network.name), told


def merged_runs(runs: list[DataFrame], path: str, k: int = 1_000) -> DataFrame:
    """The boards of several runs with their run, id and meta-index (the harmonic mean of train, test and valid accuracy), written with the ``k`` best that are worth saving and the names of all as ``path``/{all,top,names}."""
    out = None
    for i, run in enumerate(runs):
        one = run.withColumn("run", F.lit(i + 1))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    parts = [F.col(f"{mix}_accuracy") for mix in MIXES]
    index = F.when(F.least(*parts) > 0, 3 / (1 / parts[0] + 1 / parts[1] + 1 / parts[2]))
    out = out.withColumn("metaindex", index).withColumn("id", F.concat_ws("-", "run", "model"))
    stores.write_table(out, f"{path}/all")
    top = out.where("worth_saving").orderBy(F.desc_nulls_last(F.round("metaindex", 12)), "id").limit(k)
    stores.write_table(top, f"{path}/top")
    stores.write_table(out.select("id"), f"{path}/names")
    return top
