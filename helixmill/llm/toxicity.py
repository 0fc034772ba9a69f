"""Toxicity by maximum-scoring segments.

Fitting counts words over all rows it is given (once a text, so that one text that repeats a word says it once) and scores each by its log-odds between toxic and other texts under an informative Dirichlet prior (the prior's pseudo-counts follow the word's share of all texts, with a floor). Words that are significantly toxic (z-score of the log-odds at least ``min_z``) form the lexicon; its size is bounded by the rows that are fitted on, of which ``labelled_rows`` draws at most about ``fit_rows``. All other words share one score, the log-odds of "a word outside the lexicon", which is negative.

A text is scanned once: as words outside the lexicon all cost the same, the scan goes from lexicon hit to lexicon hit and charges the gap between, and finds every maximal scoring segment in linear time. A segment of score S in a text of n words is significant if its expectation by chance, E = K n exp(-lambda S), is at most ``max_e``: Karlin and Altschul's statistics, with lambda solved, and K bounded from above, by the word shares of the labelled texts that are not toxic. The text's strength adds up -ln(E / (1 + E)) over its significant segments, and a logistic curve fitted on the labelled rows turns it into a probability.

Defined cases: a null or empty text, or one without words, has strength 0 and so the lowest score; labels other than 0 and 1 (null too) are not learned from, and neither are rows with a null id; an id with several labels is toxic if one of them says so; a text that is repeated in the labelled rows counts each time; a kept column named as an output is named ``<name>_kept``; with no labelled rows of either kind the lexicon is empty and every score is the share of toxic labels (0.5 if there are none). Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm import common

#: About the most labelled rows that a model is fitted on.
FIT_ROWS = 200_000
WORD = re.compile(r"[^\W_]+")


@dataclass
class Model:
    words: dict[str, float]
    gap: float  # score of a word outside the lexicon, negative
    lam: float
    k: float
    max_e: float
    curve: tuple[float, float]  # intercept and slope of the logistic curve over strength


def karlin(scores: np.ndarray, shares: np.ndarray) -> tuple[float, float]:
    """lambda with sum(share * exp(lambda * score)) = 1, and the upper bound lambda-wise K of a sparse positive tail."""
    lo, hi = 0.0, 1.0
    f = lambda x: float((shares * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    if not len(scores) or (shares * scores).sum() >= 0 or scores.max() <= 0:
        return 1.0, 1.0
    while f(hi) < 0:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    positive = scores > 0
    # segments by chance start at a positive word: their rate times the mean of exp(lambda s) bounds K
    k = float((shares[positive] * np.exp(np.minimum(hi * scores[positive], 700))).sum())
    return hi, max(k, 1e-12)


def segments(hits: list[tuple[int, float]], gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) over hits (word index, score); words between cost ``gap`` each. Linear in the hits."""
    stack: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, last
    total, last = 0.0, -1
    for at, score in hits:
        total += gap * (at - last - 1)
        last = at
        if score <= 0:
            total += score
            continue
        lo, first = total, at
        total += score
        hi, end = total, at
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= lo:
                j -= 1
            if j < 0 or stack[j][1] >= hi:
                stack.append((lo, hi, first, end))
                break
            lo, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(f, e, h - b) for b, h, f, e in stack]


def scan(text: str | None, model: Model) -> tuple[list[tuple[int, int, float, float]], float, int]:
    """(significant segments as (first character, end, score, E), strength, number of words)."""
    spans = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)] if text else []
    return scan_words(spans, model)


def scan_words(spans, model: Model):
    get = model.words.get
    hits = [(i, s) for i, (_, _, w) in enumerate(spans) if (s := get(w.lower())) is not None]
    n, found, strength = len(spans), [], 0.0
    for first, last, score in segments(hits, model.gap):
        e = model.k * n * math.exp(-model.lam * score)
        if e <= model.max_e:
            found.append((spans[first][0], spans[last][1], score, e))
            strength += -math.log(max(e / (1 + e), 1e-300))
    return found, strength, n


def strength(text: str | None, model: Model) -> float:
    """Sum over significant segments of -ln(E / (1 + E)): 0 if there is none. Only the hits are looked at."""
    words = WORD.findall(text) if text else []
    get = model.words.get
    hits = [(i, s) for i, w in enumerate(words) if (s := get(w.lower())) is not None]
    total = 0.0
    for _, _, score in segments(hits, model.gap):
        e = model.k * len(words) * math.exp(-model.lam * score)
        if e <= model.max_e:
            total += -math.log(max(e / (1 + e), 1e-300))
    return total


def probability(x, curve: tuple[float, float]):
    return 1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * np.log1p(x), -30, 30)))


def fit_curve(x: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[float, float]:
    """Logistic regression on log(1 + strength), from counts of either label at each strength; Newton's method with a weak ridge. Steps that would lower the penalised likelihood are halved, as whole steps can diverge where the labels are nearly separable."""
    n0, n1 = n0.astype(float), n1.astype(float)
    total = n0.sum() + n1.sum()
    prior = (n1.sum() + 0.5) / (total + 1)
    beta = np.array([math.log(prior / (1 - prior)), 0.0])
    if not n0.sum() or not n1.sum():
        return float(beta[0]), 0.0
    design, ridge = np.stack([np.ones_like(x), np.log1p(x)], 1), np.array([1e-9, 1e-3])

    def loss(b: np.ndarray) -> float:
        z = design @ b
        return float(n0 @ np.logaddexp(0, z) + n1 @ np.logaddexp(0, -z) + ridge @ (b * b) / 2)

    now = loss(beta)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (n1 - (n0 + n1) * p) - ridge * beta
        hess = (design * ((n0 + n1) * p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        while (new := loss(beta + step)) > now and np.abs(step).max() >= 1e-10:
            step = step / 2
        if new > now or np.abs(step).max() < 1e-10:
            break
        beta, now = beta + step, new
    return float(beta[0]), float(max(beta[1], 0.0))


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "label", min_z: float = 3.3, prior_words: float = 1_000.0, prior_floor: float = 0.5, max_e: float = 0.1) -> Model:
    """Fit on all rows with label 0 or 1, which are read twice (see ``labelled_rows``). The driver gets the significant words and a histogram of strengths (rounded to tenths)."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and text is not null")

    def count(batches):
        found: dict[str, list[int]] = {}
        for batch in common.slices(batches, 0):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in set(WORD.findall(text.lower())):
                    got = found.get(w)
                    if got is None:
                        got = found[w] = [0, 0]
                    got[label] += 1
            if len(found) > 200_000:
                yield flush(found)
                found = {}
        yield flush(found)

    def flush(found):
        n = np.array(list(found.values()), "i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(n[:, 0]), pa.array(n[:, 1])], ["word", "n0", "n1"])

    words = rows.mapInArrow(count, "word string, n0 bigint, n1 bigint").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    words = common.stage(words, "words", words_path := common.new_path(spark, "words"))
    sums = words.agg(F.sum("n0"), F.sum("n1")).first()
    all0, all1 = float(sums[0] or 0), float(sums[1] or 0)
    if not all0 or not all1:
        common.remove(spark, words_path)
        n = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
        return Model({}, -1.0, 1.0, 1.0, max_e, fit_curve(np.zeros(1), np.array([n.get(0, 0)]), np.array([n.get(1, 0)])))
    a0 = float(prior_words)
    share = (F.col("n0") + F.col("n1")) / (all0 + all1)
    prior = share * a0 + prior_floor  # the floor keeps words that one side never uses from having unbounded variance
    odds = lambda n, total: F.log((n + prior) / (total + a0 - n - prior))
    delta = odds(F.col("n1"), all1) - odds(F.col("n0"), all0)
    z = delta / F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior))
    best = words.where(F.col("n1") > 0).select("word", "n0", "n1", delta.alias("delta"), z.alias("z")).where(F.col("z") >= min_z).orderBy("word").collect()  # significant words of at most the rows fitted on
    common.remove(spark, words_path)
    in0, in1 = sum(r.n0 for r in best), sum(r.n1 for r in best)
    # the score of a word is its log-odds inside a toxic passage, where lexicon words have the share they would have if a tenth of the words were toxic
    gap = math.log(0.9) - math.log(max(1e-9, 1 - in0 / all0))
    lexicon = {r.word: float(r.delta) for r in best}
    scores = np.array([*lexicon.values(), gap])
    # every word is given half a count among other texts, so that chance hits have a share
    shares = np.array([*((r.n0 + 0.5) / (all0 + 0.5 * len(best)) for r in best), 0.0])
    shares[-1] = 1 - shares.sum()
    lam, k = karlin(scores, shares)
    model = Model(lexicon, gap, lam, k, max_e, (0.0, 0.0))
    held = spark.sparkContext.broadcast(model)

    def measure(batches):
        for batch in common.slices(batches, 0):
            x = [round(strength(t, held.value), 1) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1)], ["x", "label"])

    bins = rows.mapInArrow(measure, "x double, label int").groupBy("x").agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")).collect()  # a bin a tenth
    model.curve = fit_curve(*(np.array([r[i] for r in bins], float) for i in range(3)))
    return model


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(text, label) of the documents that have a label, as a stage table to fit on: all of them, or about ``fit_rows`` if there are more.

    The rows are drawn by a hash of the id from ``labels``, before any text is touched, so that what is broadcast has a bound and no text is shuffled.
    """
    spark = docs.sparkSession
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null").groupBy("id").agg(F.max("label").alias("label"))
    n = ids.count()
    if n > fit_rows:
        ids = ids.where(F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 30)) < int(fit_rows / n * (1 << 30)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return common.stage(texts.join(F.broadcast(ids), "id").select("text", "label"), "labelled")  # about fit_rows pairs of numbers


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: its id, the columns of ``keep``, score (0 to 1), and passages: the significant toxic passages (start, end, score, e) by character."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e", pa.float64())]))

    def of():
        m = held.value

        def work(texts):
            passages, strengths = [], []
            for text in texts:
                x = strength(text, m)
                strengths.append(x)
                passages.append([dict(zip(("start", "end", "score", "e"), s, strict=True)) for s in scan(text, m)[0]] if x else [])
            return probability(np.round(np.array(strengths, float), 1), m.curve), passages

        return work

    outputs = {"score": ("double", pa.float64()), "passages": ("array<struct<start: int, end: int, score: double, e: double>>", kind)}
    return common.text_columns(docs, text_col, (id_col, *keep), outputs, of)
