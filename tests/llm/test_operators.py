"""Each dealt operator against the library, brute force or a round trip, on small fixtures with nulls, ties, repeats and clashing columns."""

import random
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from helixmill.llm import common, decontamination, language, near_duplicates, neighbours, packing, queries, sharding, token_files, tokens, toxicity, warc

SF = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens int, part int, id string"
ODD = ["", None, " ", "a  b", "a   b \n", "it's  DON'T", "x<|endoftext|> y", "é İ Σας", "日本 語", "１２ ½", "x" * 5_000, "tab\t end ", "word " * 3_000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 0, 1, 2, "c") for i, t in enumerate(ODD)] + [(None, "null id", None, None, None, None, None, None), (3, "a  b", "en", "s", 0, 1, 2, "c"), (3, "other", "en", "t", 0, 1, 2, "c")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_library(path):
    rng = random.Random(5)
    alphabet = " \n\t'.,aAéÉß9½x<|>_—İΣ日́"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30))) for _ in range(1_500)]
    count, encode, kind = tokens.counter(path), tokens.encoder(path), f"<u{tokens.id_width(path)}"
    for text in texts:
        ids = tokens.load(path).encode(text, add_special_tokens=False).ids
        assert count(text) == len(ids)
        assert np.frombuffer(encode(text), kind).tolist() == ids


def test_token_counts(odd, none):
    got = tokens.token_counts(odd, BYTE).collect()
    want = sorted((len((r.text or "").encode()), len(tokens.whole(BYTE, r.text or ""))) for r in odd.collect())
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == want
    assert tokens.token_counts(none, BYTE).count() == 0


def test_token_files_round_trip(spark, odd, none):
    manifest = token_files.write_token_files(odd, WORD, 2, common.new_path(spark, "t"))
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    keys = [r.doc_id for r in got]
    assert keys[0] is None
    assert keys[1:] == sorted(keys[1:])
    at = 0
    for r in got:
        assert r.start == at
        assert r.ids[-1] == 2
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert sorted(tuple(r.ids[:-1]) for r in got) == sorted(tuple(tokens.whole(WORD, r.text or "")) for r in odd.collect())
    assert token_files.read_token_files(token_files.write_token_files(none, WORD, 2, common.new_path(spark, "t"))).count() == 0


@pytest.mark.parametrize("weights", [None, {"s": 0.8, "t": 0.2}])
def test_packing_covers_each_id_once(odd, none, weights):
    got = packing.pack(odd, BYTE, 1, 64, weights)
    rows = got.collect()
    want = sorted((r.doc_id if r.doc_id is not None else -1, *tokens.whole(BYTE, r.text or ""), 1) for r in odd.collect())
    by_doc = {}
    for r in sorted(rows, key=lambda r: r.start):
        by_doc.setdefault(r.doc_id if r.doc_id is not None else -1, []).append(r)
    for key, *ids in want:
        if key != 3:
            assert [i for r in by_doc[key] for i in r.ids] == ids
    # the rows of a repeated id, told apart by their number of ids
    for n in {r.doc_tokens for r in by_doc[3]}:
        same = [ids for key, *ids in want if key == 3 and len(ids) == n]
        assert sorted(i for r in by_doc[3] if r.doc_tokens == n for i in r.ids) == sorted(i for ids in same for i in ids)
    assert sum(r.length for r in rows) == sum(len(x) - 1 for x in want)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert sorted(ends) == list(range(len(ends)))
    assert [v for _, v in sorted(ends.items())][:-1] == [64] * (len(ends) - 1)
    sizes = {len(r.ids) for r in packing.sequences(got, 64).collect()}
    assert all(x == 64 or bin(x).count("1") == 1 for x in sizes)
    assert packing.pack(none, BYTE, 1).count() == 0


def test_packing_keeps_the_mixture():
    totals = np.array([90_000, 9_000, 900, 1])
    levels = packing.schedule(totals, 100)
    level = levels[0]
    sent = np.diff(level.sent, axis=1)
    assert (sent.sum(axis=0) == 100).all()
    assert np.abs(np.cumsum(sent, axis=1) - np.outer(level.quota / sent.shape[1], np.arange(1, sent.shape[1] + 1))).max() < 2


def test_sharding(spark, none):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else f"t{rng.randrange(60)}" if i % 9 == 1 else f"alone{i}") for i in range(3_000)] + [(None, None), (7, "t1"), (7, "t1")]
    table = spark.createDataFrame(rows, "id bigint, link string")
    got = sharding.shard_rows(table, 8).collect()
    sizes = [sorted(r.slot for r in got if r.shard == s) for s in range(8)]
    assert max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert all(x == list(range(len(x))) for x in sizes)
    assert len(got) == len(rows)
    links = dict(rows)
    by = {}
    for r in got:
        if r.id is not None and links[r.id] != "hot":
            by.setdefault(links[r.id], set()).add(r.shard)
    assert sum(len(x) > 1 for x in by.values()) <= 0.1 * len(by)
    assert len({r.shard for r in got if r.id is not None and links[r.id] == "hot"}) <= 6  # a third of all rows
    assert sharding.shard_rows(none.select("doc_id", "text"), 4, "doc_id", "text").count() == 0


def test_warc_round_trip(spark, none):
    rows = [(1, "http://a", "x"), (2, "u\r\nv: w", "x"), (3, None, None), (4, "c", ""), (None, "d", "y"), (5, "e", "z" * 400_000), (5, "e", "z" * 400_000), (6, "f", "\x1f\x8b\x08 WARC/1.0")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    manifest = warc.write_archive(pages, common.new_path(spark, "w"))
    for split in (64, 1_000, 32_000_000):
        got = warc.read_archive(manifest, split).collect()
        assert len(got) == len(rows)
        kinds = {(r.key, r.record_type, r.refers_to) for r in got}
        assert kinds == {(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (None, "response", None), (5, "response", None), (6, "response", None)}
        for r in got:
            if r.payload is not None:
                assert (r.payload_bytes, r.payload_digest) == (len(r.payload), warc.digest(bytes(r.payload)))
    assert warc.read_archive(warc.write_archive(none.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html")), common.new_path(spark, "w"))).count() == 0


def test_language(spark, docs, odd, none):
    fold = queries.fold()
    model = language.fit(docs.where(fold != 2))
    got = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(fold == 2)
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.85
    rows = language.predict(odd, model, keep=("n_tokens",)).collect()
    assert {r.lang_pred for r in rows} <= {"und", "en", "fr", "de", "es"}
    assert all(0 <= r.score <= 1 for r in rows)
    assert language.predict(none, language.fit(none)).count() == 0


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = rng.integers(0, 5, int(rng.integers(0, 25))).astype("u8")
        b = np.delete(a, rng.integers(0, len(a), 3)) if len(a) > 5 else a
        b = np.insert(b, rng.integers(0, len(b) + 1, int(rng.integers(0, 5))), 9)
        want = brute_distance(a.tolist(), b.tolist())
        for budget in {max(0, want - 1), want, want + 4}:
            assert near_duplicates.banded_distance(a, b, budget) == (want if want <= budget else None)


def test_near_duplicates_against_brute_force(spark, odd, none):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(4_000)]
    rows, truth = [], {}
    for g in range(40):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 160))]
        for c in range(rng.randrange(1, 5)):
            text = base.copy()
            for _ in range(c * len(base) // 100):
                text[rng.randrange(len(text))] = rng.choice(words)
            truth[len(rows)] = g
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + i, rows[0][1]) for i in range(50)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(table).collect()}
    parent = {i: i for i, _ in rows}
    for i, x in rows:
        for j, y in rows[:i]:
            a, b = near_duplicates.words_of(x), near_duplicates.words_of(y)
            if near_duplicates.similar(a, b, 0.8):
                parent[i] = parent[j]
                break
    assert got == parent
    assert near_duplicates.near_duplicates(odd).count() == odd.count()
    assert near_duplicates.near_duplicates(none).count() == 0


def test_decontamination_against_brute_force(spark, docs, odd, none):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, decontamination.normal(r.text)) for r in benchmark.collect()]
    want = {d.doc_id: {i for i, t in items if len(t) >= 32 and t in decontamination.normal(d.text or "")} for d in docs.collect()}
    got = {r.doc_id: {m.item_id for m in r.matches} for r in decontamination.contamination(docs, benchmark).collect()}
    assert all(want[d] <= got[d] for d in want)
    assert not any(got[d] and not want[d] for d in want)
    rng = random.Random(6)
    index = decontamination.build([(r.item_id, r.text) for r in benchmark.collect()])
    for item, text in items:
        edited = list(text)
        for _ in range(int(0.07 * len(text))):
            edited[rng.randrange(len(edited))] = "q"
        assert item in {m[0] for m in decontamination.matches("some words before " * 5 + "".join(edited) + " and after", index)}
    assert decontamination.contamination(odd, benchmark, keep=("part", "id")).count() == odd.count()
    assert decontamination.contamination(none, benchmark.limit(0)).count() == 0


def test_toxicity(spark, docs, odd, none):
    rows = [(i, f"plain words {i % 7} here and there " * 5 + ("vile scum idiot" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(400)] + [(900, None, 1), (901, "x", None)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string, label int"))
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id bigint, text string, label int"), model).collect()}
    assert all((got[i].score >= 0.3) == bool(label) for i, _, label in rows[:400])
    text, passage = rows[0][1], got[0].passages[0]
    assert "scum" in text[passage.start : passage.end]
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model, keep=("part",)).collect())
    empty = toxicity.fit(none.select("text", F.lit(1).alias("label")))
    assert toxicity.score(none, empty).count() == 0


def test_segments_are_maximal():
    got = toxicity.segments([(0, 4.0), (1, -5.0), (2, 3.0), (3, -3.0), (4, 1.0), (5, 2.0), (6, -2.0), (7, 2.0), (8, -2.0), (9, 1.0), (10, 5.0)], -1.0)
    assert [(a, b, round(s, 6)) for a, b, s in got] == [(0, 0, 4.0), (2, 2, 3.0), (4, 10, 7.0)]


@pytest.mark.parametrize("factor", [1.0, 1.5])
def test_neighbours_against_brute_force(spark, none, factor):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(600, 8)).astype("f4")
    vectors[100:300] = vectors[5]  # a third are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1_000, None), (1_001, [0.0] * 8), (1_002, [float("nan")] * 8), (1_003, [1.0, 2.0]), (1_004, [])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    asked = table.where("vec_id % 50 = 0")
    got = {}
    for r in sorted(neighbours.nearest(table, asked, 5, factor, shard_points=128).collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.vec_id)
    wide = vectors.astype("f8")
    hits = total = 0
    for q in range(0, 600, 50):
        cos = (wide @ wide[q]) / np.sqrt((wide * wide).sum(1)) / np.sqrt((wide[q] ** 2).sum())
        order = [int(i) for i in np.lexsort((np.arange(600), -np.round(cos, 12))) if i != q][:5]
        hits += len(set(order) & set(got[q]))
        total += 5
        if factor == 1.0:
            assert got[q] == order
    assert hits / total >= 0.9
    empty = none.select(F.col("doc_id").alias("vec_id"), F.array().cast("array<float>").alias("embedding"))
    assert neighbours.nearest(empty, empty).count() == 0


def test_multiples_of_one_vector_stay_few(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=6)
    rows = [(i, (base * 2.0 ** (i % 9)).tolist()) for i in range(400)] + [(1_000 + i, rng.normal(size=6).tolist()) for i in range(100)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = neighbours.nearest(table, table.where("vec_id in (0, 7)"), 5, 1.0, shard_points=64).collect()
    assert {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 7)} == {0: [1, 2, 3, 4, 5], 7: [0, 1, 2, 3, 4]}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("pages", "embeddings", "documents", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = c.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert sorted(map(repr, (tuple(r[x] for x in columns) for r in got.collect()))) == sorted(map(repr, (tuple(r) for r in want.select(*[duckdb.ColumnExpression(x) for x in columns]).fetchall())))


def test_pipeline(spark, docs):
    import corpus_pipeline

    clashes = ("_n", "_row", "_keep", "score", "shard", "node", "id", "matches", "accepted", "p1", "text_kept")
    kept = docs.select("*", *[F.lit(7).alias(x) for x in clashes])
    columns, whole = kept.columns, kept.count()
    for name, f in corpus_pipeline.STAGES[:-1]:
        new = common.stage(f(spark, kept, SF), "t")
        assert new.columns == columns
        assert new.exceptAll(kept).count() == 0
        if name == "language":
            assert new.count() >= 0.97 * kept.count()
        if name == "near_duplicates":
            classes = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(kept.select("doc_id", "text")).collect()}
            assert sorted(r.doc_id for r in new.select("doc_id").collect()) == sorted({c for c in classes.values()})
        kept = new
    assert 0 < kept.count() < whole
    pieces = corpus_pipeline.pack(spark, kept, SF)
    assert pieces.agg(F.sum("length")).first()[0] == kept.count() + sum(len(tokens.whole(BYTE, r.text)) for r in kept.collect())


def test_pipeline_run_leaves_one_table(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [x.name.rpartition("-")[0] for x in tmp_path.iterdir()] == ["pipeline-packing"]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_columns(spark, docs, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if "doc_id" in got and name != "op7_packing":
        assert sorted(got["doc_id"]) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    if "held_out" in got:
        want = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs.select("doc_id").collect()}
        assert dict(zip(got["doc_id"], got["held_out"], strict=True)) == want
        assert got["score"].between(0, 1).all()
    if name == "op8_toxicity":
        assert (got["predicted"] == (got["score"] >= 0.3).astype(int)).all()
        toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
        right = [p == toxic[d] for d, p in zip(got["doc_id"], got["predicted"], strict=True) if d in toxic]
        assert sum(right) >= 0.85 * len(right)  # of so few rows
    if name == "op2_sharding":
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        assert set(got["law"]) == {"rows"} and got["grown_shard"].isna().all()
        for d, size, crc in zip(got["doc_id"], got["size"], got["text_crc32"], strict=True):
            assert (size, crc) == (len(texts[d].encode()) + 1, zlib.crc32(texts[d].encode()))
    if name == "op7_packing":
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        for d, rows in got.sort_values("start").groupby("doc_id"):
            ids = [*tokens.whole(BYTE, texts[d]), 1]
            assert (rows["doc_tokens"] == len(ids)).all()
            at = 0
            for start, length, crc in zip(rows["start"], rows["length"], rows["ids_crc32"], strict=True):
                assert start == at and crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
                at += length
            assert at == len(ids)
    if name == "op1_token_counts":
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        assert all(n == len(tokens.whole(BYTE, texts[d])) for d, n in zip(got["doc_id"], got["n_tokens"], strict=True))


def test_kept_columns_that_clash(spark, odd, docs):
    table = odd.select("doc_id", "text", F.lit(5).alias("score"), F.lit(6).alias("SCORE_kept"), F.lit(8).alias("matches"), F.lit(9).alias("lang_pred"))
    model = toxicity.fit(toxicity.labelled_rows(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    got = toxicity.score(table, model, keep=("text", "score", "SCORE_kept"))
    assert got.columns == ["doc_id", "text", "score_kept", "SCORE_kept_kept", "score", "passages"]
    assert {(r.score_kept, r.SCORE_kept_kept) for r in got.collect()} == {(5, 6)}
    found = decontamination.contamination(table, spark.read.parquet(f"{SF}/benchmark.parquet"), keep=("matches",))
    assert found.columns == ["doc_id", "matches_kept", "contaminated", "matches"]
    told = language.predict(table, language.fit(docs), keep=("lang_pred",))
    assert told.columns == ["doc_id", "lang_pred_kept", "lang_pred", "score", "margin", "accepted"]
    assert {r.text for r in got.collect()} == {r.text for r in table.collect()}


def test_toxic_rows_are_drawn_by_id(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    n = labels.select("doc_id").distinct().count()
    assert toxicity.labelled_rows(docs, labels.union(labels)).count() <= n
    assert 0 < toxicity.labelled_rows(docs, labels, fit_rows=n // 3).count() < 0.6 * n


def test_segments_equal_a_quadratic_search():
    """Maximal segments, by their definition: the best of all spans, then the same on either side of it."""
    rng = random.Random(9)

    def search(scores, at=0):
        best = None
        for i in range(len(scores)):
            for j in range(i, len(scores)):
                total = sum(scores[i : j + 1])
                if total > 0 and (best is None or total > best[0]):
                    best = (total, i, j)
        if best is None:
            return []
        total, i, j = best
        return [*search(scores[:i], at), (at + i, at + j, total), *search(scores[j + 1 :], at + j + 1)]

    for _ in range(200):
        scores = [rng.choice([-1.0] * 3 + [rng.uniform(0.3, 4), -rng.uniform(0.1, 3)]) for _ in range(rng.randrange(1, 18))]
        hits = [(i, s) for i, s in enumerate(scores) if s != -1.0]
        got = [(i, j, round(s, 9)) for i, j, s in toxicity.segments(hits, -1.0)]
        assert got == [(i, j, round(s, 9)) for i, j, s in search(scores)]


def test_lambda_solves_its_equation():
    rng = np.random.default_rng(8)
    for _ in range(20):
        scores = np.r_[rng.uniform(1, 4, 5), -0.2]
        shares = np.r_[rng.uniform(0.0005, 0.01, 5), 0]
        shares[-1] = 1 - shares.sum()
        lam, k = toxicity.karlin(scores, shares)
        assert abs((shares * np.exp(lam * scores)).sum() - 1) < 1e-9 and lam > 0
        assert abs(k - (shares[:-1] * np.exp(lam * scores[:-1])).sum()) < 1e-12


def test_curve_converges_on_nearly_separable_counts():
    """Whole Newton steps diverge on these counts; the gradient of the penalised likelihood must vanish."""
    x, n0, n1 = np.array([0.0, 128.6, 185.2, 284.9]), np.array([67699.0, 297, 139, 130]), np.array([2.0, 450, 4630, 2112])
    a, b = toxicity.fit_curve(x, n0, n1)
    p = toxicity.probability(x, (a, b))
    left = n1 - (n0 + n1) * p
    assert b > 0 and abs(left.sum()) < 0.01 and abs(left @ np.log1p(x) - 1e-3 * b) < 0.01
    assert p[0] < 1e-3 and p[2] > 0.9


@pytest.mark.parametrize("mixed", [False, True])
@pytest.mark.parametrize(("similarity", "words"), [*((0.8, n) for n in (5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 40, 47, 48, 60, 80, 200, 700, 2000)), (0.85, 200), (0.9, 10), (0.9, 200)])
def test_recall_of_sketches(similarity, words, mixed):
    """Pairs with random substitutions, or insertions and deletions too, by brute force over all of them."""
    rng = np.random.default_rng(5)
    n, met, pairs = int((1 - similarity) * words + 1e-9), 0, 0
    while pairs < 200:
        a = rng.integers(1, 1 << 62, words).astype("u8")
        b = a.copy()
        if mixed:
            for _ in range(n):
                at, kind = int(rng.integers(len(b))), rng.integers(3)
                b = np.delete(b, at) if kind == 0 else np.insert(b, at, rng.integers(1, 1 << 62).astype("u8")) if kind == 1 else np.r_[b[:at], rng.integers(1, 1 << 62).astype("u8"), b[at + 1 :]]
        else:
            b[rng.choice(words, n, replace=False)] = rng.integers(1, 1 << 62, n).astype("u8")
        if near_duplicates.similar(a, b, similarity):
            pairs += 1
            met += bool(set(near_duplicates.sketches(a).tolist()) & set(near_duplicates.sketches(b).tolist()))
    assert met >= 0.9 * pairs


def test_similar_texts_share_a_length_of_mers():
    for n in range(1, 200):
        for m in range(n, int(n / 0.8 + 1e-9) + 1):
            assert near_duplicates.mers_of(n, 5, 0.8) & near_duplicates.mers_of(m, 5, 0.8)
    assert near_duplicates.mers_of(300, 5, 0.8) == {5} and near_duplicates.mers_of(20, 5, 0.8) == {3}


def test_near_duplicates_of_short_texts(spark):
    """Classes of short texts against brute force over all pairs; the id is named like a result."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3_000)]
    rows = []
    for _ in range(150):
        base = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        rows.append(base)
        other = base.copy()
        for _ in range(len(base) // 5):
            other[rng.randrange(len(other))] = rng.choice(words)
        rows.append(other)
    hashes = [near_duplicates.words_of(" ".join(r)) for r in rows]
    links = {(i, j) for i in range(len(rows)) for j in range(i) if near_duplicates.similar(hashes[i], hashes[j], 0.8)}
    assert len(links) > 140
    table = spark.createDataFrame([(i, " ".join(r), 1) for i, r in enumerate(rows)], "node bigint, text string, class_id int")
    got = near_duplicates.near_duplicates(table, "node")
    assert got.columns == ["node_kept", "class_id", "node"]
    of = {r.node_kept: r.class_id for r in got.collect()}
    assert sum(of[i] == of[j] for i, j in links) >= 0.9 * len(links)
    assert all(of[i] == i or (i, of[i]) in links or any(of[j] == of[i] and ((i, j) in links or (j, i) in links) for j in of if j != i) for i in of)


def test_short_items_match_whole_words():
    index = decontamination.build([(1, "Blue whale"), (2, "a" * 20), (3, None), (4, "?!")])
    assert [m[0] for m in decontamination.matches("see the blue, WHALE here; blue whales", index)] == [1]
    assert decontamination.matches("x" + "a" * 20, index) == []


def test_slices_of_items_find_the_same(docs, spark, monkeypatch):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index, texts = decontamination.build(items), [r.text for r in docs.collect()][:300]
    want = [decontamination.matches(t, index) for t in texts]
    monkeypatch.setattr(decontamination, "PLACES", 3)
    assert [decontamination.matches(t, index) for t in texts] == want


def test_blocks_of_items_find_the_same(docs, spark, monkeypatch):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    key = lambda df: sorted((r.doc_id, r.contaminated, sorted((m.item_id, m.start) for m in r.matches)) for r in df.collect())
    want = key(decontamination.contamination(docs.limit(150), benchmark))
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0]
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", chars // 5)
    got = decontamination.contamination(docs.limit(150), benchmark, keep=("text",))
    assert got.columns == ["doc_id", "text", "contaminated", "matches"] and key(got) == want
    monkeypatch.setattr(decontamination, "TEXT_BYTES", 3_000)
    before = list(common._STAGES)
    with common.scratch(spark):
        assert key(decontamination.contamination(docs.limit(150), benchmark)) == want
        (folder,) = common._STAGES[len(before) :]  # the indexes: the corpus is written nowhere
        files = list(Path(common.local_path(folder)).iterdir())
        assert len(files) > 1 and not any(f.name.endswith(".tmp") for f in files)
        assert len(files) <= 6
    assert not Path(common.local_path(folder)).exists()


def test_items_without_an_id(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog near the river"
    docs = spark.createDataFrame([(1, f"so {item}, {item}"), (2, "nothing"), (3, None), (4, "")], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, item), (7, item), (None, item + " bank"), (8, None)], "item_id bigint, text string")
    for most in (2_000_000, 60):
        monkeypatch.setattr(decontamination, "BLOCK_CHARS", most)
        rows = {r.doc_id: [m.item_id for m in r.matches] for r in decontamination.contamination(docs, items).collect()}
        assert rows[2] == rows[3] == rows[4] == [] and [i for i in rows[1] if i == 7] == [7, 7] and rows[1][0] is None


def test_worker_keeps_one_operators_state():
    path = BYTE
    tokens.counter(path)("some words")
    assert any(k[0] == "tokens" for k in common._STATE)
    common.worker_state(("near-duplicates",), dict)
    assert list(common._STATE) == [("near-duplicates",)]
    small = tokens.Chunks(path, "", len, 1_000, None, tokens.Pieces(path), None)
    for i in range(200):
        assert small[f"word{i}x"] == len(tokens.whole(path, f"word{i}x"))
    assert len(small) < 10


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_are_kept_once_they_repeat(path):
    made = tokens.Chunks(path, "", len, 10**9, None, tokens.Pieces(path), None)
    for i in range(3_000):
        for x in (f"once{i}x", f"often{i % 30}x"):
            assert made[x] == len(tokens.whole(path, x))
    assert all(f"often{i}x" in made for i in range(30)) and len(made) < 100


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_words_and_marks_equal_the_library(path):
    common._STATE.clear()
    rng, encode, kind = random.Random(8), tokens.encoder(path), f"<u{tokens.id_width(path)}"
    parts = ["It", "the", "wOrd", "zqxj", "Ünder", "café", "s", "don't", "a" * 47, "b" * 48, "x1", "9", ""]
    for _ in range(3_000):
        text = " ".join(rng.choice(parts) + rng.choice(["", "", ".", ",", "?", "!", ":", ";", "'", "..", ".)", "|>", "\n" + rng.choice(parts[:4])]) for _ in range(rng.randrange(1, 6)))
        assert np.frombuffer(encode(text), kind).tolist() == tokens.whole(path, text), text


def test_among_keeps_every_key(spark):
    rows = spark.range(5000).withColumn("key", F.xxhash64("id"))
    keys = rows.where("id % 7 = 0").select("key")
    kept = {x.id for x in common.among(rows, keys, "key").select("id").collect()}
    assert {x for x in range(0, 5000, 7)} <= kept and len(kept) < 720
    assert common.among(rows, keys.limit(0), "key").count() == 0


def test_near_duplicates_behind_a_common_passage(spark):
    """Near copies among documents that share 70 % of their words meet no leader of their own; every pair is found all the same."""
    rng = random.Random(11)
    passage = [f"common{i}" for i in range(105)]
    texts = []
    for i in range(100):
        own = [f"own{i}x{j}" for j in range(45)]
        texts.append(passage + own)
        if i < 40:
            copy = passage + own
            for at in rng.sample(range(150), 8):
                copy[at] = f"new{i}x{at}"
            texts.append(copy)
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    words = [near_duplicates.words_of(" ".join(t)) for t in texts]
    met = lambda x, y: bool(set(near_duplicates.order_min_hash(words[x]).tolist()) & set(near_duplicates.order_min_hash(words[y]).tolist()))
    want = list(range(len(texts)))
    for x in range(len(texts)):
        for y in range(x):
            if near_duplicates.similar(words[x], words[y], 0.8) and met(x, y):
                want = [want[y] if c == want[x] else c for c in want] if want[y] < want[x] else [want[x] if c == want[y] else c for c in want]
    assert len(set(want)) == 100
    assert {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(table).collect()} == dict(enumerate(want))


def records(spark) -> int:
    """Rows written to shuffles so far."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_near_duplicates_shuffle_lonely_sketches_once(spark):
    """Without broadcasts of whole tables: sketches that no other text has go to their bucket, and no further."""
    rng = random.Random(21)
    texts = [" ".join(str(rng.randrange(10**9)) for _ in range(60)) for _ in range(600)]
    texts += [x + " end" for x in texts[:30]]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    sketched = sum(len(near_duplicates.sketches(near_duplicates.words_of(x))) for x in texts)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = records(spark)
        got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(table).collect()}
        shuffled = records(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == {i: i if i < 600 else i - 600 for i in range(630)}
    assert sketched < shuffled < 1.6 * sketched


def test_bounds_never_exceed_the_distance():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.randrange(40) for _ in range(rng.randrange(1, 60))]
        b = [x for x in a if rng.random() > 0.1] + [rng.randrange(40) for _ in range(rng.randrange(6))]
        x, y = (near_duplicates.mix(np.array(v, "u8")) for v in (a, b))
        bins = np.stack([np.frombuffer(near_duplicates.bins_of(v), "u1") for v in (x, y)])
        assert near_duplicates.far_apart(bins[0], bins[1:])[0] <= near_duplicates.banded_distance(x, y, 200)


@pytest.mark.parametrize(("size", "part"), [(2, 0.8), (3, 0.7), (8, 0.7), (2, 1.0)])
def test_sharding_keeps_small_groups_whole(spark, size, part):
    n = 4_800
    table = spark.range(n).select("id", F.when(F.col("id") < int(n * part), F.concat(F.lit("g"), F.floor(F.col("id") / size).cast("string"))).alias("link"))
    got = sharding.shard_rows(table, 16, keep=("link",)).persist()
    cut = got.where("link is not null").groupBy("link").agg(F.countDistinct("shard").alias("c")).agg(F.avg((F.col("c") > 1).cast("int"))).first()[0]
    print("cut share", size, part, cut)
    assert {r.n for r in got.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {n // 16}
    assert cut <= 0.05


@pytest.mark.parametrize("dim", [3, 40])
def test_blocks_of_queries_against_brute_force(dim, monkeypatch):
    monkeypatch.setattr(neighbours, "HELD", 500)  # the best are chosen again and again
    rng = np.random.default_rng(dim)
    raw = rng.normal(size=(900, dim))
    raw[700:] = raw[rng.integers(0, 5, 200)] * 2.0 ** rng.integers(-3, 4, 200)[:, None]  # many multiples of a few
    unit = raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))
    ids = rng.permutation(900)
    asked = np.r_[np.arange(0, 900, 30), 701, 702]
    for factor in (1.0, 2.0):
        at, rows, compared = neighbours.search_block(neighbours.build_tree(unit, 16), unit, unit[asked], 6, factor, neighbours.chosen(raw, ids, raw[asked], 6))
        assert compared <= len(asked) * 900
        if dim == 3:
            assert compared < 0.7 * len(asked) * 900
        hits = 0
        for i, q in enumerate(asked):
            score = neighbours.cosine(raw, np.repeat(raw[q : q + 1], 900, axis=0))
            best = np.lexsort((ids, -score))[:6].tolist()
            got = rows[at == i].tolist()
            hits += len(set(best) & set(got))
            if factor == 1.0:
                assert got == best
        assert hits >= 0.7 * 6 * len(asked)


def test_a_search_of_no_points_or_queries():
    none = np.zeros((0, 4))
    tree = neighbours.build_tree(none)
    at, rows, compared = neighbours.search_block(tree, none, np.ones((2, 4)), 3, 1.0, neighbours.chosen(none, np.zeros(0), np.ones((2, 4)), 3))
    assert len(at) == len(rows) == compared == 0
    unit = np.eye(4)
    at, _, _ = neighbours.search_block(neighbours.build_tree(unit), unit, none, 3, 1.0, neighbours.chosen(unit, np.arange(4), none, 3))
    assert len(at) == 0


@pytest.mark.parametrize("hot", [1, 4, 10**9])
def test_join_of_repeated_keys_equals_a_plain_one(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else f"k{min(i % 90, 40)}") for i in range(900)] + [(None, "k1"), (None, None)], "id bigint, g string")
    groups = common.stage(rows.where("g is not null").groupBy("g").agg(F.count("*").alias("n"), F.max("id").alias("last")).where("n > 10"), "t")
    want = sorted(map(repr, map(tuple, rows.join(groups, "g", "left").select("id", "g", "last").collect())))
    assert sorted(map(repr, map(tuple, common.join_repeated(rows, groups, "g").select("id", "g", "last").collect()))) == want
    assert common.join_repeated(rows.limit(0), groups.limit(0), "g").count() == 0
