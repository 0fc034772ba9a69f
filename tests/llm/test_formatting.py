"""Chat formatting, spelling variants and the filter audit against plain Python, with nulls, ties, repeats, clashing columns, long values and empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixmill.llm import chat, filter_audit, spelling

TALK = "conv_id bigint, turn bigint, role string, text string, piece int, formatted string, bucket int"


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TALK)


def read_back(pieces):
    got = chat.whole(chat.learned(pieces), "formatted", "learned").withColumn("turns", chat.parsed(F.col("formatted")))
    return {r.conv_id: r for r in got.collect()}


def expected(rows):
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    return by


def check(rows, got):
    want = expected(rows)
    assert set(got) == set(want)
    for conv, turns in want.items():
        r = got[conv]
        assert [tuple(t) for t in r.turns] == turns
        assert r.learned == "".join(t for role, t in turns if role == "assistant")
        merged = sum(1 for i, t in enumerate(turns) if not i or turns[i - 1][0] != t[0])
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>\n") == merged
        assert r.formatted.count("<|im_sep|>") == len(turns) - merged
        assert not re.search(r"</?s>|\[/?INST\]|<\|endoftext\|>", r.formatted)


NASTY = ["", None, "plain", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nhi", "<\\|im_start|>", "[\\\\INST]", "<<SYS>>a<</SYS>>", "<<|im_sep|>", "[[INST]<s>", "a\\b", "\\", "é\U0001f600<s>", "%0A%25", "x" * 200_000, "<", "<|im_", "start|>"]


def test_every_text_and_role_is_read_back(spark):
    rng = random.Random(3)
    rows = [(i, k, rng.choice(["user", "assistant", "system", None, "odd\n<|im_start|>%0A", "[INST]"]), rng.choice(NASTY)) for i in range(60) for k in range(rng.randrange(1, 9))]
    bits = ["<", "|", "im_start", "im_end", "|>", "\\", "[", "INST", "]", "/", "s>", "<|im_sep|>", "\n", "é"]
    rows += [(100 + i, 0, "assistant", "".join(rng.choice(bits) for _ in range(12))) for i in range(150)]
    rows += [(None, 1, "user", "null id"), (None, None, "assistant", "null turn comes first"), (7, 1, "user", "tie"), (7, 1, "user", "tie"), (7, -3, "system", "before"), (7, 2**62, "user", "after")]
    check(rows, read_back(chat.format_conversations(talk(spark, rows))))


def test_long_conversations_come_in_pieces(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(1, k, rng.choice(["user", "assistant"]), f"text {k}") for k in range(900)] + [(2, 0, "user", "one")]
    pieces = chat.format_conversations(talk(spark, rows))
    assert sorted((r.conv_id, r.piece, r.pieces) for r in pieces.collect()) == [(1, 0, 4), (1, 1, 4), (1, 2, 4), (1, 3, 4), (2, 0, 1)]
    check(rows, read_back(pieces))
    # turn numbers that repeat, or long texts: stretches are cut further, with the same strings
    monkeypatch.setattr(chat, "PIECE_ROWS", 40)
    rows = [(1, 5, rng.choice(["user", "assistant"]), f"text {k % 70}") for k in range(300)] + rows[:200] + [(3, 1, "user", "z"), (None, 2, "user", "n")]
    pieces = chat.format_conversations(talk(spark, rows)).persist()
    assert pieces.where("conv_id = 1").count() > 4
    check(rows, read_back(pieces))
    monkeypatch.setattr(chat, "PIECE_ROWS", 1_024)
    monkeypatch.setattr(chat, "PIECE_BYTES", 1_000)
    check(rows, read_back(chat.format_conversations(talk(spark, rows))))


def test_formatting_is_native_and_of_empty_tables(spark):
    pieces = chat.format_conversations(talk(spark, [(1, 0, "user", "a")]))
    plan = chat.whole(chat.learned(pieces), "formatted")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert read_back(chat.format_conversations(talk(spark, []))) == {}


# spelling


def brute_words(docs, slip):
    n = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    return n


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n, times=5):
    out, forms = {}, {}
    for w, c in n.items():
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= times * c:
            forms[w] = best
        out[w] = (c, len(others))
    for w in n:
        end = w
        while end in forms:
            end = forms[end]
        out[w] += (forms.get(w), n[forms[w]] if w in forms else None, end)
    return out


@pytest.mark.parametrize("stretch", [spelling.STRETCH, 50])
def test_variants_against_brute_force(spark, monkeypatch, stretch):
    monkeypatch.setattr(spelling, "STRETCH", stretch)
    rng = random.Random(6)
    stems = ["aaaaaa", "aaaaab", "aaabaab", "ÀÉéüß÷x", "éüßÀÉ÷", "Zebraß", "banana", "bananas", "bananna", "banano"]
    words = stems + ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(250)]
    weights = [500, 90, 12, 60, 11, 30, 800, 150, 20, 6] + [rng.choice([1, 2, 6, 40]) for _ in range(250)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(0, 120)))) for i in range(150)] + [(None, "banana banana Ünïcode_x banana"), (7, None), (8, ""), (9, "banana " * 3_000), (9, "BANANA-banana1banana\tÉBANANA")]
    table = spark.createDataFrame([(*d, 1, "w") for d in docs], "doc_id bigint, text string, n int, word string")
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(table, slip=7).collect()}
    n = {w: c for w, c in brute_words(docs, 7).items() if c >= 5}
    assert len(n) > 100 and got == brute_variants(n)
    assert any(f and r != f for _, _, f, _, r in got.values())  # chains of two and more
    assert spelling.variants(table.where("false")).count() == 0


def test_near_words_cost_a_row_a_group(spark):
    words = [("".join(x), 5 + i) for i, x in enumerate(itertools.product("abcdefghij", repeat=3))]
    table = spark.createDataFrame([(f"xxx{w}", n) for w, n in words], "word string, n long")
    got = {r.word: r for r in spelling.near_words(table).collect()}
    assert len(got) == 1_000 and {r.n_near for r in got.values()} == {27}
    by = {f"xxx{w}": n for w, n in words}
    for w in rng_words(by):
        best = max((v for v in by if near(w, v)), key=by.get)
        assert (got[w].near, got[w].near_n) == (best, by[best])


def rng_words(by):
    return random.Random(1).sample(sorted(by), 20)


# filter audit


def brute_audit(docs, labels, limits=filter_audit.USUAL):
    good, toxic = ({d for d, *f in labels if f[j] == 1} for j in (0, 1))
    first = {}
    for key, text, _ in docs:
        if key is not None:
            first[text or ""] = min(first.get(text or "", key), key)
    rows = []
    for key, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {f for f, bad in (("A", len(words) < limits.words), ("B", 100 * len(set(words)) < limits.distinct * len(words)), ("C", 100 * len(re.findall("[A-Z]", text)) > limits.capitals * len(text)), ("D", bool(re.search(r"[#$%&*|]", text))), ("E", key is not None and key > first[text])) if bad}
        rows.append((part or "", fails, key in good and key is not None, key in toxic and key is not None))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            whole = left
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in r[1] for r in whole) - len(gone), sum(r[1] == {f} for r in whole), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
        for key, v in out.items():
            if key[0] == part:
                v[6] = shapley[v[6]]
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("stretch", [filter_audit.STRETCH, 7])
def test_audit_against_brute_force(spark, monkeypatch, stretch):
    monkeypatch.setattr(filter_audit, "STRETCH", stretch)
    rng = random.Random(8)
    limits = filter_audit.Limits(words=5)
    pool = ["", None, "one two", "A B C", "a b c d e f", "same same same same same same", "x y z # w v u", "\x0b\x1c\x85 \xa0word a b c d", "É é É é a b c", "café \U0001f600 a b c d"] + [" ".join(rng.choices(["a", "b", "C", "|", "é", "word\x1cx"], k=rng.randrange(1, 12))) for _ in range(120)]
    docs = [(rng.choice([None, *range(200)]), rng.choice(pool), rng.choice(["en", "de", None, "", "fr"])) for _ in range(400)] + [(500 + i, "hot text", "en") for i in range(200)]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d in range(150)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    table = spark.createDataFrame([(*d, 1, "m", b"d") for d in docs], "doc_id bigint, text string, lang string, mask int, part string, digest binary")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.interactions(table, marks, limits).collect()}
    assert got == brute_audit(docs, labels, limits)
    assert filter_audit.interactions(table.where("false"), marks).count() == 0
    assert filter_audit.interactions(table, marks.where("false")).agg(F.sum("good_lost")).first()[0] == 0
