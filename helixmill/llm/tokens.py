"""Token counts (map-side two-tier lookup) and the encoder that other operators share.

A text is cut at single spaces, and at single line feeds between other characters, into chunks that the tokenizer treats independently of their neighbours, so the tokens of a text are the tokens of its chunks in order. Frequent chunks are looked up in a small broadcast table; other chunks are encoded by the tokenizers library and, from the second time on, kept in a cache of the Python worker, which outlives the task, holds ``CACHE_BYTES`` at most (as estimated), and is emptied when the worker turns to another operator. No chunk is ever shuffled.

Defined cases: a null text counts as an empty one and has 0 tokens; a tokenizer whose pre-tokenizer is of another kind than the two known ones, and a text whose runs of white space reach across a cut, are encoded whole by the library; chunks longer than ``LONGEST_KEPT`` characters are encoded each time and never kept. The tables and caches only save work: they never change a count.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections import Counter
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm import common

LONGEST_KEPT = 48
#: Bytes of a worker's chunks, and what an entry costs beside its characters (of a dictionary, a string and a value).
CACHE_BYTES, ENTRY_BYTES = 150_000_000, 190
#: The frequent table: its entries, the partitions looked at for it, and the texts of each.
TABLE_ENTRIES, TABLE_PARTITIONS, TABLE_TEXTS = 32_768, 8, 1_000
_ACROSS = re.compile(r"\s (?:\s|\Z)")


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a .json file, without truncation or padding."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=4)
def cut_rule(path: str) -> str | None:
    """"led": a space opens the chunk after it; "bare": white space is dropped; None: texts of this tokenizer can't be cut.

    "led" is the byte-level split, where a space followed by a non-space always opens a pre-token, and a space that follows a non-space always does too.
    """
    tok = load(path)
    if any(re.search(r"\s", x.content) or x.lstrip or x.rstrip or x.single_word for x in tok.get_added_tokens_decoder().values()):
        return None
    pre = json.loads(tok.pre_tokenizer.__getstate__()) if tok.pre_tokenizer else {}
    if tok.normalizer is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
        return "led"
    first = (pre.get("pretokenizers") or [{}])[0]
    lower = tok.normalizer is not None and all(tok.normalizer.normalize_str(x) == x.lower() for x in ("Aé b", "ÀÉ9!", "A" * 9)) and not tok.normalizer.normalize_str("X\nY").strip("xy").strip()
    if lower and first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and r"[^\s" in first["pattern"].get("Regex", ""):
        return "bare"
    return None


#: Letters of Latin-1 and ASCII digits and marks other than the apostrophe: in these, where the tokenizers' patterns cut is plain.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PLAIN = {"led": re.compile(rf"[{_LETTERS}]+|[0-9]+|[!-&(-/:-@\[-`{{-~]+"), "bare": re.compile(rf"[{_LETTERS}]+|[0-9]|[!-&(-/:-@\[-`{{-~]+")}


class Pieces:
    """Cuts plain chunks into pre-tokens, and gives a pre-token's ids by the tokenizer's model alone, which spares the library's work of aligning each with its text."""

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        tok, self.rule = load(path), cut_rule(path)
        self.model, self.added = tok.model, [x.content for x in tok.get_added_tokens_decoder().values()]
        self.find = _PLAIN[self.rule].findall
        shown = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {i: "".join(x for x, _ in shown.pre_tokenize_str(chr(i))) for i in range(32, 256)}
        letters = [chr(i) for i in range(128) if chr(i).isalpha()]
        #: Are ASCII letters shown as they are, and in no added token by themselves? Then chunks of these alone need no cutting and no showing.
        self.plain = all(self.shown[ord(x)] == x for x in letters) and not any(x.isascii() and x.isalpha() for x in self.added)
        #: Marks that end a word as a pre-token of their own; none that an added token of letters and a mark, or of the mark alone, ends with.
        self.marks = frozenset(x for x in "!,.:;?" if not any(y.endswith(x) and (y[:-1] + "a").isalpha() for y in self.added))
        self.leads = {x: x.translate(self.shown) for x in ("", " ")}

    def cut(self, chunk: str) -> list[str] | None:
        """The pre-tokens of a chunk of plain characters, else None."""
        parts = self.find(chunk)
        if not parts or len("".join(parts)) != len(chunk) or any(x in chunk for x in self.added):
            return None
        return parts

    def letters(self, chunk: str) -> bool:
        """Is the chunk of ASCII letters alone, so that ``letter_ids`` gives its ids?"""
        return self.plain and chunk.isascii() and chunk.isalpha()

    def letter_ids(self, chunk: str, lead: str) -> list[int]:
        return [x.id for x in self.model.tokenize(chunk.lower() if self.rule == "bare" else self.leads[lead] + chunk)]

    def ids(self, piece: str, lead: str) -> list[int]:
        piece = piece.lower() if self.rule == "bare" else lead + piece
        return [x.id for x in self.model.tokenize(piece.translate(self.shown))]


class Packers(dict):
    """By number of ids: what packs so many, little-endian."""

    def __init__(self, kind: str):
        super().__init__()
        self.code = "HI"[kind == "u4"]

    def __missing__(self, n: int):
        found = struct.Struct(f"<{n}{self.code}").pack
        if n <= LONGEST_KEPT:
            self[n] = found
        return found


class Chunks(common.Cache):
    """Chunk to ``value(ids)``; missing chunks are encoded and kept. ``after``: the cache of what follows a line feed."""

    def __init__(self, path: str, lead: str, value, limit: int, seed: dict | None, pieces: Pieces, after: Chunks | None):
        super().__init__(limit, seed)
        self.tok, self.lead, self.value, self.pieces, self.after = load(path), lead, value, pieces, self if after is None else after
        self.line = value([] if pieces.rule == "bare" else self.tok.encode("\n", add_special_tokens=False).ids)

    def of(self, chunk: str):
        if len(chunk) <= LONGEST_KEPT:  # most chunks that are missing: a word, or one with a mark after it
            if self.pieces.letters(chunk):
                return self.value(self.pieces.letter_ids(chunk, self.lead)), ENTRY_BYTES + len(chunk)
            if chunk and chunk[-1] in self.pieces.marks and self.pieces.letters(word := chunk[:-1]):
                return self[word] + self.after[chunk[-1]], ENTRY_BYTES + len(chunk)
        head, line, tail = chunk.partition("\n")
        if line and head and tail and not head[-1].isspace() and not tail[0].isspace():
            return self[head] + self.line + self.after[tail], None
        if len(chunk) > LONGEST_KEPT:
            return self.value(self.tok.encode(self.lead + chunk, add_special_tokens=False).ids), None
        parts, cost = self.pieces.cut(chunk), ENTRY_BYTES + len(chunk)
        if parts is None:
            return self.value(self.tok.encode(self.lead + chunk, add_special_tokens=False).ids), cost
        if len(parts) == 1:
            return self.value(self.pieces.ids(chunk, self.lead)), cost
        found = self[parts[0]]
        for x in parts[1:]:
            found += self.after[x]
        return found, cost


def chunks(path: str, kind: str, seed=None) -> tuple[Chunks, Chunks]:
    """The worker's caches of chunks after a space and of others; kind: "n" (lengths), or "u2" or "u4" (ids as little-endian bytes)."""

    def make():
        value = len if kind == "n" else lambda ids, packers=Packers(kind): packers[len(ids)](*ids)
        pieces, own = Pieces(path), seed() if seed else None
        if cut_rule(path) == "bare":
            both = Chunks(path, "", value, CACHE_BYTES, own, pieces, None)
            return both, both
        first = Chunks(path, "", value, CACHE_BYTES // 5, None, pieces, None)
        return Chunks(path, " ", value, CACHE_BYTES * 4 // 5, own, pieces, first), first

    return common.worker_state(("tokens", path, kind), make)


def whole(path: str, text: str) -> list[int]:
    return load(path).encode(text, add_special_tokens=False).ids


def counter(path: str, seed=None):
    """A function from text to its number of tokens."""
    rule = cut_rule(path)
    if rule is None:
        return lambda text: len(whole(path, text))
    led, first = (x.__getitem__ for x in chunks(path, "n", seed))
    if rule == "bare":
        return lambda text: sum(map(led, text.split(" ")))

    def count(text: str) -> int:
        if _ACROSS.search(text):
            return len(whole(path, text))
        head, *rest = text.split(" ")
        return first(head) + sum(map(led, rest))

    return count


def id_width(path: str) -> int:
    """Bytes of an id in files and columns: 2 if every id fits, else 4."""
    return 2 if load(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def encoder(path: str, seed=None):
    """A function from text to the bytes of its ids, little-endian, ``id_width`` bytes each."""
    rule, kind = cut_rule(path), f"u{id_width(path)}"
    plain = lambda text: np.array(whole(path, text), "<" + kind).tobytes()
    if rule is None:
        return plain
    led, first = (x.__getitem__ for x in chunks(path, kind, seed))
    if rule == "bare":
        return lambda text: b"".join(map(led, text.split(" ")))

    def encode(text: str) -> bytes:
        if _ACROSS.search(text):
            return plain(text)
        head, *rest = text.split(" ")
        return first(head) + b"".join(map(led, rest))

    return encode


def frequent_chunks(docs: DataFrame, text_col: str = "text", partitions: int = TABLE_PARTITIONS, texts: int = TABLE_TEXTS, entries: int = TABLE_ENTRIES) -> list[str]:
    """The most frequent chunks of the first ``texts`` texts of ``partitions`` partitions: a bounded sample, as it only fills a table that saves work.

    Each partition sends one row of at most ``entries`` chunks; Spark's limit looks at a few partitions only, however many there are.
    """

    def sketch(batches):
        found: Counter[str] = Counter()
        seen = 0
        for batch in batches:
            for text in batch.slice(0, texts - seen).column(0).to_pylist():
                if text:
                    seen += 1
                    found.update(x for x in text.replace("\n", " ").split(" ")[1:] if len(x) <= LONGEST_KEPT)
        best = found.most_common(entries)
        yield pa.RecordBatch.from_arrays([pa.array([" ".join(k for k, _ in best)]), pa.array([[n for _, n in best]], pa.list_(pa.int64()))], ["chunks", "counts"])

    total: Counter[str] = Counter()
    for row in docs.select(F.col(text_col)).mapInArrow(sketch, "chunks string, counts array<bigint>").limit(partitions).collect():
        if row.counts:
            total.update(dict(zip(row.chunks.split(" "), row.counts, strict=True)))
    return [k for k, _ in total.most_common(entries)]


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 1024) -> DataFrame:
    """Per row of ``docs``: its id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > window).

    Only the two named columns are read, so other columns may have any name. Repeated rows and repeated or null ids give one row each; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    frequent = frequent_chunks(docs, text_col)
    led = cut_rule(tokenizer) == "led"
    lengths = np.array([len(load(tokenizer).encode(" " * led + x, add_special_tokens=False).ids) for x in frequent], "<u2")
    table = spark.sparkContext.broadcast((" ".join(frequent), lengths.tobytes()))  # at most TABLE_ENTRIES short chunks

    def seed() -> dict[str, int]:
        joined, raw = table.value
        return dict(zip(joined.split(" "), np.frombuffer(raw, "<u2").tolist(), strict=True)) if raw else {}

    def count(batches):
        n = counter(tokenizer, seed)
        for batch in common.slices(batches, 1):
            texts = pc.fill_null(batch.column(1), "")
            counts = pa.array([n(x) for x in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), counts], ["id", "n_bytes", "n_tokens"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    out = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > window).alias("over_limit"))
