"""Benchmark decontamination by q-gram lemma filtering.

A passage of a document that matches a benchmark item of m characters with at most e edits shares at least m - q + 1 - e q of the item's q-grams, and all of them lie within e diagonals of each other. So the shared q-grams are counted in overlapping diagonal bands (each of twice e + 1 diagonals, one starting every e + 1): a region whose band holds fewer is no match. What remains is verified by an alignment in the band, and what is within the edit budget is a match.

Texts are compared in lower case, with every run of other characters than letters and digits as one space. The budget is ``edits`` of an item's characters, or less where the lemma would demand no q-gram.

Defined cases: null and empty texts match nothing; items that are null or have no letter or digit match nothing; items of under ``min_chars`` characters match without edits, as whole words; an item matches as a whole only; equal items match each on their own; repeated rows give one row each; a kept column named as an output is named ``<name>_kept``. Only the named columns are read. Items of at most ``BLOCK_CHARS`` characters in all are one broadcast index. More are dealt to blocks of about that many, whose indexes tasks write to the shared folder; a task then reads one after another for each slice of its texts (at most ``TEXT_BYTES``, or one text), so that the corpus is passed over once and memory is bounded by an index and a slice, however large the benchmark is.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm import common

Q, EDITS, MIN_CHARS, BLOCK_CHARS, PLACES, TEXT_BYTES = 8, 0.08, 32, 2_000_000, 2_000_000, 32_000_000
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> str:
    return " ".join(_WORD.findall(text.lower()))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def grams(c: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of Q codes, by doubling."""
    with np.errstate(over="ignore"):
        one, base, step = c.astype("u8") + np.uint64(1), _BASE, 1
        h, size, n = None, 0, max(0, len(c) - Q + 1)
        while step <= Q:
            if Q & step:  # the run so far, then this power of two
                h = one[:n] if h is None else h * base + one[size : size + n]
                size += step
            if 2 * step <= Q:
                one = one[:-step] * base + one[step:]
                base = base * base
            step *= 2
        return (h ^ (h >> np.uint64(29))) * _BASE


@dataclass
class Index:
    ids: list
    items: list[np.ndarray]
    texts: list[str]
    budget: np.ndarray
    least: np.ndarray
    short: list[tuple]  # (item id, its words between spaces) of items that are too short for q-grams
    keys: np.ndarray  # distinct q-grams, sorted
    first: np.ndarray  # where each one's places begin
    place_item: np.ndarray  # ascending within a q-gram
    place_at: np.ndarray
    place_key: np.ndarray  # q-gram's number * items + item, ascending
    quick: np.ndarray  # by the top 20 bits of a q-gram: may it be there?


def build(items: list[tuple], edits: float = EDITS, min_chars: int = MIN_CHARS) -> Index:
    """An index of (item id, text)."""
    plain = [(i, normal(t)) for i, t in items if t]
    kept = [(i, codes(t)) for i, t in plain if len(t) >= max(min_chars, Q + 1)]
    short = [(i, f" {t} ") for i, t in plain if 0 < len(t) < max(min_chars, Q + 1)]
    size = np.array([len(c) for _, c in kept], "i8")
    budget = np.minimum(np.floor(edits * size), (size - Q) // Q).astype("i8")
    hashes = [grams(c) for _, c in kept]
    h = np.concatenate(hashes) if hashes else np.zeros(0, "u8")
    item = np.repeat(np.arange(len(kept)), [len(x) for x in hashes])
    at = np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else np.zeros(0, "i8")
    order = np.argsort(h, kind="stable")
    keys, first, slot = np.unique(h[order], return_index=True, return_inverse=True)
    quick = np.zeros(1 << 20, bool)
    quick[(keys >> np.uint64(44)).astype("i8")] = True
    return Index([i for i, _ in kept], [c for _, c in kept], [c.tobytes().decode("utf-32-le", "surrogatepass") for _, c in kept], budget, size - Q + 1 - budget * Q, short, keys, np.append(first, len(h)), item[order], at[order], slot * len(kept) + item[order], quick)


def candidates(c: np.ndarray, index: Index) -> list[tuple[int, int]]:
    """(item, band) of each region that shares enough q-grams."""
    if len(c) <= Q or not len(index.keys):
        return []
    h = grams(c)
    here = np.flatnonzero(index.quick[(h >> np.uint64(44)).astype("i8")])
    slot = np.searchsorted(index.keys, h[here])
    slot[slot == len(index.keys)] = 0
    true = index.keys[slot] == h[here]
    here, slot = here[true], slot[true]
    if not len(here):
        return []
    found: list[tuple[int, int]] = []
    todo = [(0, len(index.items))]
    while todo:  # slices of items, halved until their shared q-grams have at most ``PLACES`` places or the item is one
        i, j = todo.pop()
        low, high = (np.searchsorted(index.place_key, slot * len(index.items) + x) for x in (i, j))
        if int((high - low).sum()) > PLACES and j - i > 1:
            todo += [((i + j) // 2, j), (i, (i + j) // 2)]
        else:
            found += _dense(here, low, high - low, len(c), index)
    return found


def _dense(here: np.ndarray, low: np.ndarray, n: np.ndarray, size: int, index: Index) -> list[tuple[int, int]]:
    """(item, band) of the regions that share enough q-grams, from the q-grams at ``here`` with ``n`` places from ``low`` each."""
    if not n.sum():
        return []
    place = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    item, at = index.place_item[place], index.place_at[place]
    step = index.budget[item] + 1
    longest = max(len(x) for x in index.items)
    bands = size + longest + 2
    band = (np.repeat(here, n) - at + longest) // step
    key = np.concatenate([item * bands + band, item * bands + band - 1])
    # an item's q-gram counts once a band
    key = np.sort(key * longest + np.concatenate([at, at]))
    key = key[np.r_[True, key[1:] != key[:-1]]] // longest
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    counts = np.diff(np.append(starts, len(key)))
    keys = key[starts]
    enough = counts >= index.least[keys // bands]
    return [(int(x // bands), int(x % bands)) for x in keys[enough]]


def align(item: np.ndarray, c: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int] | None:
    """(distance, end in c) of the best match of the whole item that starts and runs on diagonals low .. high of c, if within the budget."""
    steps, far = np.arange(high - low + 1), 1 << 30
    starts = low + steps
    row = np.where((starts >= 0) & (starts <= len(c)), 0, far)
    left, right = max(0, -low), max(0, high + len(item) - len(c)) + 1
    padded = np.concatenate([np.zeros(left, "u4"), c[max(0, low) : high + len(item) + 1], np.zeros(right, "u4")])
    for i in range(1, len(item) + 1):
        cost = padded[i - 1 : i - 1 + len(steps)] != item[i - 1]
        best = np.minimum(row + cost, np.append(row[1:], far) + 1)
        j = starts + i
        best[(j < 0) | (j > len(c))] = far
        row = np.minimum.accumulate(best - steps) + steps
        if row.min() > budget:
            return None
    x = int(row.argmin())
    return int(row[x]), low + x + len(item)


def matches(text: str | None, index: Index) -> list[tuple]:
    """(item id, first character, end, distance) of each match; an item counts once at each place."""
    if not text:
        return []
    plain = normal(text)
    c = codes(plain)
    found: dict[tuple[int, int], tuple[int, int]] = {}
    longest = max((len(x) for x in index.items), default=0)
    for item, band in candidates(c, index):
        step, body = int(index.budget[item]) + 1, index.items[item]
        low = band * step - longest
        budget = int(index.budget[item])
        exact = plain.find(index.texts[item], max(0, low - budget), max(0, low + 2 * step + budget + len(body)))
        if exact >= 0:  # no edit on one diagonal of the band
            found.setdefault((item, exact + len(body)), (0, exact))
        elif got := align(body, c, low - budget, low + 2 * step + budget, budget):
            distance, end = got
            back = align(body[::-1], c[:end][::-1], 0, budget, budget)
            start = end - back[1] if back else max(0, end - len(body))
            near = next((k for k in found if k[0] == item and abs(k[1] - end) <= 2 * step), None)
            if near is None or found[near][0] > distance:
                found.pop(near, None)
                found[(item, end)] = (distance, start)
    exact_only = []
    for i, words in index.short:
        at = f" {plain} ".find(words)
        while at >= 0:
            exact_only.append((i, at, at + len(words) - 2, 0))
            at = f" {plain} ".find(words, at + 1)
    if not found and not exact_only:
        return []
    spans, at, starts = [], 0, []
    for m in _WORD.finditer(text.lower()):
        starts.append(at)
        spans.append(m.span())
        at += m.end() - m.start() + 1
    starts = np.array(starts)

    def place(x: int) -> int:
        w = int(np.searchsorted(starts, x, "right")) - 1
        return min(spans[w][0] + x - int(starts[w]), spans[w][1])

    every = [(index.ids[item], start, end, distance) for (item, end), (distance, start) in found.items()] + exact_only
    return sorted(((i, place(start), place(end - 1) + 1, distance) for i, start, end, distance in every), key=by_item)


def by_item(match: tuple) -> tuple:
    """The order of matches; items without an id come first."""
    return (match[0] is not None, match[0] or 0, *match[1:])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edits: float = EDITS, min_chars: int = MIN_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: its id, the columns of ``keep``, contaminated, and matches (item_id, start, end, distance) with places in characters of the text."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS) or 1
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("distance", pa.int32())]))
    fields = ("item_id", "start", "end", "distance")

    def finder(indexes, most=common.SLICE_BYTES):
        def work(texts):
            found = [[] for _ in texts]
            for index in indexes():
                for i, t in enumerate(texts):
                    found[i] += matches(t, index)
            told = [[dict(zip(fields, m, strict=True)) for m in sorted(x, key=by_item)] for x in found]
            return [bool(x) for x in told], told

        return common.text_columns(docs, text_col, (id_col, *keep), outputs, lambda: work, most)

    outputs = {"contaminated": ("boolean", pa.bool_()), "matches": ("array<struct<item_id: bigint, start: int, end: int, distance: int>>", kind)}
    if blocks == 1:
        held = spark.sparkContext.broadcast(build([tuple(r) for r in items.collect()], edits, min_chars))  # at most BLOCK_CHARS characters
        return finder(lambda: [held.value])
    paths = stored(items, blocks, edits, min_chars)
    return finder(lambda: map(read, paths), TEXT_BYTES)


def stored(items: DataFrame, blocks: int, edits: float, min_chars: int) -> list[str]:
    """The paths of the indexes of ``items`` (item_id, text) in ``blocks``, written by a task each. A task that is done again writes the same file."""
    folder = common.new_path(items.sparkSession, "benchmark")

    def write(key, block: pd.DataFrame) -> pd.DataFrame:
        ids = [None if pd.isna(i) else int(i) for i in block["item_id"]]
        path = f"{folder}/{key[0]}"
        common.write_whole(path, [pickle.dumps(build(list(zip(ids, block["text"], strict=True)), edits, min_chars), protocol=5)])
        return pd.DataFrame({"path": [path]})

    common.keep_until_end(folder)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    return sorted(r.path for r in dealt.groupBy("block").applyInPandas(write, "path string").collect())  # a row a block


def read(path: str) -> Index:
    system, at = common.file_system(path)
    with system.open_input_stream(at, compression=None) as f:
        return pickle.loads(f.read())
