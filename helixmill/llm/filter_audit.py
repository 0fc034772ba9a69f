"""How filters of a corpus interact: for every order of five filters and every step, what it removes, what it would have removed, and what good and toxic documents go with it.

A document is a mask of the filters it fails. Which step of an order removes a mask is looked up in a table of 32 masks by 120 orders; tasks count masks by part and label with ``numpy.bincount``, turn the counts through the table into arrays over (order, step), and Spark adds up the tasks' arrays. Texts are read once, in the tasks that scan them; rows with a digest of the text, never texts, meet to find copies, and only those whose digest occurs more than once.

Defined cases: null texts count as empty (and so as copies of each other), null parts as the empty string. A row without an id is no copy of another and no other's original; rows of one id and equal texts are not copies of each other. Of several label rows of an id, one with the flag suffices. Parts are few (each task emits 600 rows a part). Empty tables give no rows. Extra columns are not read. Words of long texts are counted in stretches.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm import common

FILTERS = "ABCDE"
ORDERS = ["".join(x) for x in permutations(FILTERS)]
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
_CAPITALS = bytes(range(65, 91))
STRETCH = 4_000_000


@dataclass(frozen=True)
class Limits:
    """Failure conditions: A, fewer than ``words``; B, under ``distinct`` percent of them distinct; C, over ``capitals`` percent of the code points in A to Z; D, a character of ``symbols``."""

    words: int = 200
    distinct: int = 50
    capitals: int = 3
    symbols: bytes = b"#$%&*|"


USUAL = Limits()


def first_failures() -> np.ndarray:
    """(32, 120): the step, from 0, of an order at which a mask is removed; 5 if at none."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    return np.array([[next((k for k, f in enumerate(order) if mask & bit[f]), len(FILTERS)) for order in ORDERS] for mask in range(1 << len(FILTERS))])


def words_of(text: bytes) -> tuple[int, int]:
    """Words, and distinct words."""
    if len(text) <= STRETCH:
        found = text.split()
        return len(found), len(set(found))
    n, seen, at = 0, set(), 0
    while at < len(text):
        cut = _BLANK.search(text, at + STRETCH)
        end = cut.start() if cut else len(text)
        found = text[at:end].split()
        n += len(found)
        seen.update(found)
        at = end
    return n, len(seen)


def masks(docs: DataFrame, limits: Limits = USUAL, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask, digest) of each row: which of the first four filters it fails, and its text's SHA-256."""

    def told(batches):
        common.worker_state("filter_audit", dict)  # gives up what other operators keep
        for batch in common.slices(batches, 2):
            texts = pc.fill_null(batch.column(2), "")
            points = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
            out, digests = np.zeros(batch.num_rows, "i4"), []
            for i, text in enumerate(texts.cast(pa.binary()).to_pylist()):
                n, distinct = words_of(text)
                capitals = len(text) - len(text.translate(None, _CAPITALS))
                marked = len(text.translate(None, limits.symbols)) != len(text)
                out[i] = (n < limits.words) | (100 * distinct < limits.distinct * n) << 1 | (100 * capitals > limits.capitals * int(points[i])) << 2 | marked << 3
                digests.append(hashlib.sha256(text).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out), pa.array(digests, pa.binary())], ["id", "part", "mask", "digest"])

    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    return slim.mapInArrow(told, f"id {slim.schema['id'].dataType.simpleString()}, part string, mask int, digest binary")


def with_copies(told: DataFrame) -> DataFrame:
    """The rows with filter E in their mask: whether a smaller id has an equal text. ``told`` is a written table."""
    groups = common.stage(told.groupBy("digest").agg(F.min("id").alias("lowest"), F.count("*").alias("n")).where("n > 1"), "copied")
    found = common.join_repeated(told, groups, "digest")
    copy = F.coalesce(F.col("id") > F.col("lowest"), F.lit(False))
    return found.select("id", "part", F.col("mask").bitwiseOR(F.when(copy, 1 << 4).otherwise(0)).alias("mask"))


def with_labels(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """The rows with booleans good and toxic. Rows without an id take no part in the join."""
    flag = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    by = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(flag(good_col).alias("good"), flag(toxic_col).alias("toxic"))
    joined = rows.where("id is not null").join(by, "id", "left")
    return joined.unionByName(rows.where("id is null"), allowMissingColumns=True).select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(rows: DataFrame) -> DataFrame:
    """Per part, filter_order and step the counts of ``rows`` (part, mask, good, toxic); every order and step of a part that occurs, zeros too."""
    k = len(FILTERS)
    first = first_failures()
    place = (np.arange(len(ORDERS)) * (k + 1) + first).ravel()  # of (mask, order) in an array over (order, step or none)
    acts = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    fails = np.array([[mask >> f & 1 for f in range(k)] for mask in range(1 << k)])

    def removals(counts: np.ndarray) -> np.ndarray:
        """(orders, steps and none) from counts by mask."""
        return np.bincount(place, weights=np.repeat(counts, len(ORDERS)), minlength=len(ORDERS) * (k + 1)).reshape(len(ORDERS), k + 1).astype("i8")

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            parts = coded.dictionary.to_pylist()
            cell = coded.indices.to_numpy(zero_copy_only=False).astype("i8") * (1 << k) + batch.column(1).to_numpy()
            flags = [np.ones(len(cell), bool), *(batch.column(j).to_numpy(zero_copy_only=False).astype(bool) for j in (2, 3))]
            new = np.stack([np.bincount(cell[f], minlength=len(parts) << k).reshape(len(parts), 1 << k) for f in flags], axis=1)
            for part, counts in zip(parts, new, strict=True):
                held[part] = held[part] + counts if part in held else counts
        for part, (n, good, toxic) in held.items():
            gone = removals(n)
            failing, alone = n @ fails, n[1 << np.arange(k)]
            shapley = np.bincount(acts.ravel(), weights=gone[:, :k].ravel(), minlength=k).astype("i8")
            columns = [n.sum() - np.cumsum(gone[:, :k], axis=1), gone[:, :k], failing[acts] - gone[:, :k], alone[acts], removals(good)[:, :k], removals(toxic)[:, :k], shapley[acts]]
            yield pa.RecordBatch.from_arrays([pa.array([part] * acts.size), pa.array(np.repeat(ORDERS, k)), pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), len(ORDERS))), *(pa.array(np.ascontiguousarray(c).ravel().astype("i8")) for c in columns)], ["part", "filter_order", "step", *COUNTS])

    partial = rows.mapInArrow(count, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
    return partial.groupBy("part", "filter_order", "step").agg(*[F.sum(c).alias(c) for c in COUNTS])


def interactions(docs: DataFrame, labels: DataFrame, limits: Limits = USUAL, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of ``docs`` with ``labels`` (``id_col``, quality, toxic)."""
    told = common.stage(masks(docs, limits, id_col, text_col, part_col), "masks")
    return audit(with_labels(with_copies(told), labels, id_col))
