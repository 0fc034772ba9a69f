"""Mixture-controlled packing: deficit round-robin over source queues.

Every document belongs to the queue of its source; the queue is the stream of its documents' ids in table order. Each window of ``window`` tokens takes from every queue its share of the mixture: a queue's credit grows by its quantum a window, it sends the whole tokens it has credit for, and what is left of a window goes to the queues with the largest credit. Credits (deficits) carry over from window to window.

The schedule of a period of windows is worked out once, on the driver, from the queues' token totals alone. Where a document's ids fall is then arithmetic on its place in its queue: the place is a prefix sum over partitions, so that deficits carry across partitions too and no task waits for another. Tokens that whole periods leave over (quanta are whole numbers a period) are packed by a further level with its own quanta, until less than one period is left; only the very last window may be short.

The target proportions are the queues' shares of all tokens, so that all queues end together; ``weights`` gives others, and then the queues that end early leave the rest to the others.

Defined cases: a null text is empty and yields the end id alone; documents with a null source share one queue with those whose source is the empty string; repeated rows and ids are packed each; an empty table gives no pieces. Only the id, text and source columns are read. The driver holds one total a source and at most ``SCHEDULE_CELLS`` schedule cells a level.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm import common, tokens

PERIOD, SCHEDULE_CELLS = 256, 1 << 20


@dataclass
class Level:
    """Windows ``first ..`` of ``periods`` like periods. start: each queue's tokens before; quota: its tokens a period; sent: [queue, window], tokens before each window of a period; before: those of earlier queues in the window."""

    first: int
    periods: int
    start: np.ndarray
    quota: np.ndarray
    sent: np.ndarray
    before: np.ndarray


def round_robin(quota: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Deficit round-robin over windows of the given sizes that sends just ``quota`` in all: tokens as [queue, window]."""
    left, credit, total = quota.astype("i8").copy(), np.zeros(len(quota)), int(quota.sum())
    out = np.zeros((len(quota), len(sizes)), "i8")
    for w, size in enumerate(sizes):
        credit += quota * (size / total)
        send = np.clip(np.floor(credit + 1e-9).astype("i8"), 0, left)
        over = int(send.sum()) - int(size)
        if over > 0:  # rounding noise of the credits: take back where credit is least
            for q in np.argsort(credit - send, kind="stable"):
                back = min(over, int(send[q]))
                send[q] -= back
                over -= back
                if not over:
                    break
        while (short := int(size) - int(send.sum())) > 0:
            open_ = np.flatnonzero(left > send)
            best = open_[np.argsort(-(credit - send)[open_], kind="stable")][:short]
            send[best] += 1
        credit -= send
        left -= send
        out[:, w] = send
    return out


def schedule(totals: np.ndarray, window: int, weights: np.ndarray | None = None) -> list[Level]:
    """The levels that pack queues of the given token totals."""
    totals = totals.astype("i8")
    start, first, levels = np.zeros_like(totals), 0, []
    period = int(max(1, min(PERIOD, SCHEDULE_CELLS // max(1, len(totals)))))
    while (left := totals - start).sum() > 0:
        n = int(left.sum())
        share = left / n if weights is None else np.where(left > 0, weights, 0) / max(1e-300, np.where(left > 0, weights, 0).sum())
        if weights is not None and not share.sum():
            share = left / n
        quota = np.minimum(np.floor(share * (period * window)).astype("i8"), left)
        rest = period * window - int(quota.sum())
        by_size = np.argsort(-quota, kind="stable")
        if n >= period * window:
            while rest > 0:
                room = by_size[(left - quota)[by_size] > 0][:rest]
                if weights is not None and (named := room[share[room] > 0]).size:
                    room = named
                quota[room] += 1
                rest -= len(room)
            busy = quota > 0
            periods = int((left[busy] // quota[busy]).min())
            sizes = np.full(period, window)
        else:
            quota, periods = left.copy(), 1
            sizes = np.full(-(-n // window), window)
            sizes[-1] = n - window * (len(sizes) - 1)
        send = round_robin(quota, sizes)
        sent = np.concatenate([np.zeros((len(totals), 1), "i8"), np.cumsum(send, axis=1)], axis=1)
        levels.append(Level(first, periods, start.copy(), quota, sent, np.cumsum(send, axis=0) - send))
        start = start + quota * periods
        first += periods * len(sizes)
    return levels


def pieces_of(levels: list[Level], queue: int, a: int, b: int):
    """Arrays (start in the queue, length, sequence_id, offset) of the pieces of the queue's tokens a .. b - 1."""
    out = []
    for level in levels:
        q = int(level.quota[queue])
        lo, hi = max(a - int(level.start[queue]), 0), min(b - int(level.start[queue]), q * level.periods)
        if lo >= hi:
            continue
        sent, before, n = level.sent[queue], level.before[queue], level.sent.shape[1] - 1
        for p in range(lo // q, (hi - 1) // q + 1):
            x, y = max(lo - p * q, 0), min(hi - p * q, q)
            i, j = int(np.searchsorted(sent, x, "right")) - 1, int(np.searchsorted(sent, y, "left"))
            cuts = sent[i : j + 1].copy()
            cuts[0], cuts[-1] = x, y
            length = np.diff(cuts)
            w = np.arange(i, j)
            keep = length > 0
            out.append((cuts[:-1][keep] + int(level.start[queue]) + p * q, length[keep], (level.first + p * n + w)[keep], (before[i:j] + cuts[:-1] - sent[i:j])[keep]))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, "i8")] * 4


def tokenize(docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """A stage table of documents' ids: part (the partition that read it), at (tokens of the same source before it there), doc_id, source, n, ids."""

    def encode_all(batches):
        encode, width = tokens.encoder(tokenizer), tokens.id_width(tokenizer)
        end = b"" if end_id is None else int(end_id).to_bytes(width, "little")
        part, at = TaskContext.get().partitionId(), {}
        for batch in common.slices(batches, 1):
            sources = ["" if x is None else x for x in batch.column(2).to_pylist()]
            raw = [encode(x or "") + end for x in batch.column(1).to_pylist()]
            n = [len(x) // width for x in raw]
            starts = []
            for s, k in zip(sources, n, strict=True):
                starts.append(at.get(s, 0))
                at[s] = starts[-1] + k
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), pa.array(starts, pa.int64()), batch.column(0), pa.array(sources, pa.string()), pa.array(n, pa.int64()), pa.array(raw, pa.binary())], ["part", "at", "doc_id", "source", "n", "ids"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"))
    return slim.mapInArrow(encode_all, f"part int, at bigint, doc_id {kind}, source string, n bigint, ids binary")


def pack(docs: DataFrame, tokenizer: str, end_id: int | None, window: int = 2048, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_ids: bool = True) -> DataFrame:
    """Pieces: doc_id, source, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset, and its ids (``with_ids``)."""
    spark = docs.sparkSession
    encoded = common.stage(tokenize(docs, tokenizer, end_id, id_col, text_col, source_col), "packing-ids")
    by_part = encoded.groupBy("source", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = common.stage(by_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "packing-bases")
    totals = sorted((r.source, r.n) for r in bases.groupBy("source").agg(F.sum("n").alias("n")).collect())  # one row a source
    queues = {s: i for i, (s, _) in enumerate(totals)}
    shares = None if weights is None else np.array([float(weights.get(s, 0.0)) for s, _ in totals])
    plan = spark.sparkContext.broadcast((queues, schedule(np.array([n for _, n in totals], "i8"), window, shares)))
    width = tokens.id_width(tokenizer)

    def cut(batches):
        queues, levels = plan.value
        for batch in common.slices(batches, "ids"):
            cols = {k: batch.column(k).to_pylist() for k in ("source", "at", "base", "n", "ids")}
            rows, parts = [], []
            crc, raws = [], []
            for i, (source, at, base, n, raw) in enumerate(zip(*cols.values(), strict=True)):
                a = at + base
                start, length, sequence, offset = pieces_of(levels, queues[source], a, a + n)
                wide = memoryview(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())
                for s, k in zip((start - a).tolist(), length.tolist(), strict=True):
                    piece = wide[4 * s : 4 * (s + k)]
                    crc.append(zlib.crc32(piece))
                    if with_ids:
                        raws.append(np.frombuffer(piece, "<u4").tolist())
                parts.append((start - a, length, sequence, offset))
                rows.append(np.full(len(start), i))
            start, length, sequence, offset = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, "i8")] * 4
            row = pa.array(np.concatenate(rows) if rows else np.zeros(0, "i8"))
            arrays = [batch.column("doc_id").take(row), batch.column("source").take(row), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), batch.column("n").take(row), pa.array(sequence), pa.array(offset)]
            if with_ids:
                arrays.append(pa.array(raws, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(arrays)])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    placed = encoded.join(bases.select("source", "part", "base"), ["source", "part"])  # Spark broadcasts it if small, else shuffles
    return placed.mapInArrow(cut, f"doc_id {kind}, source string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<bigint>" * with_ids)


def sequences(pieces: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """The packed sequences (sequence_id, ids) of pieces with ids, padded to ``window`` unless their length is a power of two. A sequence is at most ``window`` pieces."""
    joined = pieces.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    size = F.size("ids")
    power = F.bit_count(size) == 1
    return joined.select("sequence_id", F.when(power, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id).cast("bigint"), F.greatest(F.lit(window) - size, F.lit(0))))).alias("ids"))
