"""Token ids in flat binary files.

A set of files has one pair per partition, in ascending order of id across the set:

* ``<name>.bin``: the ids of its documents, one after another, unsigned little-endian, 2 bytes each where the vocabulary allows, else 4;
* ``<name>.idx``: ``MAGIC``, then unsigned 64-bit little-endian: version, bytes of an id, number of documents n; then n + 1 offsets (64 bits, in ids, from 0), n document ids (signed 64 bits), and n bytes that are 1 where the document id is null.

The manifest table names the files that count, with each one's number of documents and ids, and ``base``: the ids of all files before it, a prefix sum. Files that a failed or repeated attempt left are in no manifest. Readers map the files into memory.

Defined cases: a null text is an empty one and gives the end id alone; null document ids come first; repeated ids stand in order of their texts; an empty table gives an empty manifest. Only the id and text columns are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm import common, tokens

MAGIC = b"HXTOKENS"
HEAD = "<8sQQQ"


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int | None, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every document under ``path``; returns the manifest (part, file, n_docs, n_ids, base), itself a table there."""

    def write(batches):
        encode, width = tokens.encoder(tokenizer), tokens.id_width(tokenizer)
        end = b"" if end_id is None else int(end_id).to_bytes(width, "little")
        ids: list[int | None] = []
        ends: list[int] = []

        def bodies():
            at = 0
            for batch in common.slices(batches, 1):
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    raw = encode(text or "") + end
                    at += len(raw) // width
                    ids.append(key)
                    ends.append(at)
                    yield raw

        part = TaskContext.get().partitionId()
        name = f"{path}/ids/{part:06d}-{uuid.uuid4().hex}"
        common.write_whole(f"{name}.bin", bodies())
        index = [struct.pack(HEAD, MAGIC, 1, width, len(ids)), np.array([0, *ends], "<u8").tobytes(), np.array([x or 0 for x in ids], "<i8").tobytes(), np.array([x is None for x in ids], "u1").tobytes()]
        common.write_whole(f"{name}.idx", index)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(ids)], pa.int64()), pa.array([ends[-1]], pa.int64())], ["part", "file", "n_docs", "n_ids"])

    ordered = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")
    written = common.stage(ordered.mapInArrow(write, "part int, file string, n_docs bigint, n_ids bigint"), "manifest", f"{path}/written")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return common.stage(written.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "manifest", f"{path}/manifest")


def open_index(name: str):
    """(bytes of an id, offsets, document ids, nulls) of a file pair, mapped."""
    raw = mapped(f"{name}.idx")
    magic, version, width, n = struct.unpack(HEAD, raw[: struct.calcsize(HEAD)].tobytes())
    if magic != MAGIC or version != 1:
        raise ValueError(f"{name}.idx is no index of token files")
    at = struct.calcsize(HEAD)
    offsets = raw[at : at + 8 * (n + 1)].view("<u8")
    at += 8 * (n + 1)
    return width, offsets, raw[at : at + 8 * n].view("<i8"), raw[at + 8 * n : at + 9 * n]


def mapped(path: str) -> np.ndarray:
    """A file's bytes; mapped into memory where the file system is mounted."""
    system, at = common.file_system(path)
    if common.local_path(path) is not None:
        return np.memmap(at, "u1", "r") if system.get_file_info(at).size else np.zeros(0, "u1")
    with system.open_input_file(at) as f:
        return np.frombuffer(f.read(), "u1")


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, start (ids before it in the set), n_tokens, ids_crc32 (of the ids as unsigned 32-bit), and its ids."""

    def read(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                width, offsets, keys, nulls = open_index(name)
                body = mapped(f"{name}.bin").view(f"<u{width}")
                for lo in range(0, len(keys), 1024):
                    hi = min(lo + 1024, len(keys))
                    cuts = [body[offsets[i] : offsets[i + 1]].astype("<u4") for i in range(lo, hi)]
                    columns = [
                        pa.array(keys[lo:hi].tolist(), pa.int64(), mask=nulls[lo:hi].astype(bool)),
                        pa.array((offsets[lo:hi].astype("i8") + base).tolist(), pa.int64()),
                        pa.array([len(x) for x in cuts], pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for x in cuts], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([x.tolist() for x in cuts], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    spread = manifest.select("file", "base").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "file")
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)
