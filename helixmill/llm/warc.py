"""WARC archives: a writer with revisit records and a splittable reader.

Writing: a row becomes one record, a gzip member of its own. Of rows with equal payloads (by SHA-1, of at least ``min_bytes`` bytes) the row with the largest key is a response and the others are revisits of it, which hold the HTTP header alone. Payloads that occur once, and the few that make up much of the table, stay where they are read; only others are shuffled to meet their group. Tasks write whole files under names of their own attempt; the manifest table lists those that count.

Reading: files are cut into byte ranges. A task looks in its range for gzip's magic bytes, takes a place for a member only if it inflates to a WARC record whose header can be decoded, and owns the records that start inside its range; the last one may end beyond it. After a record the next one starts where its member ends, so only the first of a range is looked for.

Defined cases: a null payload is an empty one; a null key or URL is left out of the header and read back as null; rows that repeat the winning key and payload are all responses; revisits of payloads whose keys are all null don't occur (all are responses). Bytes that are no member, or none of a WARC record, are passed over. Empty tables give an archive without files. Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm import common

MAGIC, SPLIT_BYTES, CHUNK = b"\x1f\x8b\x08", 32_000_000, 1 << 18
#: Most bytes of a record's header that are inflated to judge a place.
HEADER_BYTES = 1 << 16
_SPACE = uuid.UUID("00000000-0000-0000-0000-000000000000")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324  the format asks for it


def record_id(key, found: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{key}/{found}')}>"


def _clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(key: int | None, url: str | None, payload: bytes, original: int | None, date: str) -> bytes:
    """A gzip member with the response record of a payload, or (original: the key revisited) its revisit record."""
    found = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if original is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: {record_id(key, found)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{found}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if key is not None:
        lines.append(f"X-Row-Key: {key}")
    if original is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(original, found)}", f"X-Refers-To-Row-Key: {original}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def write_archive(pages: DataFrame, path: str, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write all rows under ``path``; returns the manifest (file, bytes, n_records), itself a table there."""
    payload = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(key_col).cast("bigint").alias("key"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    again = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.max("key").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null")
    marked = common.join_repeated(rows, common.stage(again, "repeated"), "sha").select("key", "url", "payload", F.when(F.col("last") != F.coalesce("key", F.col("last") - 1), F.col("last")).alias("original"))

    def write(batches):
        n = 0

        def members():
            nonlocal n
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    n += 1
                    yield record(*row, date)

        name = f"{path}/archive/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        size = common.write_whole(name, members())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["file", "bytes", "n_records"])

    return common.stage(marked.mapInArrow(write, "file string, bytes bigint, n_records bigint"), "manifest", f"{path}/manifest")


def _inflate(f, at: int, most: int | None = None) -> tuple[bytes, int] | None:
    """(what the member at ``at`` holds, where it ends); with ``most``, only about that much, and the end is not known."""
    f.seek(at)
    unpacker, out, size, read = zlib.decompressobj(31), [], 0, at
    while not unpacker.eof:
        chunk = f.read(CHUNK)
        if not chunk:
            return None  # cut short
        read += len(chunk)
        try:
            out.append(unpacker.decompress(chunk, most or 0))
        except zlib.error:
            return None
        size += len(out[-1])
        if most and size >= most:
            break
    return b"".join(out), read - len(unpacker.unused_data)


def _header(raw: bytes) -> tuple[dict[str, str], int] | None:
    """(fields in lower case, where the block begins) of a record, if it is one."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/1.") or end < 0:
        return None
    try:
        lines = raw[:end].decode().split("\r\n")[1:]
    except UnicodeDecodeError:
        return None
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    return (fields, end + 4) if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


def members(f, start: int, end: int):
    """(offset, record) of the records that start in [start, end) of an open file."""
    at, known = start, start == 0
    while at < end:
        if not known:
            at = _magic(f, at, end)
            if at is None:
                return
            probe = _inflate(f, at, HEADER_BYTES)
            if probe is None or _header(probe[0]) is None:
                at += 1
                continue
        got = _inflate(f, at)
        if got is None or _header(got[0]) is None:
            at, known = at + 1, False
            continue
        yield at, got[0]
        at, known = got[1], True


def _magic(f, at: int, end: int) -> int | None:
    """The first magic bytes that begin in [at, end)."""
    while at < end:
        f.seek(at)
        block = f.read(min(CHUNK, end - at) + len(MAGIC) - 1)
        found = block.find(MAGIC)
        if 0 <= found < end - at:
            return at + found
        at += max(1, min(CHUNK, end - at))
    return None


def parse(raw: bytes) -> dict:
    """A record's columns."""
    fields, at = _header(raw)
    block = raw[at : at + int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next((int(v) for n, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if n.strip().lower() == b"content-length"), len(payload))
    revisit = fields["warc-type"] == "revisit"
    number = lambda x: int(x) if x is not None else None
    return {
        "key": number(fields.get("x-row-key")), "url": fields.get("warc-target-uri"), "record_id": fields.get("warc-record-id"), "record_type": fields["warc-type"],
        "refers_to": number(fields.get("x-refers-to-row-key")), "payload_bytes": stated if revisit else len(payload),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else digest(payload), "payload": None if revisit else payload,
    }


def read_archive(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """Per record: key, url, record_id, record_type, refers_to (key), payload_bytes, payload_digest, offset, file and its payload (null for revisits)."""
    kinds = {"key": pa.int64(), "url": pa.string(), "record_id": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "offset": pa.int64(), "file": pa.string()} | ({"payload": pa.binary()} if with_payload else {})
    names = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}

    def read(batches):
        for batch in batches:
            for name, start, end in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                system, at = common.file_system(name)
                rows, size = [], 0
                with system.open_input_file(at) as f:
                    for offset, raw in members(f, start, end):
                        rows.append(parse(raw) | {"offset": offset, "file": name})
                        size += len(raw)
                        if size > 16_000_000 or len(rows) >= 5_000:
                            yield pack(rows)
                            rows, size = [], 0
                if rows:
                    yield pack(rows)

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in kinds.items()], list(kinds))

    ranges = manifest.where("bytes > 0").select("file", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split_bytes).cast("bigint"))).alias("start"), "bytes")
    ranges = ranges.select("file", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    spread = ranges.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "file", "start")
    return spread.mapInArrow(read, ", ".join(f"{k} {names[v]}" for k, v in kinds.items()))
