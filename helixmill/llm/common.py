"""Helpers that the operators of this subpackage share: the shared folder, stage tables, files outside Spark's writers, what a Python worker keeps, and columns worked out from texts."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT = "spark.checkpoint.dir"
#: Bytes of a column's values that are turned into Python objects at a time.
SLICE_BYTES = 4_000_000
#: Rows of a broadcast bitmap (of 64 bits each); a key with more than one in HOT of all rows is hot.
SLOTS, HOT = 1 << 20, 1_000
#: Places, of a byte each, that tell whether a worker's cache has met a key before.
MET = 1 << 21
_STAGES: list[str] = []
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where the session has none and runs on one machine (tests) a temporary folder is made; a cluster has to name one.
    """
    found = spark.conf.get(CHECKPOINT, None) or _OWN.get(spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT} names no folder that driver and executors share")
        found = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString().rstrip("/")  # a bare path means the cluster's default file system


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    _STAGES.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_until_end(path: str) -> None:
    """Let ``scratch`` remove ``path`` with the stage tables."""
    _STAGES.append(path)


@contextmanager
def scratch(spark: SparkSession):
    """Removes at the end the stage tables that were written inside. For callers who have used up or written what operators returned inside, as those results still read them."""
    begin = len(_STAGES)
    try:
        yield
    finally:
        remove(spark, *_STAGES[begin:])


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete stage tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        with suppress(Exception):  # left files cost disk, nothing else
            p.getFileSystem(conf).delete(p, True)
        with suppress(ValueError):
            _STAGES.remove(path)


def possible(rows: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: whether their long ``key`` may be in ``keys``; true for all that are and few others. What is broadcast is a bitmap of 64 ``SLOTS`` bits, a table of at most ``SLOTS`` rows however large ``keys`` is; the fuller it is, the more other rows are possible."""
    slot = F.col(key).bitwiseAND(F.lit(SLOTS - 1))
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({key}, 20) & 63 as int))")
    bitmap = keys.groupBy(slot.alias("_slot")).agg(F.bit_or(bit).alias("_bits"))
    found = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return rows.withColumn("_slot", slot).join(F.broadcast(bitmap), "_slot", "left").withColumn(name, found).drop("_slot", "_bits")


def among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` whose long ``key`` may be in ``keys``."""
    return possible(rows, keys, key, "_among").where("_among").drop("_among")


def join_repeated(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """``rows`` left join ``groups``, a written table with one row a key and its number of rows, ``n``.

    Keys with more than one in ``HOT`` of the grouped rows, fewer than ``HOT`` keys, are broadcast; rows of other keys meet theirs in a shuffle, which null keys and most keys without a group stay out of.
    """
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot, cold = (groups.where(x).drop("n") for x in (F.col("n") * HOT > total, F.col("n") * HOT <= total))
    first = rows.withColumn("_hash", F.xxhash64(key)).join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    told = possible(first, cold.select(F.xxhash64(key).alias("_hash")), "_hash", "_cold").withColumn("_cold", F.col("_cold") & F.col("_hot").isNull() & F.col(key).isNotNull())
    direct = told.where("not _cold")
    shuffled = told.where("_cold").drop(*(x for x in groups.columns if x not in (key, "n"))).join(cold, key, "left")
    return direct.unionByName(shuffled).drop("_hash", "_hot", "_cold")


def local_path(path: str) -> str | None:
    """The path for ``open`` if ``path`` is on a mounted file system, else None."""
    if path.startswith("file:"):
        return "/" + path[len("file:"):].lstrip("/")
    return None if "://" in path else path


def file_system(path: str):
    """pyarrow's file system for a path or URI, and the path in it."""
    from pyarrow import fs

    local = local_path(path)
    if local is not None:
        return fs.LocalFileSystem(), local
    return fs.FileSystem.from_uri(path)


def write_whole(path: str, chunks) -> int:
    """Write byte chunks under a name of this attempt, then rename: readers see a whole file or none. Returns the bytes written."""
    system, at = file_system(path)
    system.create_dir(os.path.dirname(at), recursive=True)
    temp, n = f"{at}.{uuid.uuid4().hex}.tmp", 0
    with system.open_output_stream(temp, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            n += len(chunk)
    system.move(temp, at)
    return n


class Cache(dict):
    """What a worker keeps of costly values, up to about ``limit`` bytes; a full cache is emptied and starts with its seed again. ``of(key)`` gives a value and its cost in bytes (None: not to be kept). A value is kept from the second time on that it is asked for, by a table of the keys' hashes: most keys come once, and would only fill the cache."""

    def __init__(self, limit: int, seed: dict | None = None):
        super().__init__(seed or {})
        self.limit, self.seed, self.held, self.met = limit, seed or {}, 0, bytearray(MET)

    def of(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        value, cost = self.of(key)
        if cost is None:
            return value
        at = hash(key) % MET
        if not self.met[at]:
            self.met[at] = 1
            return value
        if self.held > self.limit:
            self.clear()
            self.update(self.seed)
            self.held, self.met = 0, bytearray(MET)
        self.held += cost
        self[key] = value
        return value


_STATE: dict = {}


def worker_state(key, make):
    """The worker's state of one operator. That of another one is given up first, so that a worker that lives through many operators holds one's at a time."""
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = make()
    return _STATE[key]


def slices(batches, column: int | str, most: int = SLICE_BYTES):
    """The record batches in slices whose strings or binaries of ``column`` have about ``most`` bytes, or one row."""
    for batch in batches:
        n, at = batch.num_rows, 0
        while at < n:
            rows = n - at
            while rows > 1 and batch.column(column).slice(at, rows).nbytes > most:
                rows = -(-rows // 2)
            yield batch.slice(at, rows)
            at += rows
        if not n:
            yield batch


def apart(keep: tuple[str, ...], outputs) -> list[str]:
    """Names for kept columns that clash neither with outputs nor with each other, in any case: ``<name>_kept`` where they would."""
    taken, names = {x.lower() for x in outputs}, []
    for name in keep:
        while name.lower() in taken:
            name += "_kept"
        taken.add(name.lower())
        names.append(name)
    return names


def text_columns(docs: DataFrame, text_col: str, keep: tuple[str, ...], outputs: dict[str, tuple[str, pa.DataType]], of, most: int = SLICE_BYTES) -> DataFrame:
    """Per row the columns of ``keep`` and those of ``outputs`` (name to Spark's and Arrow's type), which ``of()``, called once a task, works out: a function from texts (slices of about ``most`` bytes, or one text) to a list of values for each output.

    Kept columns are named by ``apart``. The text crosses to Python once, and back only if it is kept.
    """
    names = apart(keep, outputs)
    lower = [x.lower() for x in keep]
    at = lower.index(text_col.lower()) if text_col.lower() in lower else len(keep)
    slim = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], *([F.col(text_col).alias("text")] if at == len(keep) else []))
    kinds = [kind for _, kind in outputs.values()]

    def run(batches):
        worker_state(tuple(outputs), dict)  # gives up what other operators keep
        work = of()
        for batch in slices(batches, at, most):
            found = work(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(x, kind) for x, kind in zip(found, kinds, strict=True))], [*(f"c{i}" for i in range(len(names))), *outputs])

    ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[: len(names)]), *(f"{k} {kind}" for k, (kind, _) in outputs.items())])
    out = slim.mapInArrow(run, ddl)
    return out.toDF(*names, *outputs)
