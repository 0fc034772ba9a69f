"""Writing tables as files and reading them back: splits with their checks, results that grow by cells, formulas, and exports.

Writers are idempotent: a repeated write replaces what it wrote before, and ``put_cells`` replaces whole cells (partitions) only. Files are Spark's part files in a folder, so a table of any size is written by all tasks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.sources.fixtures import read_delimited

MIXES = ("train", "test", "valid")
_OWN: dict[str, str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses, in the folder that driver and executors share; on one machine without one, in a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        shared = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-stores-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet to ``path`` and read again, with its schema."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders that no later plan reads."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    """A delimited table with a header; nulls are empty fields."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("nullValue", "").option("emptyValue", '""').csv(path)


def read_table(spark: SparkSession, path: str, schema, sep: str = ",") -> DataFrame:
    """A table of ``write_table`` with its schema, columns by name."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("sep", sep).option("nullValue", "").option("emptyValue", '""').csv(path)


def read_folder(spark: SparkSession, paths: list[str], sep: str = ",", tag: str = "file") -> DataFrame:
    """The union of several tables whose columns may differ (null where one lacks a column), each with its place in ``paths`` as ``tag``."""
    out = None
    for i, path in enumerate(paths):
        one = read_delimited(spark, path, sep).withColumn(tag, F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def scan_or_compute(spark: SparkSession, path: str, make) -> DataFrame:
    """The Parquet table at ``path``; if it is not there (whole), ``make()`` is written first."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def to_wide(long: DataFrame, features: list[str], keys: tuple[str, ...] = ("sample_id", "class")) -> DataFrame:
    """A column a feature, in the given order."""
    wide = long.groupBy(*keys).pivot("feature", features).agg(F.first("value"))
    return wide.select(*keys, *[F.col(f"`{f}`") for f in features])


def write_splits(wide: DataFrame, path: str, mix: str = "mix") -> None:
    """One folder a value of ``mix`` (train, test, valid, and balanced or merged ones)."""
    wide.write.mode("overwrite").partitionBy(mix).option("header", True).csv(path)


def read_splits(spark: SparkSession, path: str, schema, mix: str = "mix", labels: tuple[str, ...] = ("Case", "Control")) -> DataFrame:
    """The splits under ``path`` with their ``mix``, checked: train, test and valid have rows, and every one of them has just ``labels``."""
    found = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("basePath", path).csv(path)
    check_splits(found, mix, labels)
    return found


def check_splits(table: DataFrame, mix: str = "mix", labels: tuple[str, ...] = ("Case", "Control"), class_col: str = "class") -> None:
    """An error if train, test or valid is empty, or its labels are not just ``labels``. The driver sees a row a split."""
    seen = {r[mix]: set(r.found) for r in table.groupBy(mix).agg(F.collect_set(class_col).alias("found")).collect()}
    for name in MIXES:
        if name not in seen:
            raise ValueError(f"no rows in the {name} split")
        if seen[name] != set(labels):
            raise ValueError(f"labels of the {name} split are {sorted(seen[name])}, not {sorted(labels)}")


def without_split(long: DataFrame) -> DataFrame:
    """The whole table as train, test and valid alike."""
    return long.withColumn("mix", F.explode(F.array(*[F.lit(x) for x in MIXES])))


def put_cells(df: DataFrame, path: str, cells: tuple[str, ...]) -> None:
    """Add results to a table: the cells that ``df`` has are replaced as a whole, others stay; so a cell that is computed again counts once."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*cells).parquet(path)


def write_formulas(formulas: DataFrame, path: str) -> None:
    """One folder a method with its formula as text."""
    formulas.select("method", "formula").write.mode("overwrite").partitionBy("method").text(path)


def read_formulas(spark: SparkSession, path: str) -> DataFrame:
    """(method, formula) of ``write_formulas``."""
    return spark.read.option("basePath", path).text(path).select(F.col("method").cast("string").alias("method"), F.col("value").alias("formula"))
