"""Case/control tables in long form (sample_id, class, feature, value) from the driver's tables, and readers for delimited files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.stats import make_names


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding is a sample, each of its components a feature; label 0 is the case."""
    long = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.when(F.col("label") == 0, "Case").otherwise("Control").alias("class"), F.posexplode("embedding").alias("i", "x"))
    return long.select("sample_id", "class", F.concat(F.lit("hsa.f"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("feature"), F.col("x").cast("double").alias("value"))


def telling_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature matrix with every fifth feature moved for cases, by one to four steps of 0.05, so that selectors have something to find."""
    i = F.substring("feature", 6, 2).cast("int")
    moved = F.when((F.col("class") == "Case") & (i % 5 == 0), 0.05 * (1 + i % 4)).otherwise(0.0)
    return feature_matrix(spark, sf_dir).withColumn("value", F.col("value") + moved)


def count_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by supplier (sample) and brand (feature)."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))  # before the joins: fewer rows to shuffle
    joined = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("l_suppkey").alias("sample_id"), F.col("p_brand").alias("feature")).agg(F.sum("n").alias("value"))


def missing_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature matrix with one value in eleven missing."""
    i = F.substring("feature", 6, 2).cast("bigint")
    return feature_matrix(spark, sf_dir).withColumn("value", F.when((F.col("sample_id") * 31 + i * 17) % 11 != 0, F.col("value")))


def benchmark_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by signature (method), algorithm, split and metric: means over orders, from 0.5 to 1."""
    o = table(spark, sf_dir, "orders")
    kinds = o.select(F.concat(F.lit("sig"), (F.col("o_custkey") % 12).cast("string")).alias("method"), F.element_at(F.array(*[F.lit(x) for x in ("rf", "mlp", "svm", "tree")]), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("algorithm"), F.element_at(F.array(*[F.lit(x) for x in ("train", "test", "valid")]), (F.col("o_custkey") % 3 + 1).cast("int")).alias("s"), (F.col("o_orderkey") % 97).alias("v"))
    split = F.explode(F.array(*[F.lit(x) for x in ("train", "test", "valid")]))
    metric = F.explode(F.array(*[F.lit(x) for x in ("Accuracy", "Sensitivity", "Specificity")]))
    base = kinds.groupBy("method", "algorithm").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    long = base.select("*", split.alias("split")).select("*", metric.alias("metric"))
    value = 0.5 + ((F.col("v") * F.length("split") + F.col("n") * F.length("metric")) % 500) / 1000.0
    return long.select("method", "algorithm", "split", "metric", value.alias("value"))


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A headed file with syntactic, unique column names; empty fields are null."""
    df = spark.read.option("header", True).option("inferSchema", True).option("nullValue", "").option("sep", sep).csv(path)
    return df.toDF(*unique_names(df.columns))


def unique_names(names: list[str]) -> list[str]:
    """The names as ``make_names`` has them, repeated ones with .1, .2 and so on."""
    out: list[str] = []
    for name in names:
        clean = re.sub(r"[^A-Za-z0-9._]", ".", name)
        clean = clean if re.match(r"[A-Za-z]|\.([^0-9]|$)", clean) else "X" + clean
        k, tried = 0, clean
        while tried in out:
            k += 1
            tried = f"{clean}.{k}"
        out.append(tried)
    return out


def wide_to_long(wide: DataFrame, id_col: str, class_col: str, prefix: str = "hsa") -> DataFrame:
    """Feature columns (by prefix) as rows; a missing or non-numeric feature block is an error."""
    features = [c for c in wide.columns if c.startswith(prefix)]
    if not features:
        raise ValueError(f"no column begins with {prefix}")
    if bad := [c for c, t in wide.dtypes if c in features and t not in ("double", "float", "int", "bigint", "smallint", "tinyint") and not t.startswith("decimal")]:
        raise ValueError(f"features that are not numeric: {bad}")
    cast = wide.select(F.col(id_col).alias("sample_id"), F.col(class_col).alias("class"), *[F.col(f"`{c}`").cast("double").alias(c) for c in features])
    return cast.unpivot(["sample_id", "class"], [f"`{c}`" for c in features], "feature", "value")


__all__ = ["benchmark_long", "count_matrix", "feature_matrix", "make_names", "missing_matrix", "read_delimited", "table", "unique_names", "wide_to_long"]
