"""Joining and checking of input tables: alias correction, lookups, probe sets, and the assembly of a count table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.operators import expression


def correct_names(names: DataFrame, aliases: DataFrame, rounds: int = 16) -> DataFrame:
    """``names`` (feature) with ``corrected``: alias rows (ord, aliases array) apply in the order of ``ord``, each turning any of its aliases into its last non-empty one; a name may so change several times.

    A round follows every name to the next later row that renames it. Names that no row renames stay. More chained renames than ``rounds`` are an error, not a wrong name.
    """
    full = aliases.select("ord", F.filter("aliases", lambda a: a != "").alias("aliases")).where(F.size("aliases") > 0)
    steps = full.select("ord", F.explode(F.array_distinct("aliases")).alias("alias"), F.element_at("aliases", -1).alias("to")).where("alias <> to")
    now = names.select("feature").distinct().withColumns({"corrected": F.col("feature"), "at": F.lit(-1).cast("bigint")})
    for _ in range(rounds):
        later = now.join(steps, (F.col("corrected") == F.col("alias")) & (F.col("ord") > F.col("at")), "left")
        now = later.groupBy("feature", "corrected", "at").agg(F.min(F.struct("ord", "to")).alias("s")).select("feature", F.when(F.col("s.ord").isNotNull(), F.col("s.to")).otherwise(F.col("corrected")).alias("corrected"), F.coalesce("s.ord", "at").alias("at"))
        if now.join(steps, (F.col("corrected") == F.col("alias")) & (F.col("ord") > F.col("at")), "left_semi").isEmpty():
            return names.join(now.select("feature", "corrected"), "feature", "left")
    raise ValueError(f"names change more than {rounds} times")


def first_match(left: DataFrame, lookup: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``left`` with the lookup's ``value`` for its ``key``: of several matches the one first by ``order``; null without one."""
    one = lookup.groupBy(key).agg(F.min_by(value, order).alias(value))
    return left.join(one, key, "left")


def probe_sets(long: DataFrame, file: str, probe: str) -> DataFrame:
    """Per file: its number of probes, and whether it holds every probe that any file holds."""
    pairs = long.select(file, probe).distinct()
    total = pairs.agg(F.count_distinct(probe).alias("total"))
    return pairs.groupBy(file).agg(F.count("*").alias("n_probes")).crossJoin(F.broadcast(total)).select(file, "n_probes", (F.col("n_probes") == F.col("total")).alias("complete"))


def assemble(counts: DataFrame, missing: float = 0.1, increment: float = 0.001) -> DataFrame:
    """(sample_id, feature, value, cpm, log10tpm): features with fewer missing counts than the share ``missing`` are kept, gaps filled by the feature's median, counts turned to log10 TPM, and features without variance dropped (none, if all vary)."""
    filled = expression.impute(counts, "median", missing)
    tpm = expression.log10_tpm(filled, increment)
    varying = tpm.groupBy("feature").agg(F.var_samp("log10tpm").alias("v")).where("v > 0").select("feature")
    return tpm.join(varying, "feature", "left_semi")


def feature_votes(ranked: DataFrame, sizes: range) -> DataFrame:
    """(size, feature, votes): over runs (run, rank, feature), how often a feature is among the first ``size``, and of these the ``size`` most voted, ties to the smaller name."""
    of = ranked.select("feature", "rank", F.explode(F.sequence(F.lit(sizes[0]), F.lit(sizes[-1]))).alias("size")).where(F.col("rank") <= F.col("size"))
    votes = of.groupBy("size", "feature").agg(F.count("*").alias("votes"))
    return votes.withColumn("_r", F.row_number().over(Window.partitionBy("size").orderBy(F.desc("votes"), "feature"))).where("_r <= size").drop("_r")
