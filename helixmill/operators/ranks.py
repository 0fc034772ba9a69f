"""Order statistics within groups of any size: values are dealt to buckets cut by quantiles, ranks and running sums are taken within buckets, and each bucket's start comes from the totals of those before it.

So no group is one task's, however many rows it holds. Cuts come from a bounded number of drawn values a group; equal values share a bucket, so rows should be aggregated to distinct values first where many may be equal, or ``tie`` given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, COMPILED = 32, 64
#: About so many values of a group are drawn for its cuts, and at least so many a bucket.
DRAWN, EACH = 2_048, 64


def in_buckets(rows: DataFrame, by: tuple[str, ...], value: str, buckets: int = BUCKETS, *, tie: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``_b``, the number of the group's quantile cuts below ``value``. Rows with a null group column go.

    Cuts are quantiles of values drawn by a hash of the value and ``tie``, which should tell rows of equal values apart if there are many. So they are the same each time a plan works them out, as ``running`` needs; a merged sketch depends on the order in which tasks end.
    """
    for name in by:
        rows = rows.where(F.col(name).isNotNull())
    if buckets == 1:
        return rows.withColumn("_b", F.lit(0))
    sizes = rows.groupBy(*by).agg(F.count(value).alias("_size"))
    place = F.xxhash64(value, *tie).bitwiseAND(F.lit(0x7FFFFFFF)).cast("double")
    drawn = rows.select(*by, F.col(value).alias("_drawn"), place.alias("_place")).join(sizes, list(by)).where(F.col("_place") * F.col("_size") < max(DRAWN, EACH * buckets) * float(1 << 31))
    each = drawn.groupBy(*by, "_drawn").agg(F.count("*").alias("_times"))
    cuts = each.groupBy(*by).agg(F.array_distinct(F.percentile("_drawn", [i / buckets for i in range(1, buckets)], F.col("_times"))).alias("_cuts"))
    told = rows.join(cuts, list(by), "left")  # few values, repeated often, may all be left undrawn
    if buckets <= COMPILED:  # comparisons that are compiled; a lambda is interpreted
        below = F.lit(0)
        for i in range(buckets - 1):
            below = below + F.coalesce((F.get("_cuts", F.lit(i)) < F.col(value)).cast("int"), F.lit(0))
    else:
        below = F.coalesce(F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c < F.col(value))), F.lit(0))
    return told.withColumn("_b", below).drop("_cuts")


def running(rows: DataFrame, by: tuple[str, ...], order: list[Column], **sums: Column) -> DataFrame:
    """``rows`` (with ``_b``) with the sum of each of ``sums`` from the group's first row in ``order`` to this one, and over the whole group as ``<name>_all``. ``order`` has to go on within what ``_b`` orders."""
    work = rows.withColumns({f"_v_{k}": v for k, v in sums.items()})
    totals = work.groupBy(*by, "_b").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a group and bucket
    bases = totals.select(*by, "_b", *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_t_{k}") for k in sums], *[F.sum(f"_t_{k}").over(Window.partitionBy(*by)).alias(f"{k}_all") for k in sums])
    within = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return work.join(bases, [*by, "_b"]).select(*rows.columns, *[(F.sum(f"_v_{k}").over(within) + F.col(f"_t_{k}")).alias(k) for k in sums], *[f"{k}_all" for k in sums])


def ranked(rows: DataFrame, by: tuple[str, ...], value: str, name: str, tie: tuple[str, ...] = (), buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with their rank, from 1, by ``value`` and then ``tie``; null values are left out."""
    dealt = in_buckets(rows.where(F.col(value).isNotNull()), by, value, buckets, tie=tie)
    return running(dealt, by, [F.col(value), *(F.col(t) for t in tie)], **{name: F.lit(1)}).drop("_b", f"{name}_all")


def medians(rows: DataFrame, by: tuple[str, ...], **values: Column) -> DataFrame:
    """by and the exact median of each of ``values`` (nulls left out; null where none is left). All are ranked in one pass, as (name, value) rows aggregated to distinct values."""
    listed = F.explode(F.array(*[F.struct(F.lit(k).alias("_k"), v.cast("double").alias("_v")) for k, v in values.items()]))
    each = rows.select(*by, listed.alias("_x")).select(*by, "_x._k", "_x._v").where("_v is not null").groupBy(*by, "_k", "_v").agg(F.count("*").alias("_n"))
    at = running(in_buckets(each, (*by, "_k"), "_v"), (*by, "_k"), [F.col("_v")], _upto=F.col("_n"))
    # the middle one, or the middle two
    low, high = F.floor((F.col("_upto_all") + 1) / 2), F.floor(F.col("_upto_all") / 2) + 1
    mid = at.where((F.col("_upto") >= low) & (F.col("_upto") - F.col("_n") < high))
    found = mid.groupBy(*by, "_k").agg(((F.min("_v") + F.max("_v")) / 2).alias("_m"))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_k") == k, F.col("_m"))).alias(k) for k in values])
