"""Sharding by balanced label propagation, in DataFrame operations only.

Rows with the same ``link`` key are linked with each other. Law ``rows``: every shard holds a like number of rows, at most one apart.

1. Rows get an exactly even start: their rank (in hashed buckets, with a prefix sum over buckets) modulo the number of shards.
2. Linked rows of a group that share a shard are interchangeable, so labels are propagated on cells (group, shard, rows): at most one per group and shard, however large a group is.
3. Each round a group is drawn to the shard with most of its rows, among those with more than slight room if it has any, and its other cells move there; only those of a group larger than a shard stay in shards that are full. From one shard to another go as many rows as come back, and more while there is room: whole cells in hashed order, by prefix sums, and a part of the last. So no shard is ever over capacity.
4. After the rounds linked rows take their group's places in order of rank (ranks in salted parts of a group, with prefix sums), and rows without links fill what is left, again by rank.

Cut links are pairs of linked rows in two shards; a group larger than a shard is cut, by as few shards as its rounds allow.

Defined cases: null link keys link nothing; repeated rows are rows like others; null ids are ranked too; an empty table gives an empty result. Only the named columns are read. Rounds end when nothing moves. The driver holds one number a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm import common

BUCKETS, PARTS, ROUNDS = 1_024, 64, 12


def global_rank(rows: DataFrame, name: str, by: list[str] | None = None, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """Add the rank from 0 of each row (within ``by``) in column ``name``: ranks in hashed buckets, plus the rows of earlier buckets."""
    by = by or []
    hashed = rows.withColumn("_b", F.pmod(F.xxhash64("id", F.lit(name)), F.lit(BUCKETS if not by else BUCKETS // 4)).cast("int"))
    sizes = hashed.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # a row a bucket
    within = Window.partitionBy(*by, "_b").orderBy(*order)
    ranked = hashed.withColumn("_r", F.row_number().over(within) - 1)
    return ranked.join(F.broadcast(bases), [*by, "_b"]).withColumn(name, (F.col("_r") + F.col("_base")).cast("bigint")).drop("_b", "_r", "_base")


def propagate(cells: DataFrame, capacity: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Cells (g, s, n) after at most ``rounds`` rounds; ``capacity`` is each shard's."""
    spark = cells.sparkSession
    limits = spark.createDataFrame(list(enumerate(capacity)), "s int, cap bigint")  # a row a shard
    path = common.new_path(spark, "cells")
    now = common.stage(cells, "cells", path)
    for i in range(rounds):
        load = now.groupBy("s").agg(F.sum("n").alias("load"))
        room = limits.join(F.broadcast(load), "s", "left").select("s", "cap", (F.col("cap") - F.coalesce("load", F.lit(0))).alias("room"))
        # a shard with next to no room would hold up its groups: it is a target only of groups that have no other
        seen = now.join(F.broadcast(room.withColumn("open", F.col("room") > F.col("cap") / 32)), "s")
        target = seen.groupBy("g").agg(F.sum("n").alias("size"), F.max(F.struct("open", "n", F.xxhash64("g", "s", F.lit(i)).alias("tie"), F.col("s").alias("t"), "cap")).alias("to")).select("g", "size", F.col("to.t").alias("t"), F.col("to.cap").alias("most"))
        movers = seen.join(target, "g").where("s <> t and (open or size <= most)").select("g", "s", "t", "n", F.pmod(F.xxhash64("g", "s"), F.lit(BUCKETS // 4)).cast("int").alias("_b"))
        sizes = common.stage(movers.groupBy("s", "t", "_b").agg(F.sum("n").alias("n")), "wanted", wanted_path := common.new_path(spark, "wanted"))
        # rows admitted from s to t: what both exchange, and a part of t's room; at most a row for two shards
        flows = sizes.groupBy("s", "t").agg(F.sum("n").alias("wanted"))
        back = flows.select(F.col("s").alias("t"), F.col("t").alias("s"), F.col("wanted").alias("back"))
        earlier = Window.partitionBy("t").orderBy(F.xxhash64("s", "t"), "s").rowsBetween(Window.unboundedPreceding, -1)
        flows = flows.join(back, ["s", "t"], "left").withColumn("swap", F.least("wanted", F.coalesce("back", F.lit(0)))).withColumn("rest", F.col("wanted") - F.col("swap"))
        flows = flows.join(room.select(F.col("s").alias("t"), "room"), "t").withColumn("left", F.greatest(F.col("room") - F.coalesce(F.sum("rest").over(earlier), F.lit(0)), F.lit(0)))
        admitted = flows.select("s", "t", (F.col("swap") + F.least("rest", "left")).alias("admitted"))
        # whole cells in hashed order while they fit, and a part of the last
        before = Window.partitionBy("s", "t").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        bases = sizes.select("s", "t", "_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).join(F.broadcast(admitted), ["s", "t"])  # a row for two shards and a bucket
        within = Window.partitionBy("s", "t", "_b").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
        placed = movers.withColumn("_p", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(bases), ["s", "t", "_b"])
        k = F.least("n", F.col("admitted") - F.col("base") - F.col("_p"))
        moves = placed.select("g", "s", "t", k.alias("k")).where("k > 0")
        step_path = common.new_path(spark, "moves")
        step = common.stage(moves, "moves", step_path)
        if not step.limit(1).count():
            common.remove(spark, step_path, wanted_path)
            break
        delta = step.select("g", "s", (-F.col("k")).alias("n")).union(step.select("g", F.col("t").alias("s"), F.col("k").alias("n")))
        new_path = common.new_path(spark, "cells")
        new = common.stage(now.union(delta).groupBy("g", "s").agg(F.sum("n").alias("n")).where("n > 0"), "cells", new_path)
        common.remove(spark, path, step_path, wanted_path)
        now, path = new, new_path
    return now


def shard_rows(rows: DataFrame, shards: int, id_col: str = "id", link_col: str = "link", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: its id, the columns of ``keep``, shard (0 to ``shards`` - 1), slot (gapless from 0 in its shard) and law."""
    spark = rows.sparkSession
    names = {f"k{i}": c for i, c in enumerate(keep)}
    base = rows.select(F.col(id_col).alias("id"), F.col(link_col).alias("g"), *[F.col(c).alias(k) for k, c in names.items()])
    base = common.stage(global_rank(base, "start"), "shard-rows")
    groups = common.stage(base.where("g is not null").groupBy("g").agg(F.count("*").alias("n")).where("n > 1").withColumn("linked", F.lit(True)), "groups")
    base = common.stage(common.join_repeated(base, groups, "g"), "shard-linked")
    total = base.count()
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    first = base.where("linked")
    cells = propagate(first.groupBy("g", F.pmod("start", F.lit(shards)).cast("int").alias("s")).agg(F.count("*").alias("n")), capacity)

    # places of a group in order of shard: [from, to)
    upto = Window.partitionBy("g").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    places = cells.select("g", F.struct(F.sum("n").over(upto).alias("to"), "s").alias("c")).groupBy("g").agg(F.sort_array(F.collect_list("c")).alias("cells"))  # at most ``shards`` a group
    parted = base.where("linked").withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), F.lit(PARTS)).cast("int"))
    sizes = parted.groupBy("g", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = common.stage(sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).join(places, "g").select("g", "part", "base", "cells"), "places")
    within = Window.partitionBy("g", "part").orderBy("start")
    at = F.row_number().over(within) - 1
    linked = parted.withColumn("r", at).join(starts, ["g", "part"])
    position = F.col("r") + F.col("base")
    linked = linked.withColumn("shard", F.filter("cells", lambda c: c["to"] > position)[0]["s"]).select("id", *names, "shard")

    # what is left of each shard, as bounds over the ranks of the other rows
    held = {r.s: r.n for r in cells.groupBy("s").agg(F.sum("n").alias("n")).collect()}  # a row a shard
    bounds, done = [], 0
    for s in range(shards):
        done += capacity[s] - held.get(s, 0)
        bounds.append(done)
    single = global_rank(base.where("linked is null"), "at")
    place = F.lit(0)
    for b in bounds[:-1]:
        place = place + (F.col("at") >= b).cast("int")
    single = single.select("id", *names, place.alias("shard"))
    both = common.stage(linked.unionByName(single), "sharded")
    out = global_rank(both, "slot", ["shard"])
    return out.select(F.col("id").alias(id_col), *[F.col(k).alias(c) for k, c in names.items()], "shard", "slot", F.lit("rows").alias("law"))
