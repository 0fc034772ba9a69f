"""Approximate nearest neighbours: one vantage-point tree a shard.

Vectors are scaled to length 1; their chord distance is a metric that orders as the cosine does. Equal vectors are one point with its k + 1 smallest ids (found by ranks in salted groups), so that a vector with a third of all rows costs one point. Points are dealt to shards of about ``shard_points`` by hash; each task builds the trees of its shards (a vantage point, the median distance, inside and outside, down to leaves) and the trees are a written table.

A search visits a tree's inside or outside part only if the triangle inequality leaves room for a nearer point than the k-th found: the ball of radius r / ``factor`` must reach over the border. ``factor`` 1 is exact; larger ones prune more and may miss. A block of queries walks a tree together, so that a leaf is compared with all queries that come to it as one matrix product. Queries go in blocks of at most ``block_bytes``, each broadcast on its own; per query, each shard returns its k + 1 best points, of ties those with the smallest ids, so that a direction with many vectors (multiples of one) gives no more, and the best are chosen by the cosine of the original vectors, summed in double precision in order of components, ties to the smaller id.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, as queries or candidates; vectors of unlike dimension are never neighbours; a query with no candidate gives no row; rows that repeat an id are candidates to each other's id only (a query's own id is never its neighbour); null ids take no part. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm import common

LEAF, SHARD_POINTS, BLOCK_BYTES, SALTS = 64, 8_192, 32_000_000, 16
#: Rounding of products of unit vectors, and of chords that are worked out from them.
TIE, SLACK = 1e-12, 2e-6
#: Queries that walk a tree together; pairs that gather before the best are chosen; pairs whose cosine is worked out at a time.
QUERIES, HELD, PAIRS = 2_048, 200_000, 20_000


def chord(points: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - q) ** 2).sum(axis=1), 0.0))


def build_tree(points: np.ndarray, leaf: int = LEAF):
    """Nested (vantage, radius, inside, outside) over row numbers; a leaf is an array of rows. Rows at the median distance go inside."""

    def node(rows: np.ndarray):
        if len(rows) <= leaf:
            return rows
        # the point farthest from an arbitrary one spreads the others best
        vantage = rows[int(chord(points[rows], points[rows[0]]).argmax())]
        rest = rows[rows != vantage]
        d = chord(points[rest], points[vantage])
        radius = float(np.median(d))
        inside, outside = rest[d <= radius], rest[d > radius]
        if not len(outside):
            return rows
        return (int(vantage), radius, node(inside), node(outside))

    return node(np.arange(len(points)))


def leaf_of(tree, points: np.ndarray, q: np.ndarray):
    """The leaf a vector would be filed in."""
    while isinstance(tree, tuple):
        vantage, radius, inside, outside = tree
        tree = inside if chord(points[vantage : vantage + 1], q)[0] <= radius else outside
    return tree


def search_block(tree, points: np.ndarray, block: np.ndarray, k: int, factor: float, choose) -> tuple[np.ndarray, np.ndarray, int]:
    """(query, row) of the nearest rows of each query of a block, and how many pairs were compared. A query starts in its own leaf; then the block walks the tree together, each query as far as the triangle inequality asks.

    Kept are rows whose product is within TIE of a query's k-th largest; ``choose(query, row)`` gives the places of those to keep, at most k a query, whenever many have gathered and at the end.
    """
    best = np.full((len(block), k), -np.inf)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = compared = 0

    def offer(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        nonlocal waiting, compared
        product = block[at] @ points[rows].T
        compared += product.size
        both = np.concatenate([best[at], product], axis=1)
        best[at] = np.partition(both, -k, axis=1)[:, -k:]
        i, j = np.nonzero(product >= best[at].min(axis=1)[:, None] - TIE)
        held.append((at[i], rows[j], product[i, j]))
        waiting += len(i)
        if waiting > HELD:
            shrink()
        return product

    def shrink() -> None:
        nonlocal waiting
        if not held:
            return
        at, rows, product = (np.concatenate(x) for x in zip(*held, strict=True))
        fit = product >= best.min(axis=1)[at] - TIE
        at, rows, product = at[fit], rows[fit], product[fit]
        keep = choose(at, rows)
        held[:] = [(at[keep], rows[keep], product[keep])]
        waiting = 0

    homes: dict[int, tuple[np.ndarray, list[int]]] = {}
    for i in range(len(block)):
        leaf = leaf_of(tree, points, block[i])
        homes.setdefault(id(leaf), (leaf, []))[1].append(i)
    home = np.zeros(len(block), "i8")
    for key, (leaf, own) in homes.items():
        home[own] = key
        if len(leaf):
            offer(np.array(own), leaf)

    todo = [(tree, np.arange(len(block)), np.zeros(len(block)))]
    while todo:
        node, at, least = todo.pop()
        reach = np.sqrt(np.maximum(2 - 2 * (best[at].min(axis=1) - TIE), 0.0)) / factor + SLACK
        near = least <= reach
        at, least = at[near], least[near]
        if not isinstance(node, tuple):
            at = at[home[at] != id(node)]
            if len(at) and len(node):
                offer(at, node)
        elif len(at):
            vantage, radius, inside, outside = node
            d = np.sqrt(np.maximum(2 - 2 * offer(at, np.array([vantage]))[:, 0], 0.0))
            todo.append((outside, at, np.maximum(least, radius - d)))
            todo.append((inside, at, np.maximum(least, d - radius)))
    shrink()
    at, rows, _ = held[0] if held else (np.zeros(0, "i8"),) * 3
    return at, rows, compared


def cosine(rows: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, with sums in order of components, as Spark's ``aggregate`` adds them up."""
    dot, of_rows, of_w = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows))
    for d in range(rows.shape[1]):
        x, y = rows[:, d], w[:, d]
        dot, of_rows, of_w = dot + y * x, of_rows + x * x, of_w + y * y
    return dot / (np.sqrt(of_w) * np.sqrt(of_rows))


def chosen(raw: np.ndarray, least: np.ndarray, asked: np.ndarray, k: int):
    """For ``search_block``: places of the k best pairs of each query by the exact cosine, ties to the smaller id."""

    def choose(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if not len(at):
            return at
        score = np.concatenate([cosine(raw[rows[i : i + PAIRS]], asked[at[i : i + PAIRS]]) for i in range(0, len(at), PAIRS)])
        order = np.lexsort((least[rows], -score, at))
        ranked = at[order]
        first = np.r_[True, ranked[1:] != ranked[:-1]]
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        return order[place < k]

    return choose


def clean_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part, v as doubles."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return table.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where("id is not null and v is not null").where(fit)


def points_of(vectors: DataFrame, k: int) -> DataFrame:
    """(p, v, ids): distinct vectors, with their k + 1 smallest ids."""
    keyed = vectors.withColumn("p", F.xxhash64("v")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    some = Window.partitionBy("p", "salt").orderBy("id")
    few = keyed.dropDuplicates(["p", "id"]).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k + 1)
    return few.groupBy("p").agg(F.first("v").alias("v"), F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"))  # at most SALTS * (k + 1) ids


def nearest(table: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_points: int = SHARD_POINTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine) of the k nearest rows of ``table`` to each row of ``queries``."""
    spark = table.sparkSession
    if factor < 1:
        raise ValueError("factor is at least 1")
    points = common.stage(points_of(clean_vectors(table, id_col, vector_col), k), "points")
    n = points.count()
    shards = -(-n // shard_points) or 1

    def plant(pdf):
        import pandas as pd

        raw = np.stack([np.asarray(v, "f8") for v in pdf["v"]])
        unit = scaled(raw)
        blob = pickle.dumps((build_tree(unit), unit, raw, pdf["least"].to_numpy()), protocol=5)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "dim": [raw.shape[1]], "p": [pdf["p"].tolist()], "tree": [blob]})

    def scaled(raw: np.ndarray) -> np.ndarray:
        raw = raw / np.abs(raw).max(axis=1, keepdims=True)
        return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))

    dealt = points.select("p", "v", F.col("ids")[0].alias("least"), F.size("v").alias("dim"), F.pmod(F.xxhash64("p", F.lit(7)), F.lit(shards)).alias("shard"))
    trees = common.stage(dealt.groupBy("shard", "dim").applyInPandas(plant, "shard bigint, dim int, p array<bigint>, tree binary"), "trees")

    asked = common.stage(clean_vectors(queries, id_col, vector_col).select(F.col("id").alias("query_id"), F.xxhash64("v").alias("p"), "v").dropDuplicates(["query_id", "p"]), "queries")
    unique = common.stage(asked.groupBy("p").agg(F.first("v").alias("v")), "query-points")
    size = unique.agg(F.sum(F.size("v") * 8)).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    found = None
    for b in range(blocks):
        rows = unique.where(F.pmod(F.xxhash64("p", F.lit(11)), F.lit(blocks)) == b).collect()  # about block_bytes
        by_dim: dict[int, tuple[list[int], np.ndarray]] = {}
        for dim in {len(r.v) for r in rows}:
            own = [r for r in rows if len(r.v) == dim]
            raw = np.array([r.v for r in own], "f8")
            by_dim[dim] = ([r.p for r in own], scaled(raw), raw)
        held = spark.sparkContext.broadcast(by_dim)

        def look(batches, held=held):
            for batch in batches:
                for dim, keys, blob in zip(*(batch.column(c).to_pylist() for c in ("dim", "p", "tree")), strict=True):
                    names, vectors, whole = held.value.get(dim, ([], [], []))
                    tree, unit, raw, least = pickle.loads(blob)  # noqa: S301  written above
                    for i in range(0, len(names), QUERIES):
                        part = slice(i, i + QUERIES)
                        at, rows, _ = search_block(tree, unit, vectors[part], k + 1, factor, chosen(raw, least, whole[part], k + 1))
                        yield pa.RecordBatch.from_arrays([pa.array([names[i + x] for x in at.tolist()], pa.int64()), pa.array([keys[r] for r in rows.tolist()], pa.int64())], ["q", "p"])

        part = common.stage(trees.repartition(max(shards, 1), "shard", "dim").mapInArrow(look, "q bigint, p bigint"), "found")
        found = part if found is None else found.union(part)

    # the best points a query vector, by the exact cosine, with their ids; then ids a query
    pair = found.join(points, "p").join(unique.select(F.col("p").alias("q"), F.col("v").alias("w")), "q")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    score = dot("w", "v") / (F.sqrt(dot("w", "w")) * F.sqrt(dot("v", "v")))
    ranked = pair.select("q", score.alias("score"), "ids").select("q", "score", F.explode("ids").alias("vec_id"))
    order = (F.desc("score"), F.asc("vec_id"))
    top = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("top"))
    own = asked.select("query_id", F.col("p").alias("q")).join(top, "q").select("query_id", F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("top"))
    return own.select("query_id", F.posexplode("top").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
