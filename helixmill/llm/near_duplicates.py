"""Near-duplicate classes by Order MinHash.

1. Equal texts are one node (keyed by a 64-bit hash of md5 and length).
2. A text's words (lower case, letters and digits) give its k-mers of ``k`` words, fewer in short texts (``mers_of``), labelled by occurrence. For each of ``m`` hash functions the ``l`` smallest labelled k-mers are taken and put back in text order; every two of them, in that order, are one sketch, l (l - 1) / 2 a function. Texts of high edit similarity agree in some sketch, and word order counts. (All l at once, as one sketch, would need several times as many functions for the same recall near the threshold.)
3. Nodes with an equal sketch meet their bucket's leader (its smallest node). Leaders are found by aggregation, so this pass gives as many pairs as buckets have members.
4. Pairs are verified by banded alignment of their words: the edit distance within the band that the budget allows. A pair is linked if 1 - distance / longer length is at least ``similarity``. A leader's text goes once to each part of its members.
5. Classes are the connected components of the links, found by alternating large-star and small-star joins, each round a written table.
6. Buckets whose other members are then in more than one class (a common passage, an unrelated leader) are searched whole, block against block, so that no task holds a bucket. Two lower bounds of the edit distance, by length and by word counts in ``BINS`` bins, say which texts of different classes may be similar; chains of such texts are families, of which only spanning pairs are written. The texts of a family then meet block against block, the nearest by the bounds first, and similar ones of different classes are joined. So all texts that meet in a bucket and are similar are in one class, and recall is that of the sketches (at least 0.9 at a similarity of 0.8, for random edits in texts of 5 to 2,000 words, as measured by the tests). No table has all pairs of a group; the comparisons of a family with many classes do grow with its square.

Defined cases: null texts are in a class of their own document; equal texts are one class, empty ones too; texts without words are linked with equal texts only; texts of fewer words than a k-mer have one, the whole text; repeated rows give one row each. Documents with a null id have a class by text, whose id is that of its smallest non-null id, or null. Only the id and text columns are read, so others may have any name; an id named like a result is ``<name>_kept``. Texts are sketched whole, a few at a time; the words of a text of any length are one array in a task.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm import common

K, L, M, SIMILARITY = 5, 5, 8, 0.8
#: Bins of word counts; nodes of a block of a bucket, nodes and words of one of a family; members that meet one copy of their leader's text; parts of a class.
BINS, BLOCK, FAMILY_BLOCK, BLOCK_WORDS, RUN, PARTS = 256, 1024, 512, 400_000, 64, 16
SEEN = 200_000
#: From these numbers of words on, k-mers have up to 2, 3 and ``k`` words: one edit spoils k of them, which in a short text are most.
SHORT = ((0, 2), (8, 3), (48, K))
_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _word_characters() -> np.ndarray:
    """By code point: is it a letter or a digit?"""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def words_of(text: str) -> np.ndarray:
    """A 64-bit hash of each word, in order: a polynomial in its characters' codes, mixed with its length."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    inside = _word_characters()[c]
    edges = np.diff(np.concatenate([[0], inside.view("i1"), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, "u8")
    size = ends - starts
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(size.max()), _GOLD))
        code = c[inside].astype("u8") * _M1
        code ^= code >> np.uint64(29)
        sums = np.add.reduceat(code * powers[np.arange(len(code)) - np.repeat(first, size)], first)
        return mix(sums + size.astype("u8") * _M2)


def order_min_hash(words: np.ndarray, k: int = K, l: int = L, m: int = M) -> np.ndarray:  # noqa: E741
    """The sketches of a text's word hashes by k-mers of one length; none for a text without words."""
    if not len(words):
        return np.zeros(0, "i8")
    k = min(k, len(words))
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        mers = np.zeros(n, "u8")
        for j in range(k):
            mers = mers * _GOLD + words[j : j + n]
        order = np.argsort(mers, kind="stable")
        ranked = mers[order]
        fresh = np.r_[True, ranked[1:] != ranked[:-1]]
        first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        occurrence = np.empty(n, "u8")
        occurrence[order] = (np.arange(n) - first).astype("u8")
        labelled = mix(mers + occurrence * _GOLD)
        seeds = mix(np.arange(1, m + 1, dtype="u8") * _GOLD)
        p, q = np.triu_indices(min(l, n), 1) if n > 1 else (np.zeros(1, int), np.zeros(1, int))
        out = []
        rows = max(1, (1 << 18) // n)  # functions at a time: a matrix of at most a quarter of a million values
        for i in range(0, m, rows):
            values = (labelled[None, :] ^ seeds[i : i + rows, None]) * _M1
            values ^= values >> np.uint64(32)
            at = np.sort(np.argpartition(values, l - 1, axis=1)[:, :l], axis=1) if n > l else np.tile(np.arange(n), (len(values), 1))
            x = labelled[at]
            out.append(mix(mix(seeds[i : i + rows, None] * _GOLD + x[:, p]) * _GOLD + x[:, q]).ravel())
    return np.unique(np.concatenate(out)).view("i8")


def mers_of(n: int, k: int, similarity: float) -> set[int]:
    """The k-mer lengths of a text of n words: those of every length that a similar text may have, so that any two similar texts have one in common."""
    low, high = math.ceil(similarity * n - 1e-9), math.floor(n / similarity + 1e-9)
    least = max(start for start, _ in SHORT if start <= low)
    return {k if size == K else min(k, size) for start, size in SHORT if least <= start <= high}


def sketches(words: np.ndarray, k: int = K, l: int = L, m: int = M, similarity: float = SIMILARITY) -> np.ndarray:  # noqa: E741
    """The sketches of a text's word hashes for all its k-mer lengths."""
    return np.unique(np.concatenate([order_min_hash(words, size, l, m) for size in sorted(mers_of(len(words), k, similarity))]))


def banded_distance(a: np.ndarray, b: np.ndarray, budget: int) -> int | None:
    """Edit distance of two sequences if at most ``budget``, else None. Only diagonals within the budget are visited."""
    if abs(len(a) - len(b)) > budget:
        return None
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
    tail = int(differ[0]) if len(differ) else short
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m) if max(n, m) <= budget else None
    both, counts = np.unique(np.concatenate([a, b]), return_inverse=True)
    surplus = np.bincount(counts[:n], minlength=len(both)) - np.bincount(counts[n:], minlength=len(both))
    if max(int(surplus[surplus > 0].sum()), -int(surplus[surplus < 0].sum())) > budget:
        return None
    distance = _band(a.tolist(), b.tolist(), min(budget, max(n, m)))
    return distance if distance <= budget else None


def _band(a: list, b: list, k: int) -> int:
    """Edit distance by the diagonals -k .. k, or a number over k; a row of the band is one pair of bit vectors of differences between neighbouring cells."""
    if len(a) <= k:  # a common end changes no distance, and makes the band narrower than the table
        end = [None] * (k + 1 - len(a))
        a, b = a + end, b + end
    n, m = len(a), len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << (2 * k + 1)) - 1
    up, down = full >> k << k, 0  # cells one more, and one less, than the cell above
    score, most = k, 2 * k + m - n
    get = places.get
    for j, x in enumerate(b):
        same = get(x, 0)
        if same:
            same = (same >> (j - k) if j >= k else same << (k - j)) & full
        zero = (((same & up) + up) ^ up) | same | down
        right, left = down | (full & ~(zero | up)), zero & up
        if j < n - k:  # the score is that of the lowest diagonal
            score += not zero >> (2 * k) & 1
        else:  # then of the last row
            at = n - 1 - j + k
            score += (right >> at & 1) - (left >> at & 1)
        if score > most:
            return k + 1
        low = (zero & full) >> 1
        up, down = left | (full & ~(low | right)), low & right
    return score


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    longer = max(len(a), len(b))
    return bool(longer) and banded_distance(a, b, int((1 - least) * longer + 1e-9)) is not None


def bins_of(words: np.ndarray) -> bytes:
    """Words by bin of their hash, a byte a bin; counts stop at 255, which only lowers the bound of ``far_apart``."""
    return np.minimum(np.bincount((words % np.uint64(BINS)).astype("i8"), minlength=BINS), 255).astype("u1").tobytes()


def far_apart(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """A lower bound of the edit distance of one row of bins to others: the larger surplus of either side."""
    differ = others.astype("i2") - one.astype("i2")
    return (np.abs(differ).sum(axis=1) + np.abs(differ.sum(axis=1))) // 2


def _others(i: int, ends: np.ndarray, label: np.ndarray, side: np.ndarray, bins: np.ndarray, lengths: np.ndarray, least: float):
    """Rows after i, and their lower bounds, that have another label and, where both sides are there, are of the other side, and whose length and bins allow a similarity of ``least``. Rows are in order of length."""
    at = np.arange(i + 1, ends[i])
    at = at[(label[at] != label[i]) & ((side[at] != side[i]) | (side.min() == side.max()))]
    if len(at):
        bound = far_apart(bins[i], bins[at])
        fits = bound <= ((1 - least) * lengths[at] + 1e-9).astype("i8")
        return at[fits], bound[fits]
    return at, at


def spanning(bins: np.ndarray, n_words: np.ndarray, root: np.ndarray, side: np.ndarray, least: float):
    """Pairs (i, j) that connect all rows which chains of possibly similar rows of different roots connect: fewer than there are rows."""
    order = np.argsort(n_words, kind="stable")
    bins, lengths, root, side = bins[order], n_words[order], root[order], side[order]
    ends, family = np.searchsorted(lengths * least, lengths + 1e-9, side="right"), np.arange(len(order))
    for i in range(len(order)):
        at, _ = _others(i, ends, family, side, bins, lengths, least)
        at = at[root[at] != root[i]]
        labels, first = np.unique(family[at], return_index=True)
        for label, j in zip(labels.tolist(), at[first].tolist(), strict=True):
            family[family == label] = family[i]
            yield order[i], order[j]


def joining(words: list[np.ndarray], root: np.ndarray, side: np.ndarray, least: float):
    """Verified pairs (i, j) that join the roots of similar rows, the nearest by the lower bounds first: fewer than there are roots."""
    n_words, bins = np.array([len(x) for x in words]), np.stack([np.frombuffer(bins_of(x), "u1") for x in words])
    order = np.argsort(n_words, kind="stable")
    bins, lengths, root, side = bins[order], n_words[order], root[order].copy(), side[order]
    ends = np.searchsorted(lengths * least, lengths + 1e-9, side="right")
    for i in range(len(order)):
        at, bound = _others(i, ends, root, side, bins, lengths, least)
        for j in at[np.argsort(bound, kind="stable")].tolist():
            if root[j] != root[i] and similar(words[order[i]], words[order[j]], least):
                root[root == root[j]] = root[i]
                yield order[i], order[j]


def node_of(text_col):
    return F.xxhash64(F.md5(text_col), F.length(text_col))


def edges_of(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b"))


def roots_of(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) for every node but the smallest of its component, b the smallest; from edges (a, b) of longs, a > b. Tables of edges are written once a round and the star of the last is returned."""
    spark = edges.sparkSession
    digest = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())
    path = common.new_path(spark, "edges")
    now = common.stage(edges.distinct(), "edges", path)
    seen = digest(now)
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p1, p2, p3, p4 = (common.new_path(spark, x) for x in ("least", "large", "least", "edges"))
        least = common.stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least", p1)
        large = common.stage(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct(), "large", p2)
        least = common.stage(large.groupBy("a").agg(F.min("b").alias("m")), "least", p3)
        linked = large.join(least, "a")
        small = linked.select("a", F.col("m").alias("b")).union(linked.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        new = common.stage(small, "edges", p4)
        was, seen = seen, digest(new)
        common.remove(spark, path, p1, p2, p3)
        now, path = new, p4
        if seen == was:
            break
    return now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, l: int = L, m: int = M, similarity: float = SIMILARITY) -> DataFrame:  # noqa: E741
    """Per row: its id, class_id (the smallest id of its class) and node (its text's key, null for a null text)."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(common.new_path(spark, name))
        return common.stage(df, name, made[-1])

    def sketch(batches):
        common.worker_state(("near-duplicates",), dict)
        seen: set[int] = set()  # a text that the task has met before needs no second sketch
        for batch in common.slices(batches, "text"):
            n, out, bins = [], [], []
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if node in seen:
                    n.append(None)
                    bins.append(None)
                    out.append(None)
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                words = words_of(text)
                n.append(len(words))
                bins.append(bins_of(words))
                out.append(sketches(words, k, l, m, similarity))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("node"), pa.array(n, pa.int32()), pa.array(out, pa.list_(pa.int64())), pa.array(bins, pa.binary())], ["id", "node", "n_words", "sketch", "bins"])

    kind = slim.schema["id"].dataType.simpleString()
    keyed = slim.where("text is not null").select("id", node_of(F.col("text")).alias("node"), "text")
    rows = keyed.mapInArrow(sketch, f"id {kind}, node bigint, n_words int, sketch array<bigint>, bins binary")
    nodes = keep(rows.groupBy("node").agg(F.min("id").alias("rep"), *(F.first(x, ignorenulls=True).alias(x) for x in ("n_words", "sketch", "bins"))), "nodes")

    buckets = nodes.select("node", "n_words", F.explode("sketch").alias("bucket"))
    leaders = keep(buckets.groupBy("bucket").agg(F.min(F.struct("node", "n_words")).alias("lead"), F.count("*").alias("n")).where("n > 1").select("bucket", "n", F.col("lead.node").alias("leader"), F.col("lead.n_words").alias("lead_words")), "leaders")
    near = F.least("n_words", "lead_words") >= similarity * F.greatest("n_words", "lead_words") - 1e-9
    # most buckets have one node: a bitmap of the others keeps those out of the second shuffle
    members = keep(common.among(buckets, leaders, "bucket").join(leaders, "bucket").where("node <> leader"), "members")
    pairs = keep(members.where(near).select("node", "leader").distinct(), "pairs")

    def verify(batches):
        """Rows in order of (leader, part), the leader's own first."""
        common.worker_state(("near-duplicates",), dict)
        lead, words = None, None
        for batch in common.slices(batches, "text"):
            nodes, leaders = [], []
            for leader, part, node, text in zip(*(batch.column(c).to_pylist() for c in ("leader", "part", "node", "text")), strict=True):
                own = words_of(text)
                if node == leader:
                    lead, words = (leader, part), own
                elif lead == (leader, part) and similar(own, words, similarity):
                    nodes.append(node)
                    leaders.append(leader)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(leaders, pa.int64())], ["node", "leader"])

    def texts_of(wanted: DataFrame) -> DataFrame:
        """(node, text) of nodes, read again by their smallest id; a bitmap of these rows keeps most others out of the shuffle."""
        wanted = keep(wanted.select("node").distinct().join(nodes.select("node", "rep"), "node"), "wanted")
        likely = common.among(keyed.withColumn("row", F.xxhash64("node", "id")), wanted.select(F.xxhash64("node", "rep").alias("row")), "row")
        found = likely.join(wanted, "node", "left_semi")  # by the node alone, as the grouping is: texts are shuffled once
        return keep(found.groupBy("node").agg(F.first("text").alias("text")), "texts")

    # parts of a leader's members, and the leader itself once a part
    parts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / RUN).cast("int").alias("parts"))
    dealt = pairs.join(parts, "leader").select("leader", F.pmod(F.xxhash64("node", F.lit("part")), "parts").cast("int").alias("part"), "node")
    met = keep(dealt.union(parts.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("leader").alias("node"))), "met")
    runs = met.join(texts_of(met), "node").select("leader", "part", "node", "text").repartition("leader", "part").sortWithinPartitions("leader", "part", F.col("node") != F.col("leader"))
    stars = components(edges_of(keep(runs.mapInArrow(verify, "node bigint, leader bigint"), "links")))

    def across(batches):
        """Pairs (node, leader) that connect the families in each run of equal (bucket, i, j); a run may go on in the next batch."""
        common.worker_state(("near-duplicates",), dict)
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            keys = np.stack([held.column(c).to_numpy() for c in ("bucket", "i", "j")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            if len(cuts):
                yield from searched(held.slice(0, int(cuts[-1])), cuts)
                held = held.slice(int(cuts[-1]))
        if held is not None and len(held):
            yield from searched(held, np.array([len(held)]))

    def searched(t: pa.Table, ends: np.ndarray):
        node, n_words, root, side = (t.column(c).to_numpy() for c in ("node", "n_words", "root", "block"))
        bins = np.frombuffer(b"".join(t.column("bins").to_pylist()), "u1").reshape(-1, BINS)
        out, begin = set(), 0
        for end in ends.tolist():
            x = slice(begin, end)
            for p, q in spanning(bins[x], n_words[x], root[x], side[x], similarity):
                p, q = int(node[begin + p]), int(node[begin + q])
                out.add((max(p, q), min(p, q)))
                if len(out) >= 50_000:
                    yield batch_of(out)
                    out = set()
            begin = end
        if out:
            yield batch_of(out)

    def joined(batches):
        """Links between classes, of each run of equal (family, i, j)."""
        common.worker_state(("near-duplicates",), dict)
        now, rows = None, []
        for batch in common.slices(batches, "text"):
            for *key, node, root, block, text in zip(*(batch.column(c).to_pylist() for c in ("family", "i", "j", "node", "root", "block", "text")), strict=True):
                if key != now and rows:
                    yield links_in(rows)
                    rows = []
                now = key
                rows.append((node, root, block, words_of(text)))
        if rows:
            yield links_in(rows)

    def links_in(rows: list[tuple]) -> pa.RecordBatch:
        node, root, side, words = zip(*rows, strict=True)
        return batch_of({(node[i], node[j]) for i, j in joining(list(words), np.array(root), np.array(side), similarity)})

    def batch_of(out: set) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["node", "leader"])

    # members of buckets that are in several classes, without the leader, which has met all; buckets of the same members count once
    rooted = members.where("n > 2").join(roots_of(stars), "node", "left").select("bucket", "node", "n_words", F.coalesce("root", "node").alias("root"))
    digest = (F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("d1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("d2"))
    mixed = rooted.groupBy("bucket").agg(*digest, F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    mixed = keep(mixed.groupBy("n", "d1", "d2").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "mixed")
    dealt = rooted.join(mixed, "bucket").withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), "blocks").cast("int"))
    dealt = dealt.join(nodes.select("node", "bins"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "n_words", "root", "block", "bins")
    crossing = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(across, "node bigint, leader bigint").distinct()
    crossing = keep(crossing, "crossing")
    if crossing.limit(1).count():
        # families: what chains of possibly similar texts connect; their texts meet block against block
        chained = components(edges_of(crossing))
        family = chained.select(F.col("a").alias("node"), F.col("b").alias("family")).union(chained.select(F.col("b").alias("node"), F.col("b").alias("family")).distinct())
        family = keep(family.join(nodes.select("node", "n_words"), "node").join(roots_of(stars), "node", "left").withColumn("root", F.coalesce("root", "node")), "family")
        sizes = family.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / FAMILY_BLOCK, F.sum("n_words") / BLOCK_WORDS)).cast("int").alias("blocks"))
        dealt = family.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), "blocks").cast("int")).join(texts_of(family), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "root", "block", "text")
        more = keep(dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(joined, "node bigint, leader bigint"), "links")
        stars = components(stars.unionByName(edges_of(more)))

    # the smallest id of a class; its members are dealt into parts, so that a large class is no key of one task
    part = lambda node: F.pmod(F.xxhash64(node, F.lit("part")), F.lit(PARTS))
    reps = nodes.select("node", "rep")
    inside = roots_of(stars).union(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()).join(reps, "node")
    roots = inside.groupBy("root").agg(F.min("rep").alias("class_id")).select("root", "class_id", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    classed = inside.select("node", "root", part("node").alias("part")).join(roots, ["root", "part"]).select("node", "class_id")
    classes = keep(reps.join(classed, "node", "left").select("node", F.coalesce("class_id", "rep").alias("class_id")), "classes")
    common.remove(spark, *(x for x in made if "/classes-" not in x))
    out = slim.select("id", F.when(F.col("text").isNotNull(), node_of(F.col("text"))).alias("node")).join(classes, "node", "left")
    (name,) = common.apart((id_col,), ("class_id", "node"))
    return out.select(F.col("id").alias(name), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), "node")
