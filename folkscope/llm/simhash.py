"""SimHash near-duplicates: fingerprints, BK-tree search within a Hamming radius, components.

Fingerprints are 64 bits over word shingles (Charikar, 2002). Equal ones are one node. Two
fingerprints within 3 bits agree on one of four 16-bit blocks at least, so each is sent to
four shards, one per block and value, and a BK-tree (Burkhard and Keller, 1973) per shard
finds its neighbours: a child hangs on the edge named by its distance to the parent, and a
search at distance d follows only edges from d - 3 to d + 3. Trees are routed to their
queries by the shard's key rather than broadcast, as their size grows with the data.

A shard returns a spanning forest of its links, not all pairs. Forests are joined to
components by alternating large-star and small-star steps (Kiveris et al., "Connected
components in MapReduce and beyond", 2014), each a group-by and a join, written to the
scratch folder between steps.

A shard with more than ``SPLIT`` fingerprints is cut once more: what agrees on the
block's 16 bits and lies within 3 bits agrees on one of four 12-bit blocks of the rest, too.

Defined cases: null or empty texts have fingerprint 0 and are linked like others; every
row gives a row, repeated ones too; a null doc_id is no candidate for a component's
smallest, and a component of such rows only has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folkscope.llm.registry import read_table, register
from folkscope.session import materialise

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
SPLIT = 4_096
SEARCH_PAIRS = 1 << 17  # (query, node) pairs that a search step may hold before it goes in parts
BATCH_NODES = 1 << 17


def fingerprint(data: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a UTF-8 text: A-Z lowered, words between ASCII white space."""
    import xxhash

    words = data.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= shingle_words:
        hashes = [xxhash.xxh64_intdigest(text, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: 1 - shingle_words].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(text[a:b], SEED) for a, b in zip(starts, ends[shingle_words - 1 :].tolist(), strict=True)]
    count = np.zeros(64, np.int64)
    values = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    for k in range(0, len(values), 1 << 16):
        count += np.unpackbits(values[k : k + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, carry: str | None = None) -> DataFrame:
    """(doc_id, fp): fingerprints as signed 64-bit numbers. ``carry`` names a long column to come along."""
    also = [carry] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            values = np.array([fingerprint(t.as_py() or b"", shingle_words) for t in texts], np.uint64).view(np.int64)
            columns = [batch.column(0), pa.array(values, pa.int64()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", *also])

    columns = [F.col("doc_id").cast("long"), F.col("text").cast("string"), *also]
    return docs.select(*columns).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *also)))


class BKForest:
    """BK-trees over groups of distinct fingerprints, built and searched level by level.

    ``values``: fingerprints, those of a group next to each other; ``groups``: the group of
    each. The first of a group is its root. Inserting one after the other gives the same
    trees: at a node, the first item with a distance becomes the child on that edge, and
    later ones with this distance go on below it.
    """

    def __init__(self, values: np.ndarray, groups: np.ndarray):
        n = len(values)
        self.values = values
        first = np.concatenate([[True], groups[1:] != groups[:-1]]) if n else np.zeros(0, bool)
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        items = np.flatnonzero(~first)
        at = self.root[items]
        while len(items):
            distance = np.bitwise_count(values[items] ^ values[at]).astype(np.int64)
            key = at * 65 + distance
            _, new, back = np.unique(key, return_index=True, return_inverse=True)  # items ascend: the first is the earliest
            child = items[new]
            parent[child], edge[child] = at[new], distance[new]
            at = child[back]
            below = at != items
            items, at = items[below], at[below]
        order = np.lexsort((edge, parent))
        order = order[parent[order] >= 0]
        self.children, self.edges = order, edge[order]
        self.begin = np.searchsorted(parent[order], np.arange(n))
        self.end = np.searchsorted(parent[order], np.arange(n), side="right")

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs within the radius, in parts; queries are positions, each searched in its own tree."""
        stack = [(queries, self.root[queries])]
        while stack:
            query, node = stack.pop()
            if len(query) > SEARCH_PAIRS:
                half = len(query) // 2
                stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            distance = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
            near = (distance <= radius) & (query != node)
            if near.any():
                yield query[near], node[near]
            count = self.end[node] - self.begin[node]
            back = np.repeat(np.arange(len(query)), count)
            place = np.arange(len(back)) - np.repeat(np.cumsum(count) - count, count) + self.begin[node][back]
            follow = np.abs(self.edges[place] - distance[back]) <= radius
            back, place = back[follow], place[follow]
            if len(back):
                stack.append((query[back], self.children[place]))


def spanning_roots(forest: BKForest, radius: int) -> np.ndarray:
    """For each position the least position it is linked to, over any number of links."""
    n = len(forest.values)
    label = np.arange(n)
    for begin in range(0, n, 1 << 14):
        for a, b in forest.within(np.arange(begin, min(n, begin + (1 << 14))), radius):
            while True:
                low = np.minimum(label[a], label[b])
                open_ = label[a] != label[b]
                if not open_.any():
                    break
                a, b, low = a[open_], b[open_], low[open_]
                np.minimum.at(label, label[a], low)
                np.minimum.at(label, label[b], low)
                while (label[label] != label).any():
                    label = label[label]
    return label


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shard_links(nodes: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """(a, b) with a > b: links that span, within every shard, what its BK-tree connects.

    ``nodes`` has distinct ``fp``. Shards agree on one of radius + 1 blocks of bits.
    """
    blocks = radius + 1
    bits = 64 // blocks

    def block(k: int, width: int) -> F.Column:
        return F.shiftrightunsigned("fp", k * width).bitwiseAND((1 << width) - 1)

    keyed = nodes.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), block(k, bits).alias("v")) for k in range(blocks)))).alias("s"))
    keyed = keyed.select("fp", F.col("s.k").alias("k"), F.col("s.v").alias("v"))
    # Large shards, few and counted with partial sums, are cut by a second block among the other bits.
    large = keyed.groupBy("k", "v").count().where(F.col("count") > split).select(F.col("k").alias("lk"), F.col("v").alias("lv"))
    large = materialise(large, "large-shards")
    width = (64 - bits) // blocks
    # The other bits, moved together: those above the block, shifted onto those below it.
    below = F.expr(f"shiftleft(1L, k * {bits}) - 1")
    rest = F.expr(f"shiftleft(shiftrightunsigned(fp, (k + 1) * {bits}), k * {bits})")
    high = F.when(F.col("k") == blocks - 1, F.lit(0)).otherwise(rest)
    others = high.bitwiseOR(F.col("fp").bitwiseAND(below))
    cuts = F.array(*(F.struct(F.lit(j).alias("j"), F.shiftrightunsigned("others", j * width).bitwiseAND((1 << width) - 1).alias("w")) for j in range(blocks)))
    whole = F.array(F.struct(F.lit(-1).alias("j"), F.lit(0).cast("long").alias("w")))
    sharded = (
        keyed.join(large, (F.col("k") == F.col("lk")) & (F.col("v") == F.col("lv")), "left")
        .withColumn("others", others)
        .select("fp", "k", "v", F.explode(F.when(F.col("lk").isNull(), whole).otherwise(cuts)).alias("c"))
        .select("fp", F.xxhash64("k", "v", "c.j", "c.w").alias("shard"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(fps: np.ndarray, shards: np.ndarray) -> pa.RecordBatch:
            label = spanning_roots(BKForest(fps.view(np.uint64), shards), radius)
            far = np.flatnonzero(label != np.arange(len(label)))
            one, two = fps[far], fps[label[far]]
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(one, two)), pa.array(np.minimum(one, two))], schema=LINKS)

        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= BATCH_NODES:  # all whole shards so far; the last may go on
                fps, shards = (np.concatenate(c) for c in zip(*held, strict=True))
                cut = int(np.searchsorted(shards, shards[-1]))
                if cut:
                    yield links(fps[:cut], shards[:cut])
                held, size = [(fps[cut:], shards[cut:])], len(fps) - cut
        if size:
            fps, shards = (np.concatenate(c) for c in zip(*held, strict=True))
            yield links(fps, shards)

    return sharded.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every linked node: root is the least node of its component.

    Alternates the two star steps until a round changes nothing. Each step finds the least
    neighbour by partial aggregation, writes that, and joins it back, so a node with very
    many links is neither collected nor held by one task: the join may split it.
    """
    spark = links.sparkSession
    edges = materialise(links.select("a", "b"), "links")  # a > b
    total = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    for _ in range(max_rounds):
        if not total[0]:
            return spark.createDataFrame([], "node long, root long")
        # Large star: each node's larger neighbours are linked to its least neighbour (or itself).
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "n"), "least")
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: each node's smaller neighbours, and itself, are linked to the least of them.
        large = materialise(large, "large-star")
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n"), "least")
        small = large.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = small.union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a > b").distinct()
        edges = materialise(stars, "stars")
        before, total = total, edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == total:
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS, carry: str | None = None) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row.

    ``root`` names a component by one of its fingerprints, ``component_id`` is the smallest
    doc_id that links of fingerprints reach. ``carry`` names a long column of ``docs`` that comes along.
    """
    marked = materialise(fingerprints(docs, shingle_words, carry), "fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = materialise(components(shard_links(nodes.select("fp"), radius)), "components")
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "r")
    named = materialise(rooted.join(smallest, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "root", "component_id"), "named")
    return marked.join(named, F.col("fp") == F.col("f")).select("doc_id", "fp", "root", "component_id", *([carry] if carry else []))


def hex_digits(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


@register("op10_simhash_groups")
def op10_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fingerprint and component."""
    out = near_duplicates(read_table(spark, folder, "documents"))
    return out.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
