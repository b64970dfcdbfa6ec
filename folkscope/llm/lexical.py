"""Ranked lexical search: posting lists in geometric blocks with coordinatewise-maximum summaries.

Documents are searched in shards of bounded size, each within one task. A shard has a
posting list per term. A list is cut into blocks of documents that are alike: some of its
documents stand for the others, each goes to the most similar one by a sketch of its
terms, and groups are cut to the block size. A block's summary holds for each term the
most that any of its documents has (Bruch, Nardini, Rulli, Venturini, "Efficient inverted
indexes for approximate retrieval over learned sparse representations", 2024). Here
summaries keep every term and every maximum, so a query's product with one is a true upper
bound, and the search is exact: a block is skipped only if its bound cannot reach the
query's k-th best score.

A query goes through its terms from the rarest on. A document that holds an earlier term was
met in that term's list, and was scored or proven out there; so at a later list bounds
count the remaining terms alone, and the search ends as soon as these cannot suffice.
Lists are blocked when first needed, and a summary keeps the terms that some query of the
block of queries could ask of it.

Scores are whole numbers: weight(term) * impact(term, document), the weight from the number
of documents with the term, the impact from occurrences and length. These counts cover all
documents. Queries go out in blocks of at most ``ITEM_BYTES`` of text; for each, documents
are read once and kept as numbers of the block's terms, which the search reads.

Defined cases: a null or empty text has no terms, is no document of the collection, and
as a query finds nothing; rows that repeat an id are documents or queries each; a null
doc_id comes after all others among equal scores; terms that nearly all documents hold
may weigh 0 and find nothing; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folkscope.llm.registry import read_table, register
from folkscope.llm.tokens import gathered
from folkscope.session import scratch_path

K = 50
ITEM_BYTES = 4 << 20  # of query texts sent to all tasks at once
SHARD_DOCS = 1 << 15
SHARD_POSTINGS = 1 << 22
BLOCK_DOCS = 32
SKETCH = 16  # numbers that stand for a document's terms when lists are blocked
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
BASE, SLOPE, UNIT = 50, 50, 1_000_000_000  # of lengths and impacts


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text: runs of letters, digits and characters beyond ASCII, A-Z as a-z."""
    return TERM.findall((text or "").encode().lower())


VECTOR = "doc_id long, n long, terms array<int>, counts array<int>"
VECTOR_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])


def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts): a document's length and how often it has the terms of the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for batch in batches:
            n, terms, counts = [], [], []
            for text in batch.column(1):
                found = terms_of(text.as_py())
                n.append(len(found))
                known = Counter(map(number, found))
                known.pop(None, None)
                terms.append(list(known))
                counts.append(list(known.values()))
            columns = [batch.column(0), *(pa.array(v, t.type) for v, t in zip((n, terms, counts), list(VECTOR_ARROW)[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=VECTOR_ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, VECTOR)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(n: np.ndarray, counts: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What each occurrence count is worth in a document of n terms, whole numbers throughout."""
    wide = SLOPE * int(n.max(initial=0)) * documents >= 1 << 63
    norm = 100 - BASE + (SLOPE * n.astype(object if wide else np.int64) * documents // length).astype(np.int64)
    return UNIT * counts // (1000 * counts + 20 * norm)


class Queries:
    """A block of queries: each one's terms from the rarest on, and their weights."""

    def __init__(self, items: list[list[int]], weights: np.ndarray):
        self.weights = weights
        self.terms = []
        for terms in items:
            own = np.array(sorted(t for t in terms if weights[t] > 0), np.int64)
            self.terms.append(own[np.argsort(-weights[own], kind="stable")])
        self.asking: dict[int, list[int]] = {}
        for q, terms in enumerate(self.terms):
            for t in terms.tolist():
                self.asking.setdefault(t, []).append(q)
        self.wanted: dict[int, np.ndarray] = {}

    def later(self, term: int) -> np.ndarray:
        """The terms that some query still counts when it comes to this term's list, the term included."""
        if term not in self.wanted:
            parts = [self.terms[q][np.flatnonzero(self.terms[q] == term)[0] :] for q in self.asking[term]]
            self.wanted[term] = np.unique(np.concatenate(parts))
        return self.wanted[term]


class Best:
    """The k best documents of a query: highest score first, then ids, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.doc, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def offer(self, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        if len(self.score) == self.k:
            near = score >= self.score[-1]
            score, doc, none = score[near], doc[near], none[near]
        if len(score):
            score, doc, none = (np.concatenate(p) for p in ((self.score, score), (self.doc, doc), (self.none, none)))
            order = np.lexsort((doc, none, -score))[: self.k]
            self.score, self.doc, self.none = score[order], doc[order], none[order]

    def may_enter(self, bound: np.ndarray, least_doc: np.ndarray) -> np.ndarray:
        """Whether something with at most this score and at least this id could be among the k best."""
        if len(self.score) < self.k:
            return bound > 0
        last = self.score[-1]
        return (bound > last) | ((bound == last) & (least_doc <= self.doc[-1] if not self.none[-1] else True))


class Blocks:
    """A term's posting list in blocks: their documents, least ids and summaries."""

    def __init__(self, shard: Shard, term: int, queries: Queries):
        docs = shard.posted(term)
        group = np.zeros(len(docs), np.int64)
        leaders = -(-len(docs) // BLOCK_DOCS)
        if leaders > 1:
            led = shard.sketch[docs[(np.arange(leaders) * len(docs)) // leaders]].T
            for at in range(0, len(docs), 4096):
                group[at : at + 4096] = (shard.sketch[docs[at : at + 4096]] @ led).argmax(axis=1)
        order = np.argsort(group, kind="stable")
        docs, group = docs[order], group[order]
        fresh = np.concatenate([[True], group[1:] != group[:-1]])
        begin = np.flatnonzero(fresh)
        place = np.arange(len(docs)) - np.repeat(begin, np.diff(np.append(begin, len(docs))))
        fresh |= place % BLOCK_DOCS == 0  # large groups, as of copies, make several blocks
        self.docs, self.begin = docs, np.append(np.flatnonzero(fresh), len(docs))
        self.least = np.minimum.reduceat(shard.doc_id[docs], self.begin[:-1])
        block = np.cumsum(fresh) - 1
        wanted = queries.later(term)
        slot = np.full(shard.width, -1, np.int64)
        slot[wanted] = np.arange(len(wanted))
        count = shard.begin[docs + 1] - shard.begin[docs]
        at, _ = gathered(shard.place, shard.begin[docs], shard.begin[docs + 1])
        of, inside = slot[shard.term[at]], np.repeat(block, count)
        kept = of >= 0
        key, value = of[kept] * len(self.least) + inside[kept], shard.impact[at[kept]]
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key = key[first]
        self.most, self.block = np.maximum.reduceat(value, first), key % len(self.least)
        self.slots = dict(zip(wanted.tolist(), range(len(wanted)), strict=True))
        self.ends = np.searchsorted(key // len(self.least), np.arange(len(wanted) + 1))

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Per block the most that the given terms can add up to in one of its documents."""
        out = np.zeros(len(self.least), np.int64)
        for t in terms.tolist():
            k = self.slots[t]
            part = slice(self.ends[k], self.ends[k + 1])
            out[self.block[part]] += weights[t] * self.most[part]
        return out


class Shard:
    """Some documents as rows of (term, impact) and as posting lists."""

    def __init__(self, doc_id, none, begin, term, impact, width: int):
        self.doc_id, self.none, self.begin, self.term, self.impact, self.width = doc_id, none, begin, term, impact, width
        self.place = np.arange(len(term))
        self.order = np.argsort(term, kind="stable")
        self.ends = np.searchsorted(term[self.order], np.arange(width + 1))
        self.row = np.repeat(np.arange(len(doc_id)), np.diff(begin))
        self.top = np.zeros(width, np.int64)
        np.maximum.at(self.top, term, impact)
        self.blocks: dict[int, Blocks] = {}
        # Each term points into one of some directions; documents with like terms point alike.
        direction = np.random.default_rng(0).normal(size=(width, SKETCH)).astype(np.float32)
        sketch = np.zeros((len(doc_id), SKETCH), np.float32)
        for d in range(SKETCH):
            sketch[:, d] = np.bincount(self.row, direction[term, d] * impact, minlength=len(doc_id))
        self.sketch = sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
        self.scored = 0

    def posted(self, term: int) -> np.ndarray:
        return self.row[self.order[self.ends[term] : self.ends[term + 1]]]

    def search(self, queries: Queries, best: list[Best]) -> None:
        met = np.full(len(self.doc_id), -1, np.int64)
        mine = np.zeros(self.width, np.int64)
        for q, found in enumerate(best):
            terms = queries.terms[q]
            terms = terms[self.ends[terms + 1] > self.ends[terms]]
            if not len(terms):
                continue
            mine[terms] = queries.weights[terms]
            rest = np.cumsum((queries.weights[terms] * self.top[terms])[::-1])[::-1]
            for k, term in enumerate(terms.tolist()):
                if not found.may_enter(rest[k : k + 1], np.array([self.doc_id.min()]))[0]:
                    break
                if term not in self.blocks:
                    self.blocks[term] = Blocks(self, term, queries)
                blocks = self.blocks[term]
                bound = blocks.bounds(terms[k:], queries.weights)
                left, step = np.argsort(-bound, kind="stable"), 2
                while len(left):
                    left = left[found.may_enter(bound[left], blocks.least[left])]
                    now, left = left[:step], left[step:]
                    docs, _ = gathered(blocks.docs, blocks.begin[now], blocks.begin[now + 1])
                    docs = docs[met[docs] != q]
                    met[docs] = q
                    self.score(docs, mine, found)
                    step *= 2
            mine[terms] = 0

    def score(self, docs: np.ndarray, mine: np.ndarray, found: Best) -> None:
        if len(docs):
            at, ends = gathered(self.place, self.begin[docs], self.begin[docs + 1])
            total = np.add.reduceat(mine[self.term[at]] * self.impact[at], np.concatenate([[0], ends[:-1]]))
            found.offer(total, self.doc_id[docs], self.none[docs])
            self.scored += len(docs)


FOUND = pa.schema([("place", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def search_pass(vectors: DataFrame, items: list[list[int]], weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """(place, doc_id, score): per task the k best documents of each query that its documents hold."""
    sent = vectors.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Queries(*sent.value)
        best = [Best(k) for _ in queries.terms]
        held: list[tuple] = []

        def flush() -> None:
            doc_id, none, n, sizes, term, counts = (np.concatenate(p) for p in zip(*held, strict=True))
            impact = impacts(np.repeat(n, sizes), counts, documents, length)
            begin = np.concatenate([[0], np.cumsum(sizes)])
            Shard(doc_id, none, begin, term, impact, len(queries.weights)).search(queries, best)
            held.clear()

        docs = postings = 0
        for batch in batches:
            ids, terms, counts = batch.column(0), batch.column(2), batch.column(3)
            none = ids.is_null().to_numpy(zero_copy_only=False)
            numbers = [np.asarray(c, np.int64) for c in (ids.fill_null((1 << 63) - 1), batch.column(1), terms.value_lengths())]
            held.append((numbers[0], none, numbers[1], numbers[2], *(np.asarray(c.flatten(), np.int64) for c in (terms, counts))))
            docs, postings = docs + len(none), postings + len(held[-1][4])
            if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                flush()
                docs = postings = 0
        if held:
            flush()
        for at in range(0, len(best), 256):
            part = best[at : at + 256]
            place = np.repeat(np.arange(at, at + len(part)), [len(b.score) for b in part])
            score, doc, none = (np.concatenate([getattr(b, c) for b in part]) for c in ("score", "doc", "none"))
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(doc, mask=none), pa.array(score)], schema=FOUND)

    held = vectors.where(F.size("terms") > 0)
    return held.mapInArrow(run, "place long, doc_id long, score long")


def search_lexical(docs: DataFrame, items: DataFrame, k: int = K, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` its k best documents with a score above 0.

    ``docs`` has doc_id and text, ``items`` item_id and text.
    """
    spark = docs.sparkSession
    queries = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-(queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes))
    folder = scratch_path(spark, "lexical")
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        vocabulary: dict[bytes, int] = {}
        numbered = [[vocabulary.setdefault(t, len(vocabulary)) for t in dict.fromkeys(terms_of(r["text"]))] for r in block]
        path = scratch_path(spark, "vectors")
        term_vectors(docs, vocabulary).write.parquet(path)
        vectors = spark.read.schema(VECTOR).parquet(path)
        total = vectors.where("n > 0").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
        holding = np.zeros(len(vocabulary), np.int64)
        for row in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect():
            holding[row["term"]] = row["n"]
        weights = np.array([weight(total["documents"], int(h)) if h else 0 for h in holding], np.int64)
        found = search_pass(vectors, numbered, weights, total["documents"], total["length"] or 1, k)
        order = Window.partitionBy("place").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(p, r["item_id"]) for p, r in enumerate(block)], "place long, item_id long")
        ranked.join(names, "place").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(folder)
    return spark.read.schema("item_id long, rank int, doc_id long, score long").parquet(folder)


@register(
    "op12_lexical_search",
    r"""
    WITH d AS MATERIALIZED (
        SELECT row_number() OVER () AS place, doc_id,
            regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms
        FROM documents
    ), total AS (SELECT count(*) AS documents, sum(len(terms))::BIGINT AS length FROM d WHERE len(terms) > 0),
    q AS MATERIALIZED (
        SELECT DISTINCT item_id, unnest(
            regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
        FROM benchmark
    ), t AS MATERIALIZED (
        SELECT place, doc_id, n, term, count(*) AS tf
        FROM (SELECT place, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
        WHERE term IN (SELECT term FROM q) GROUP BY ALL
    ), w AS (
        SELECT term, floor(1000 * ln((2 * documents + 2) / (2 * df + 1)))::BIGINT AS w
        FROM (SELECT term, count(*) AS df FROM t GROUP BY term), total
    ), s AS (
        SELECT item_id, place, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * documents) // length))))::BIGINT AS score
        FROM q JOIN t USING (term) JOIN w USING (term), total GROUP BY item_id, place, doc_id
    )
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
    FROM s WHERE score > 0 QUALIFY rank <= 50
    """,
)
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return search_lexical(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
