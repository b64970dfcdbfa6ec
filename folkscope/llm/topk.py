"""Exact top-k search by inner product: columnar branch-and-bound.

Vectors are held in vertical layout, one run of numbers per dimension (de Vries et al.,
"Efficient k-NN search on vertically decomposed data", 2002). Scores are summed block of
dimensions by block; after each block a candidate stays only if its partial sum plus the
most that the remaining dimensions can add, by Cauchy-Schwarz on the remaining masses,
reaches the query's threshold. Survivors are compacted and go on.

A query's first threshold is its k-th best score in a sample of candidates; as these are
candidates themselves, it is a lower bound for any sample, and only speed depends on it.

Queries are the stated set of rows; they go out in blocks of at most ``BLOCK_BYTES``,
each block in one pass over all candidates. Tasks return at most k rows per query, which
a window with a limit pushed below the shuffle ranks.

Defined cases: vectors that are null or hold a null or non-finite component, and rows with
a null id, take no part; an empty vector takes part and scores 0; of vectors of unequal
length the missing components count as 0; rows that repeat an id are candidates each, the
least of their vectors is the query, and no row with the query's id is its candidate;
scores are exact, and those beyond a 64-bit number become its bound and tie there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folkscope.llm.registry import read_table, register

K = 20
SCALE = 64
BLOCK_DIMENSIONS = 8
BLOCK_BYTES = 16 << 20  # of query vectors sent to all tasks at once
SAMPLE_ROWS = 2_048
CANDIDATE_ROWS = 16_384  # of one chunk in a task
QUERY_ROWS = 64
EXACT_FLOAT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): rows that take part, components as double."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.select(F.col("vec_id").cast("long"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite)


def integers(rows: list, width: int, scale: int) -> np.ndarray:
    """floor(scale * x), a row per vector, as exact numbers in floating point, or Python's where those don't suffice."""
    out = np.zeros((len(rows), width))
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    with np.errstate(over="ignore"):
        out = np.floor(out * scale)
    if out.size and not np.abs(out).max() < (EXACT_FLOAT / width) ** 0.5:
        exact = np.zeros(out.shape, object)
        for k, row in enumerate(rows):
            # A double times the scale is exact in Python's integers.
            exact[k, : len(row)] = [scale * a // b for a, b in (float(v).as_integer_ratio() for v in row)]
        return exact
    return out


def whole(vectors: np.ndarray) -> np.ndarray:
    """The same whole numbers as Python's integers."""
    if vectors.dtype == object:
        return vectors
    out = np.empty(vectors.shape, object)
    out[...] = [[int(v) for v in row] for row in vectors.tolist()]
    return out


class Block:
    """Queries with their running thresholds; finds in a chunk of candidates what may be in the top k."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray, step: int = BLOCK_DIMENSIONS):
        self.ids, self.vectors, self.k, self.step = ids, vectors, k, step
        self.floor = floor.copy()
        self.best: list[list[tuple]] = [[] for _ in ids]
        self.starts = list(range(0, vectors.shape[1], step))
        self.mass = self.remaining(vectors) if vectors.dtype != object else []

    def remaining(self, vectors: np.ndarray) -> list[np.ndarray]:
        """The norm of the dimensions from each block on, rounded up."""
        squares = vectors.astype(float) ** 2
        return [np.sqrt(squares[:, s:].sum(axis=1)) * (1 + 1e-12) for s in self.starts]

    def search(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if not len(ids):
            return
        if vectors.dtype != self.vectors.dtype:  # one side needs Python's integers, so both take them
            vectors, self.vectors = whole(vectors), whole(self.vectors)
        columns = np.ascontiguousarray(vectors.T)  # vertical: a dimension's numbers lie together
        if vectors.dtype == object:  # no bounds in floating point there
            for q, vector in enumerate(self.vectors):
                self.offer(q, ids, vector @ columns if len(columns) else np.zeros(len(ids)))
            return
        mass = self.remaining(vectors)
        for q0 in range(0, len(self.ids), QUERY_ROWS):
            queries = slice(q0, min(q0 + QUERY_ROWS, len(self.ids)))
            if not self.starts:
                for q in range(queries.start, queries.stop):
                    self.offer(q, ids, np.zeros(len(ids)))
                continue
            # The first block for some queries at once; then each query goes on with its survivors.
            first = self.vectors[queries, : self.step] @ columns[: self.step]
            for q in range(queries.start, queries.stop):
                partial, alive = first[q - q0], None
                for b in range(len(self.starts)):
                    if b:
                        dims = slice(self.starts[b], self.starts[b] + self.step)
                        partial = partial + self.vectors[q, dims] @ columns[dims][:, alive]
                    if b + 1 < len(self.starts):
                        rest = mass[b + 1] if alive is None else mass[b + 1][alive]
                        most = partial + self.mass[b + 1][q] * rest
                    else:
                        most = partial
                    keep = np.flatnonzero(most >= self.floor[q] - 1e-6 * abs(self.floor[q]))
                    alive, partial = keep if alive is None else alive[keep], partial[keep]
                    if not len(alive):
                        break
                if len(alive):
                    self.offer(q, ids[alive], partial)

    def offer(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge into the query's best k, best score first, ties to smaller ids."""
        other = ids != self.ids[q]
        if scores.dtype == object:
            found = [(-min(max(int(s), LEAST), MOST), int(i)) for s, i in zip(scores[other], ids[other], strict=True)]
        else:
            ids, scores = ids[other], scores[other]
            if len(ids) > self.k:  # no full sort of many
                edge = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
                ids, scores = ids[scores >= edge], scores[scores >= edge]
            found = [(-int(s), int(i)) for s, i in zip(scores, ids, strict=True)]
        self.best[q] = sorted(self.best[q] + found)[: self.k]
        if len(self.best[q]) == self.k and self.vectors.dtype != object:
            self.floor[q] = max(self.floor[q], -self.best[q][-1][0])


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def block_pass(candidates: DataFrame, ids: list, rows: list, width: int, k: int, scale: int, sample: list) -> DataFrame:
    """(query_id, vec_id, score): per task the best k candidates of each query of one block that reach its threshold."""
    vectors = integers(rows, width, scale)
    start = Block(np.array(ids, np.int64), vectors, k, np.full(len(ids), -np.inf))
    start.search(np.array([r["vec_id"] for r in sample], np.int64), integers([r["x"] for r in sample], width, scale))
    sent = candidates.sparkSession.sparkContext.broadcast((start.ids, start.vectors, start.floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(sent.value[0], sent.value[1], k, sent.value[2])
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATE_ROWS):
                part = batch.slice(at, CANDIDATE_ROWS)
                vectors = integers(part.column(1).to_pylist(), width, scale)
                block.search(part.column(0).to_numpy(), vectors)
        rows = [(int(q), i, -s) for q, best in zip(block.ids, block.best, strict=True) for s, i in best]
        for at in range(0, len(rows), 1 << 16):
            columns = zip(*rows[at : at + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=FOUND)

    return candidates.mapInArrow(run, "query_id long, vec_id long, score long")


def search_top_k(
    vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, block_bytes: int = BLOCK_BYTES, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` that ``is_query`` holds for, its k best others.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id.
    """
    candidates = usable(vectors)
    queries = candidates.where(is_query).groupBy("vec_id").agg(F.min("x").alias("x"))
    width, count = candidates.agg(F.max(F.size("x"))).first()[0] or 0, queries.count()
    blocks = max(1, -(-count * max(width, 1) * 8 // block_bytes))
    sample = candidates.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()
    found = None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect()
        part = block_pass(candidates, [r["vec_id"] for r in block], [r["x"] for r in block], width, k, scale, sample)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@register(
    "op7_exact_topk",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS f FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.f, c.f)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
    )
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
    FROM s QUALIFY rank <= 20
    """,
)
def op7_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best others of every twentieth vector."""
    return search_top_k(read_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)
