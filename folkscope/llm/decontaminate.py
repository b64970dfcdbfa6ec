"""Benchmark decontamination with an FM-index per training shard.

The words of a shard's documents are numbered by the benchmark's vocabulary, every other
word being one and the same separator, and the number sequence is indexed: suffix array,
Burrows-Wheeler transform, a wavelet matrix over it for ranks (Claude and Navarro, 2012),
and sampled suffix positions (Ferragina and Manzini, 2000). Every window of a benchmark
item is searched backwards through the ranks, all windows at once; occurrences are located
by stepping to the next sampled position. Located spans are merged per document.

A run of benchmark words that is shorter than the shortest window cannot hold one, so such
runs become separators too, and neighbouring separators one; nothing else is left out.

The benchmark is a stated set of texts. It goes to the tasks in blocks of at most
``BLOCK_BYTES``, one pass over the documents for each, and only the passes' small results
are shuffled, and only if there is more than one. A shard is what a task has read, indexed
``SHARD_WORDS`` words at a time; a longer document is indexed by itself.

Defined cases: null or empty texts have no words; rows that repeat a doc_id are documents
each; items of equal id count once, with the windows of all their texts; a null item_id
takes part and is listed as ``null``; an item without words is never found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folkscope.llm.registry import read_table, register
from folkscope.session import materialise

WINDOW = 10
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 8 << 20  # of benchmark text sent to all tasks at once
SAMPLE_EVERY = 16
PACKED = 4  # numbers that the first sort takes together

#: Words are ASCII letters and digits, A-Z lowered, and everything beyond ASCII; the other characters part them.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(data: bytes) -> list[bytes]:
    return data.translate(WORD_TABLE).split()


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes: a first sort by some numbers together, then prefix doubling.

    The text's last number is 0 and occurs nowhere else. Only suffixes that are not yet
    told apart are sorted again.
    """
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    depth = max(1, min(PACKED, 62 // bits))
    key = text.astype(np.int64)
    padded = np.concatenate([key, np.zeros(depth, np.int64)])
    for k in range(1, depth):
        key = (key << bits) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    first = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    rank = np.empty(n, np.int64)
    head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = head
    while True:
        # Places whose suffix shares its rank with a neighbour.
        tied = ~(first & np.concatenate([first[1:], [True]]))
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        items = order[places]
        after = rank[np.minimum(items + depth, n - 1)]
        by = np.lexsort((after, head[places]))
        items, after, group = items[by], after[by], head[places]
        order[places] = items
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        first[places] = new
        head[places] = np.maximum.accumulate(np.where(new, places, 0))
        rank[items] = head[places]
        depth *= 2


class WaveletMatrix:
    """Ranks over a sequence of numbers: how many of a number stand before a place, one bit level at a time."""

    def __init__(self, values: np.ndarray):
        self.levels = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, number: np.ndarray, place: np.ndarray) -> np.ndarray:
        """For each pair, the occurrences of the number before the place."""
        low, high = np.zeros_like(place), place
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            up = ((number >> level) & 1).astype(bool)
            a, b = self.ones[k][low], self.ones[k][high]
            low, high = np.where(up, self.zeros[k] + a, low - a), np.where(up, self.zeros[k] + b, high - b)
        return high - low


class FMIndex:
    """Counts and locates phrases in a sequence of numbers that ends in a single 0."""

    def __init__(self, text: np.ndarray):
        order = suffix_array(text)
        self.text_bwt = text[order - 1]  # before the first position stands the last
        self.tree = WaveletMatrix(self.text_bwt)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.is_sampled = order % SAMPLE_EVERY == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.is_sampled, dtype=np.int64)])
        self.samples = order[self.is_sampled]
        self.n = len(text)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase; row k holds its numbers, right-aligned."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        width = phrases.shape[1]
        for column in range(width - 1, -1, -1):
            live = np.flatnonzero((width - column <= lengths) & (low < high))
            if not len(live):
                break
            number = phrases[live, column]
            known = number < len(self.before) - 1
            low[live[~known]] = high[live[~known]] = 0
            live, number = live[known], number[known]
            low[live] = self.before[number] + self.tree.rank(number, low[live])
            high[live] = self.before[number] + self.tree.rank(number, high[live])
        return low, np.maximum(low, high)

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Text positions of places in suffix order: step back through the text until one is sampled."""
        places, steps = places.copy(), np.zeros(len(places), np.int64)
        open_ = np.flatnonzero(~self.is_sampled[places])
        while len(open_):
            at = places[open_]
            number = self.text_bwt[at]
            places[open_] = self.before[number] + self.tree.rank(number, at)
            steps[open_] += 1
            open_ = open_[~self.is_sampled[places[open_]]]
        return self.samples[self.sample_rank[places]] + steps


class Phrases:
    """The distinct windows of benchmark items, as numbers over their vocabulary, from 2 on; 1 is the separator."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item_id, data in items:
            numbers = tuple(self.number.setdefault(w, len(self.number) + 2) for w in words_of(data))
            size = min(window, len(numbers))
            for k in range(len(numbers) - size + 1 if size else 0):
                found.setdefault(numbers[k : k + size], set()).add("null" if item_id is None else str(item_id))
        self.items = [sorted(names) for names in found.values()]
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.shortest = int(self.lengths.min()) if len(found) else 0
        self.table = np.zeros((len(found), window), np.int64)
        for row, phrase in zip(self.table, found, strict=True):
            row[window - len(phrase) :] = phrase


def hits_in(phrases: Phrases, documents: list[np.ndarray]) -> list[tuple[np.ndarray, set[str]]]:
    """For each document, given as numbers, the merged hit spans (begin, end by row) and the items found."""
    nothing = np.zeros((0, 2), np.int64)
    out: list[tuple[np.ndarray, set[str]]] = [(nothing, set()) for _ in documents]
    if not documents or not phrases.shortest:
        return out
    # Documents in a row, each followed by a separator; then short runs become separators, and neighbours one.
    lengths = np.array([len(d) for d in documents])
    start = np.cumsum(lengths + 1) - lengths - 1
    whole = np.ones(int((lengths + 1).sum()), np.int64)
    for at, document in zip(start, documents, strict=True):
        whole[at : at + len(document)] = document
    known = whole > 1
    edge = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2]
    keep = end - begin >= phrases.shortest
    begin, end = begin[keep], end[keep]
    if not len(begin):
        return out
    size = end - begin + 1  # with a separator
    offset = np.cumsum(size) - size
    origin = np.arange(int(size.sum())) + np.repeat(begin - offset, size)  # the last of each run is what follows it, a separator
    text = np.concatenate([whole[origin], [0]])
    text[offset + size - 1] = 1
    index = FMIndex(text)
    low, high = index.search(phrases.table, phrases.lengths)
    count = high - low
    phrase = np.repeat(np.arange(len(count)), count)
    if not len(phrase):
        return out
    places = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    position = origin[index.locate(places)]
    owner = np.searchsorted(start, position, side="right") - 1
    by = np.lexsort((position, owner))
    position, owner, phrase = position[by], owner[by], phrase[by]
    spans = np.stack([position, position + phrases.lengths[phrase]], axis=1)
    for part in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1):
        d = int(owner[part[0]])
        inside = spans[part]
        furthest = np.maximum.accumulate(inside[:, 1])
        new = np.concatenate([[True], inside[1:, 0] > furthest[:-1]])
        last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(part) - 1]])
        merged = np.stack([inside[new, 0], furthest[last]], axis=1) - start[d]
        out[d] = merged, {name for p in set(phrase[part].tolist()) for name in phrases.items[p]}
    return out


SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
FOUND = pa.schema([("row_id", pa.string()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", SPANS), ("items", pa.list_(pa.string()))])
FOUND_DDL = "row_id string, doc_id long, n_words long, spans array<struct<begin long, end long>>, items array<string>"


def search_pass(docs: DataFrame, items: list[tuple[int | None, bytes]], window: int, with_row_id: bool) -> DataFrame:
    """One pass: (row_id, doc_id, n_words, spans of hit words, items) for a block of the benchmark."""
    sent = docs.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_BYTES, or one item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(sent.value, window)
        number = phrases.number.get

        def flush(names: list, documents: list[np.ndarray]) -> pa.RecordBatch:
            rows = []
            for (row_id, doc_id), numbers, (spans, found) in zip(names, documents, hits_in(phrases, documents), strict=True):
                pairs = [{"begin": a, "end": b} for a, b in spans.tolist()]
                rows.append({"row_id": row_id, "doc_id": doc_id, "n_words": len(numbers), "spans": pairs, "items": sorted(found)})
            return pa.RecordBatch.from_pylist(rows, FOUND)

        names: list[tuple[str | None, int | None]] = []
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            for row_id, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                words = words_of(text.as_py() or b"")
                numbers = np.array([number(w, 1) for w in words], np.int64)
                if held and size + len(numbers) > SHARD_WORDS:
                    yield flush(names, held)
                    names, held, size = [], [], 0
                names.append((row_id, doc_id))
                held.append(numbers)
                size += len(numbers)
        if held:
            yield flush(names, held)

    row_id = F.col("row_id") if with_row_id else F.lit(None).cast("string").alias("row_id")
    return docs.select(row_id, "doc_id", "text").mapInArrow(run, FOUND_DDL)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items) for each row of ``docs`` (doc_id, text) against ``benchmark`` (item_id, text).

    ``spans``: merged, half-open spans of hit words, in order; ``items``: the ids found, as strings, in order.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    if blocks > 1:  # rows need a name to bring the passes' results together
        docs = materialise(docs.withColumn("row_id", F.expr("uuid()")), "decontaminate-rows")
    found = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        part = search_pass(docs, [(r["item_id"], r["text"].encode()) for r in rows], window, blocks > 1)
        found = part if found is None else found.unionByName(part)
    if blocks == 1:
        return found.drop("row_id")
    merged = F.expr(
        """aggregate(array_sort(flatten(all_spans)), cast(array() as array<struct<begin bigint, end bigint>>), (acc, s) ->
        if(size(acc) > 0 and element_at(acc, -1).end >= s.begin,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('begin', element_at(acc, -1).begin, 'end', greatest(element_at(acc, -1).end, s.end)))),
           concat(acc, array(s))))"""
    )
    together = found.groupBy("row_id", "doc_id", "n_words").agg(F.collect_list("spans").alias("all_spans"), F.collect_list("items").alias("all_items"))
    return together.select("doc_id", "n_words", merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten("all_items"))).alias("items"))


@register("op2_decontaminate")
def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Every document against every benchmark item."""
    found = find_contamination(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def cut_words(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the given spans of words: what lies from a span's first word to its last goes."""
    if not spans:
        return data
    plain = data.translate(WORD_TABLE)
    starts = np.frombuffer(plain, np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], starts.view(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2]
    parts, at = [], 0
    for a, b in spans:
        parts.append(data[at : begin[a]])
        at = int(end[b - 1])
    return b"".join([*parts, data[at:]])


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
