"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

A word goes if a window of 50 consecutive words that covers it also starts in a document
with a smaller doc_id. Windows are found in four steps.

1. Anchors. Of the word 8-grams in every window the one with the least hash is its anchor
   (winnowing: Schleimer et al., 2003), so equal windows have equal anchors, and two windows
   of different documents can only be equal if their anchor stands in both.
2. Routing. An anchor that stands in one document only is dropped. The others are named by
   the place where they stand in the first document that has them, rounded to a slab of
   words: all text around anchors of one slab goes to one reference block. What lies around
   neighbouring anchors of the same slab travels once.
3. Parsing. A task indexes the passages of its blocks, each distinct one once with its
   smallest doc_id, as a suffix array to the depth of a window. Every passage
   is then factored greedily: at a place whose 50 words also stand in a smaller document the
   factor follows that document's text as far as both agree. The last 49 windows that begin
   in a factor reach over its end, so they are looked up by themselves.
4. Removal. Spans are merged per document and cut from its text.

What lies around an anchor with more than ``CROWDED`` occurrences has a block of its own.
One with more than ``HOT`` would make a block too large for a task. Its windows go by
themselves: a 128-bit hash per distinct window of a document, with all its places there, so
that a line which a document repeats hundreds of times sends a few rows and not one per
place. The smallest doc_id of a hash is found with partial aggregation. So a passage that a
third of all documents share is no burden for any one task, and nothing is left out. Both
limits bound a block: some 23 anchors stand in a slab of 512 words, and 92 words lie around an
anchor, so it holds about 2.2 million words at most, which take a task some 400 MB.

Defined cases: a null text has no words; rows that repeat a doc_id are documents that do
not count as smaller than each other; a null doc_id counts as larger than any other, and
such rows do not count against each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folkscope.llm.registry import read_table, register
from folkscope.session import materialise, scratch_path

WINDOW = 50
GRAM = 8
CROWDED = 700  # occurrences of an anchor after which it leaves its slab's block
HOT = 24_000
SLAB_WORDS = 512
BLOCK_WORDS = 1 << 19  # words after which a task closes a batch of whole blocks
CACHE_WORDS = 1 << 19
LAST = (1 << 63) - 1  # stands for a null doc_id


class WordHashes:
    """A 64-bit hash per word, the same in every task; what was hashed before is looked up."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh64_intdigest(word, 11)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def run_hashes(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A hash of every run of ``size`` words: polynomials of powers of two in length, joined."""
    total, done, power, length, scale = None, 0, words, 1, np.uint64(seed | 1)
    while True:
        if size & length:
            part = power[done : done + len(words) - size + 1]
            total = part.copy() if total is None else total * scale + part
            done += length
        if length * 2 > size:
            return mixed(total)
        power = power[: len(power) - length] * scale + power[length:]
        scale = np.uint64(int(scale) ** 2 % (1 << 64))
        length *= 2


def sliding(values: np.ndarray, size: int, take) -> np.ndarray:
    """The least (or greatest) of every ``size`` neighbours, by doubling."""
    length, out = 1, values
    while length * 2 <= size:
        out = take(out[: len(out) - length], out[length:])
        length *= 2
    rest = size - length
    return take(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the 8-grams that are the least in some window."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = run_hashes(words, gram, 0x9E3779B97F4A7C15)
    width = window - gram + 1
    least = sliding(grams, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    # A gram is chosen if it equals the least of some window that holds it, which is never more than itself.
    highest = sliding(np.concatenate([edge, least, edge]), width, np.maximum)
    place = np.flatnonzero(highest == grams)
    return place, grams[place]


ANCHORS = "anchor long, doc_id long, tag long, place int"


def find_anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, doc_id, tag, place) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = []
            for doc_id, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), strict=True):
                words = (text.as_py() or b"").split()
                if len(words) >= window:
                    places, grams = anchors(hashes.of(words), window, gram)
                    found.append((grams.view(np.int64), np.full(len(places), doc_id), np.full(len(places), tag), places.astype(np.int32)))
            if found:
                columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "doc_id", "tag", "place"])

    return docs.select("doc_id", "tag", "text").mapInArrow(run, ANCHORS)


def passages(places: np.ndarray, keys: np.ndarray, n_words: int, window: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """(key, begin, end): the words that windows with these anchors reach, joined where anchors of a key follow each other."""
    before, after = window - gram, window
    order = np.lexsort((places, keys))
    places, keys = places[order], keys[order]
    begin, end = np.maximum(places - before, 0), np.minimum(places + after, n_words)
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (begin[1:] > end[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(places) - 1]])
    yield from zip(keys[first].tolist(), begin[first].tolist(), end[last].tolist(), strict=True)


def spans_of_windows(one: np.ndarray, two: np.ndarray, starts: np.ndarray, window: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(hash, second hash, spans) of every distinct window that begins at one of these places: the words that its places cover, merged."""
    a, b = one[starts], two[starts]
    order = np.lexsort((starts, b, a))
    starts, a, b = starts[order], a[order], b[order]
    other = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    apart = other | np.concatenate([[True], starts[1:] > starts[:-1] + window])
    begin, last = starts[apart], np.flatnonzero(np.concatenate([apart[1:], [True]]))
    spans = list(zip(begin.tolist(), (starts[last] + window).tolist(), strict=True))
    first = np.flatnonzero(other[apart])
    for i, j, k in zip(first.tolist(), [*first[1:].tolist(), len(spans)], np.flatnonzero(other).tolist(), strict=True):
        yield int(a[k]), int(b[k]), spans[i:j]


SENT = "key long, check long, doc_id long, tag long, begin int, words int, text binary, spans array<struct<begin:long,end:long>>"
SENT_ARROW = pa.schema([
    ("key", pa.int64()), ("check", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()),
    ("begin", pa.int32()), ("words", pa.int32()), ("text", pa.binary()),
    ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
])


def cut_passages(marked: DataFrame, window: int, gram: int) -> DataFrame:
    """The passages of every document for its blocks, with their text, and its distinct windows at hot anchors, as hashes with their places.

    ``marked`` has doc_id, tag, text and marks: (place, key, hot).
    """

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), SENT_ARROW, strict=True)], schema=SENT_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            ids, tags, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary())
            for doc_id, tag, text, marks in zip(ids, tags, texts, batch.column(3), strict=True):
                words = (text.as_py() or b"").split()
                marks = marks.values
                places, keys = marks.field(0).to_numpy().astype(np.int64), marks.field(1).to_numpy()
                hot = marks.field(2).to_numpy(zero_copy_only=False)
                if not hot.all():
                    for key, begin, end in passages(places[~hot], keys[~hot], len(words), window, gram):
                        piece = b" ".join(words[begin:end])
                        rows.append((key, None, doc_id, tag, begin, end - begin, piece, None))
                        size += len(piece)
                if hot.any():
                    numbers = hashes.of(words)
                    one, two = (run_hashes(numbers, window, seed).view(np.int64) for seed in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
                    starts = (places[hot][:, None] - np.arange(window - gram + 1)).ravel()
                    starts = np.unique(starts[(starts >= 0) & (starts < len(one))])
                    if len(starts):
                        rows += [(a, b, doc_id, tag, None, None, None, [{"begin": x, "end": y} for x, y in at]) for a, b, at in spans_of_windows(one, two, starts, window)]
                if size > 1 << 24 or len(rows) > 1 << 16:
                    yield packed(rows)
                    rows, size = [], 0
            if rows:
                yield packed(rows)

    return marked.select("doc_id", "tag", "text", "marks").mapInArrow(run, SENT)


class ReferenceBlock:
    """Distinct passages, each with its smallest document, as one text with a suffix array over it."""

    def __init__(self, texts: Iterable[bytes], sizes: np.ndarray, owners: np.ndarray, window: int):
        number: dict[bytes, int] = {}
        self.start = np.cumsum(sizes + 1) - sizes - 1
        self.text = np.zeros(int((sizes + 1).sum()), np.int64)
        for at, size, text in zip(self.start, sizes, texts, strict=True):
            self.text[at : at + size] = [number.setdefault(w, len(number) + 1) for w in text.split(b" ")]
        self.end = self.start + sizes
        # Each passage ends in a number of its own, so no match reaches over an end.
        self.text[self.end] = len(number) + 1 + np.arange(len(sizes))
        self.owner = np.repeat(owners, sizes + 1)
        order, same = windows_in_order(self.text, window)
        group = np.cumsum(~same) - 1
        firsts = np.flatnonzero(~same)
        # Per group of equal windows, the smallest document and a place where it has the window.
        least = np.minimum.reduceat(self.owner[order], firsts)
        holds = np.flatnonzero(self.owner[order] == least[group])
        place = np.zeros(len(firsts), np.int64)
        place[group[holds][::-1]] = order[holds][::-1]
        self.earliest, self.source = np.empty(len(self.text), np.int64), np.empty(len(self.text), np.int64)
        self.earliest[order], self.source[order] = least[group], place[group]
        self.window = window

    def factors(self, k: int) -> list[tuple[int, int]]:
        """Spans of passage k that stand in a smaller document, by a greedy parse with its factor ends checked."""
        begin, end, window = int(self.start[k]), int(self.end[k]), self.window
        known = np.flatnonzero(self.earliest[begin : end - window + 1] < self.owner[begin]) + begin if end - begin >= window else []
        spans, at, i = [], begin, 0
        while i < len(known):
            at = int(known[i])
            source = int(self.source[at])
            room = end - at
            ahead = self.text[source + window : source + room]
            differs = np.flatnonzero(ahead != self.text[at + window : at + window + len(ahead)])
            length = window + (int(differs[0]) if len(differs) else len(ahead))
            spans.append((at - begin, at - begin + length))
            # Windows that begin within the factor and end in it are covered; the next to look up reaches over its end.
            i = int(np.searchsorted(known, at + length - window + 1))
        return spans


def windows_in_order(text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """A suffix array to the depth of a window, and which places have the same window as the one before.

    Ranks of runs of 1, 2, 4, ... numbers, by sorting pairs of half as long ones; a window
    is covered by two of the longest. Places whose window reaches over a passage's end have
    that end's own number in it and so equal no other.
    """
    rank, length = text, 1

    def moved(by: int) -> np.ndarray:
        return np.concatenate([rank[by:], np.zeros(min(by, len(rank)), np.int64)])

    while length * 2 <= window:
        _, rank = np.unique(rank * (int(rank.max()) + 1) + moved(length), return_inverse=True)
        length *= 2
    pair = rank * (int(rank.max()) + 1) + moved(window - length)
    order = np.argsort(pair, kind="stable")
    return order, np.concatenate([[False], pair[order[1:]] == pair[order[:-1]]])


SPANS = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])


def parse_blocks(sent: DataFrame, window: int) -> DataFrame:
    """(doc_id, tag, begin, end): duplicate spans of all passages, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            """Rows (doc_id, tag, begin, words, text) of whole blocks; equal passages are parsed once, for their smallest document."""
            place: dict[bytes, int] = {}
            kind = [place.setdefault(r[4], len(place)) for r in rows]
            owners = np.full(len(place), LAST, np.int64)
            np.minimum.at(owners, kind, [r[0] for r in rows])
            sizes = np.zeros(len(place), np.int64)
            sizes[kind] = [r[3] for r in rows]
            block = ReferenceBlock(place, sizes, owners, window)
            found = [block.factors(k) for k in range(len(place))]
            out: list[tuple[int, int, int, int]] = []
            for (doc_id, tag, begin, words, _), k in zip(rows, kind, strict=True):
                # In a larger document than the passage's smallest, all of it stands in a smaller one.
                spans = found[k] if doc_id == owners[k] else [(0, words)]
                out += [(doc_id, tag, begin + a, begin + b) for a, b in spans]
            columns = zip(*out, strict=True) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=SPANS)

        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for key, doc_id, tag, begin, words, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last and size >= BLOCK_WORDS:
                    yield flush(held)
                    held, size = [], 0
                held.append((doc_id, tag, begin, words, text))
                size, last = size + words, key
        if held:
            yield flush(held)

    ordered = sent.select("key", "doc_id", "tag", "begin", "words", "text").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "doc_id long, tag long, begin long, end long")


REMOVED = "doc_id long, n_words long, n_removed long, kept string"
REMOVED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def merge_spans(spans: np.ndarray) -> list[tuple[int, int]]:
    if not len(spans):
        return []
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    furthest = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > furthest[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])
    return list(zip(spans[new, 0].tolist(), furthest[last].tolist(), strict=True))


def duplicate_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowded: int = CROWDED, hot: int = HOT, slab: int = SLAB_WORDS) -> DataFrame:
    """(doc_id, tag, spans) with begin and end in words, unmerged: where a document repeats a smaller one.

    ``docs`` has doc_id and tag, not null, and text; the two name a row.
    """
    found = materialise(find_anchors(docs, window, gram), "anchors")
    shared = (
        found.groupBy("anchor")
        .agg(F.min(F.struct("doc_id", "place")).alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
        .where("first.doc_id < last")
        .select(
            F.col("anchor").alias("shared_anchor"),
            F.when(F.col("n") > crowded, F.xxhash64("anchor"))
            .otherwise(F.xxhash64("first.doc_id", F.floor(F.col("first.place") / slab)))
            .alias("key"),
            (F.col("n") > hot).alias("hot"),
        )
    )
    # Written first: the join then has a plain shuffle on either side, and AQE can split what one anchor fills.
    shared = materialise(shared, "shared-anchors")
    marks = (
        found.join(shared, F.col("anchor") == F.col("shared_anchor"))
        .groupBy(F.col("doc_id").alias("marked_id"), F.col("tag").alias("marked_tag"))
        .agg(F.collect_list(F.struct("place", "key", "hot")).alias("marks"))
    )
    marked = docs.join(marks, (F.col("doc_id") == F.col("marked_id")) & (F.col("tag") == F.col("marked_tag")))
    path = scratch_path(docs.sparkSession, "passages")
    cut_passages(marked, window, gram).write.option("compression", "zstd").parquet(path)
    sent = docs.sparkSession.read.schema(SENT).parquet(path)

    by_block = parse_blocks(sent.where("text is not null"), window)
    windows = sent.where("text is null").select("key", "check", "doc_id", "tag", "spans")
    least = windows.groupBy("key", "check").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    # Written first, as the anchors above: a window that very many documents share is split over tasks.
    least = materialise(least.select(F.col("key").alias("k"), F.col("check").alias("c"), "least"), "least-documents")
    by_window = windows.join(least, (F.col("key") == F.col("k")) & (F.col("check") == F.col("c")) & (F.col("doc_id") > F.col("least")))
    return by_block.select("doc_id", "tag", F.array(F.struct("begin", "end")).alias("spans")).unionByName(by_window.select("doc_id", "tag", "spans"))


def remove_duplicates(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowded: int = CROWDED, hot: int = HOT, slab: int = SLAB_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of ``docs`` (doc_id, text)."""
    text = F.col("text").cast("string")
    # Rows that repeat a doc_id are told apart by their text.
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    spans = duplicate_spans(docs, window, gram, crowded, hot, slab)
    spans = spans.groupBy(F.col("doc_id").alias("cut_id"), F.col("tag").alias("cut_tag")).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    cut = docs.join(spans, (F.col("doc_id") == F.col("cut_id")) & (F.col("tag") == F.col("cut_tag")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts = batch.column(1).cast(pa.large_binary())
            for doc_id, text, spans in zip(batch.column(0).to_pylist(), texts, batch.column(2), strict=True):
                words = (text.as_py() or b"").split()
                kept, at = [], 0
                if spans.is_valid:
                    pairs = np.stack([spans.values.field(0).to_numpy(), spans.values.field(1).to_numpy()], axis=1)
                    for begin, end in merge_spans(pairs):
                        kept += words[at:begin]
                        at = end
                kept += words[at:]
                rows.append((None if doc_id == LAST else doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode()))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, REMOVED_ARROW, strict=True)], schema=REMOVED_ARROW)

    return cut.mapInArrow(run, REMOVED)


@register("op4_substring_dedup")
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the windows that it repeats from smaller ones."""
    out = remove_duplicates(read_table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def kept_digest(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode()).hexdigest()
