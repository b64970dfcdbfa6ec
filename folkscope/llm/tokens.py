"""Token ids in binary files, coded by a static range asymmetric numeral system.

Every document is encoded by a given tokenizer, in ascending order of doc_id, and closed
with an end id. One frequency table over all ids is shared by all files (Duda, "Asymmetric
numeral systems", 2013). Ids are coded in blocks of whole documents; a block is dealt over
``LANES`` interleaved coders, so that one step codes a row of ids at once, and carries its
documents' lengths, the coders' states, checkpoints and a CRC. Blocks are independent of
each other, and a block can be entered at each of its checkpoints.

File layout, little-endian. A block: magic, number of documents, ids, words, rows between
checkpoints, CRC-32 of the ids; per document its doc_id, a flag for a null id, and its
number of ids; then per checkpoint the word offset and all states; then the words. A file:
its blocks one after the other; a committed index names file, offset and length of each.

Defined cases: a null text is an empty one and gives the end id only; a null doc_id comes
first; rows that repeat a doc_id are documents each, ordered by their ids' bytes.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folkscope.llm.files import attempt_file, create, open_input
from folkscope.llm.registry import read_table, register
from folkscope.session import scratch_path

END_ID = 2
PROBABILITY_BITS = 20
LOW = np.uint64(1 << 31)  # states lie in [LOW, LOW << 32); words of 32 bits move out and in
LANES = 1024
BLOCK_IDS = 1 << 19
CHECKPOINT_ROWS = 128
MAGIC = 0x31534E52  # "RNS1"
HEADER = "<IIIIII"
CACHE_PIECES = 1 << 19
CACHE_CHARS = 1 << 25
TOGETHER = 256  # pieces handed to the tokenizer at once
GATHER_WORDS = 1 << 18

# The settings of a tokenizer under which a text may be encoded piece by piece.
END_OF_WORD = "</w>"
SPECIAL = "<|"  # how its special tokens begin
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KNOWN_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
KNOWN_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": SPLIT_PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# The same pattern for characters that normalising leaves alone but for A-Z and the like: ASCII, Latin-1, some marks.
WHITE = "\\x09-\\x0d\\x20"
PLAIN = "\\x21-\\x7e\\xa1-\\xff\\u2010-\\u2027\\u20ac"
LETTERS, NUMBERS = "a-z\\xaa\\xb5\\xba\\xdf-\\xf6\\xf8-\\xff", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
PIECE = f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{WHITE}{LETTERS}{NUMBERS}]+"


class TextEncoder:
    """Encodes whole texts through the tokenizer, each distinct piece of text once.

    Where the tokenizer's settings are the known ones, no token crosses from one piece to
    the next, so a text's ids are those of its pieces one after the other, and every piece
    ends in a token with the end-of-word suffix, by which pieces that are encoded together
    are told apart. Such pieces are split and lowered already, so they pass a tokenizer of the
    same model without these steps. What a piece gives is kept while the cache has room; a
    full cache starts anew. Words with characters beyond ``PLAIN``, whose splitting rules are the
    tokenizer's alone, are pieces as they stand. With other settings texts go to the
    tokenizer as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        self.in_pieces = (
            made["normalizer"] == KNOWN_NORMALIZER
            and made["pre_tokenizer"] == KNOWN_SPLITTER
            and made["post_processor"] is None
            and made["model"]["end_of_word_suffix"] == END_OF_WORD
            and all(t["content"].startswith(SPECIAL) and not t["lstrip"] and not t["rstrip"] for t in made["added_tokens"])
        )
        if self.in_pieces:
            self.plain, self.piece = re.compile(f"[{PLAIN}]+"), re.compile(f"{PIECE}|\\x20")
            self.all_plain = "^" + re.sub(r"\\u(....)", r"\\x{\1}", self.plain.pattern) + "$"  # as Arrow writes it
            bytes_only = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
            made |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, bytes_only]}}
            self.of_pieces = Tokenizer.from_str(json.dumps(made))
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(END_OF_WORD)]] = True
            self.reset()

    def reset(self) -> None:
        self.place: dict[str, int] = {" ": -1}  # the blank stands between words
        self.known = 0
        self.held = 0  # characters of the kept pieces
        self.ids = np.zeros(1 << 16, np.uint32)  # of all kept pieces, one after the other
        self.bounds = np.zeros(1 << 14, np.int64)  # where those of each piece begin and end

    def split(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The places of the pieces of all words, one word after the other, and how many each word has.

        All plain words are split at once, with a blank between them that tells where one ends.
        """
        plain = pc.match_substring_regex(words, self.all_plain)
        plain = pc.and_not(plain, pc.match_substring(words, SPECIAL))
        at = plain.to_numpy(zero_copy_only=False)
        found = self.piece.findall(" ".join(words.filter(plain).to_pylist()).lower())
        other = words.filter(pc.invert(plain)).to_pylist()
        known = self.place
        fresh = set(found).difference(known)
        fresh.discard(" ")
        self.learn(list(fresh), list(set(filter(None, other)).difference(known, fresh)))
        places = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
        ends = np.append(np.flatnonzero(places < 0), len(found)) if at.any() else np.zeros(0, np.int64)
        counts = np.zeros(len(words), np.int64)
        counts[at] = np.diff(ends, prepend=-1) - 1
        places = places[places >= 0]
        whole = np.flatnonzero(~at)
        if len(whole):  # each of the others is a piece of its own, an empty one none
            counts[whole] = [1 if word else 0 for word in other]
            out = np.empty(int(counts.sum()), np.int64)
            mine = np.repeat(~at, counts)
            out[mine], out[~mine] = [known[word] for word in other if word], places
            places = out
        return places, counts

    def learn(self, pieces: list[str], other: list[str]) -> None:
        """Encode and keep new pieces: of plain words, many together; and words that the tokenizer itself must split."""
        for k in range(0, len(pieces), TOGETHER):
            part = pieces[k : k + TOGETHER]
            ids = np.array(self.of_pieces.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the tokenizer split pieces further than its settings say")
            self.keep(part, ids, ends)
        for word in other:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32)
            self.keep([word], ids, np.array([len(ids)]))

    def keep(self, pieces: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        known = self.known
        begin = int(self.bounds[known])
        while len(self.bounds) <= known + len(pieces):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        while len(self.ids) < begin + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[begin : begin + len(ids)] = ids
        self.bounds[known + 1 : known + 1 + len(pieces)] = begin + ends
        self.place.update(zip(pieces, range(known, known + len(pieces)), strict=True))
        self.known = known + len(pieces)
        self.held += sum(map(len, pieces))

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; a null text is an empty one."""
        if not self.in_pieces:
            for text in texts.to_pylist():
                yield np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, np.uint32)
            return
        split = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        codes, bounds = coded.indices.to_numpy(), split.offsets.to_numpy()
        bounds = bounds - bounds[0]
        if self.known > CACHE_PIECES or self.held > CACHE_CHARS:
            self.reset()
        at, counts = self.split(coded.dictionary)
        ids, ends = gathered(self.ids, self.bounds[at], self.bounds[at + 1])  # of the distinct words' pieces
        ends = np.concatenate([[0], ends])
        last = np.cumsum(counts)
        begin, end = ends[last - counts], ends[last]  # of each distinct word
        first = 0
        while first < len(texts):  # some texts at a time
            stop = max(first + 1, int(np.searchsorted(bounds, bounds[first] + GATHER_WORDS, side="right")) - 1)
            words = codes[bounds[first] : bounds[stop]]
            out, out_ends = gathered(ids, begin[words], end[words])
            cuts = np.concatenate([[0], out_ends])[bounds[first : stop + 1] - bounds[first]]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield out[a:b]
            first = stop


def gathered(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all given ranges, one range after the other, and where each ends in what results."""
    count = end - begin
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(begin - (ends - count), count)], ends


def tokenizer_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return path


IDS = "doc_id long, n_tokens long, ids binary"
IDS_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def tokenize(docs: DataFrame, path: str | None, end_id: int, kind: np.dtype) -> DataFrame:
    """(doc_id, n_tokens, ids): every whole text's ids and the end id, as packed numbers of the given kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder = TextEncoder(tokenizer_path(path))
        for batch in batches:
            rows = []
            for ids in encoder.encode(batch.column(1)):
                out = np.empty(len(ids) + 1, kind)
                out[:-1], out[-1] = ids, end_id
                rows.append(out)
            columns = [batch.column(0), pa.array([len(r) for r in rows], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=IDS_ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, IDS)


def id_type(vocabulary: int):
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


def count_ids(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all documents; counted per task, so at most a vocabulary of rows leaves each."""
    kind = id_type(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(vocabulary, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), kind)
            count += np.bincount(ids, minlength=vocabulary)
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(count[seen])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(vocabulary, np.int64)
    for row in rows:
        count[row["id"]] = row["n"]
    return count


def shared_frequencies(count: np.ndarray, bits: int = PROBABILITY_BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 for each id that occurs; the difference goes to the most frequent."""
    total, room = int(count.sum()), 1 << bits
    if total == 0:
        return np.zeros(len(count), np.uint64)
    if np.count_nonzero(count) > room:
        raise ValueError("more ids than the table has room for")
    share = np.maximum((count.astype(float) * room / total).astype(np.int64), count > 0)
    over = int(share.sum()) - room
    order = np.argsort(-share, kind="stable")
    k = 0
    while over > 0:  # never below 1
        take = min(over, int(share[order[k]]) - 1)
        share[order[k]] -= take
        over, k = over - take, k + 1
    share[order[0]] -= over
    return share.astype(np.uint64)


class Coder:
    """Codes rows of ids on interleaved lanes, by a table shared by all blocks."""

    def __init__(self, frequencies: np.ndarray, bits: int = PROBABILITY_BITS, lanes: int = LANES):
        self.bits, self.lanes = np.uint64(bits), lanes
        self.frequency = frequencies.astype(np.uint64)
        ends = np.cumsum(self.frequency)
        self.start = ends - self.frequency
        self.ends = ends
        self.symbol = None

    def encode(self, ids: np.ndarray, checkpoint_rows: int = CHECKPOINT_ROWS) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """The words of one block in decoding order, and its checkpoints: (word offset, states), the first at row 0.

        The last row may be short; lanes beyond it do not move in that row.
        """
        rows = -(-len(ids) // self.lanes)
        state = np.full(self.lanes, LOW, np.uint64)
        groups: list[np.ndarray] = [np.zeros(0, np.uint32)] * rows
        points: list[tuple[int, np.ndarray]] = []
        shift = np.uint64(63) - self.bits
        for row in range(rows - 1, -1, -1):
            part = ids[row * self.lanes : (row + 1) * self.lanes]
            frequency, start, x = self.frequency[part], self.start[part], state[: len(part)]
            full = x >= frequency << shift
            groups[row] = x[full].astype(np.uint32)
            x = np.where(full, x >> np.uint64(32), x)
            whole = x // frequency
            state[: len(part)] = (whole << self.bits) + (x - whole * frequency) + start
            if row % checkpoint_rows == 0:
                points.append((row, state.copy()))
        offsets = np.concatenate([[0], np.cumsum([len(g) for g in groups])]).astype(np.int64)
        words = np.concatenate(groups) if groups else np.zeros(0, np.uint32)
        return words, [(int(offsets[row]), states) for row, states in reversed(points)]

    def decode(self, words: np.ndarray, states: np.ndarray, at: int, first: int, stop: int, total: int) -> np.ndarray:
        """Ids of rows first to stop, from a checkpoint at row ``first`` whose words begin at ``at``."""
        if self.symbol is None:
            self.symbol = np.repeat(np.arange(len(self.frequency), dtype=np.uint32), self.frequency.astype(np.int64))
        state, mask = states.copy(), np.uint64((1 << int(self.bits)) - 1)
        out = np.empty(max(0, min(stop * self.lanes, total) - first * self.lanes), np.uint32)
        for row in range(first, stop):
            n = min(self.lanes, total - row * self.lanes)
            x = state[:n]
            slot = x & mask
            ids = self.symbol[slot]
            out[(row - first) * self.lanes : (row - first) * self.lanes + n] = ids
            x = self.frequency[ids] * (x >> self.bits) + slot - self.start[ids]
            low = x < LOW
            need = int(np.count_nonzero(low))
            if need:
                x[low] = (x[low] << np.uint64(32)) | words[at : at + need].astype(np.uint64)
                at += need
            state[:n] = x
        return out


def pack_block(coder: Coder, docs: list[tuple[int | None, np.ndarray]], checkpoint_rows: int = CHECKPOINT_ROWS) -> bytes:
    ids = np.concatenate([ids for _, ids in docs]).astype(np.uint32)
    words, points = coder.encode(ids, checkpoint_rows)
    head = struct.pack(HEADER, MAGIC, len(docs), len(ids), len(words), checkpoint_rows, zlib.crc32(ids.astype("<u4").tobytes()))
    names = np.array([0 if d is None else d for d, _ in docs], "<i8").tobytes()
    flags = np.array([d is None for d, _ in docs], np.uint8).tobytes()
    lengths = np.array([len(i) for _, i in docs], "<u4").tobytes()
    states = b"".join(struct.pack("<I", offset) + state.astype("<u8").tobytes() for offset, state in points)
    return head + names + flags + lengths + states + words.astype("<u4").tobytes()


class BlockView:
    """A packed block, of which all ids or those from a checkpoint on can be decoded."""

    def __init__(self, coder: Coder, data: bytes):
        magic, docs, self.total, n_words, self.every, self.crc = struct.unpack_from(HEADER, data)
        if magic != MAGIC:
            raise ValueError("no block begins here")
        self.coder, at = coder, struct.calcsize(HEADER)
        names = np.frombuffer(data, "<i8", docs, at).tolist()
        flags = np.frombuffer(data, np.uint8, docs, at + 8 * docs).tolist()
        self.doc_ids = [None if f else n for n, f in zip(names, flags, strict=True)]
        self.lengths = np.frombuffer(data, "<u4", docs, at + 9 * docs).astype(np.int64)
        at += 13 * docs
        self.rows = -(-self.total // coder.lanes)
        self.points = []
        for _ in range(-(-self.rows // self.every)):
            self.points.append((struct.unpack_from("<I", data, at)[0], np.frombuffer(data, "<u8", coder.lanes, at + 4).astype(np.uint64)))
            at += 4 + 8 * coder.lanes
        self.words = np.frombuffer(data, "<u4", n_words, at)

    def part(self, point: int) -> np.ndarray:
        """The ids between a checkpoint and the next."""
        offset, states = self.points[point]
        first = point * self.every
        return self.coder.decode(self.words, states, offset, first, min(first + self.every, self.rows), self.total)

    def ids(self) -> np.ndarray:
        ids = np.concatenate([self.part(p) for p in range(len(self.points))])
        if zlib.crc32(ids.astype("<u4").tobytes()) != self.crc:
            raise ValueError("a block does not match its checksum")
        return ids


INDEX = "shard int, block int, file string, at long, length long, n_tokens long"
INDEX_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("file", pa.string()), ("at", pa.int64()), ("length", pa.int64()), ("n_tokens", pa.int64())])


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> tuple[DataFrame, np.ndarray]:
    """Write all documents' ids below ``folder``; returns the committed index of blocks and the shared table.

    Shards are ranges of doc_id in ascending order, one file each; the ids cross the
    network once, packed.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = max(Tokenizer.from_file(tokenizer_path(path)).get_vocab_size(), end_id + 1)
    kind = id_type(vocabulary)
    packed = scratch_path(spark, "ids")
    tokenize(docs, path, end_id, kind).write.option("compression", "zstd").parquet(packed)
    tokens = spark.read.schema(IDS).parquet(packed)
    frequencies = shared_frequencies(count_ids(tokens, vocabulary))
    table = spark.sparkContext.broadcast(frequencies)  # one number per id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = Coder(table.value), TaskContext.get().partitionId()
        out, name, at, block = None, "", 0, 0
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal out, name, at, block, held, size
            if out is None:
                name = attempt_file(folder, f"shard-{shard:05d}", ".rans")
                out = create(name)
            data = pack_block(coder, held)
            out.write(data)
            row = [[shard], [block], [name], [at], [len(data)], [size]]
            at, block, held, size = at + len(data), block + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(row, INDEX_ARROW, strict=True)], schema=INDEX_ARROW)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((doc_id, np.frombuffer(ids.as_py(), kind)))
                size += len(held[-1][1])
                if size >= block_ids:
                    yield flush()
        if held:
            yield flush()
        if out is not None:
            out.close()

    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.select("doc_id", "ids").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index"), frequencies


def read_token_files(index: DataFrame, frequencies: np.ndarray) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files; each block is one unit of work."""
    spark = index.sparkSession
    table = spark.sparkContext.broadcast(frequencies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(table.value)
        for batch in batches:
            for name, at, length, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open_input(name) as file:
                    file.seek(at)
                    view = BlockView(coder, file.read(length))
                data, ends = view.ids().astype("<u4").tobytes(), np.cumsum(view.lengths)
                begins = ends - view.lengths
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                columns = [view.doc_ids, start + begins, view.lengths, crc]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # Where a block's ids begin among all: shards are summed first, then blocks within their shard.
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    shards = shards.select(F.col("shard").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = index.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(shards, F.col("shard") == F.col("of"))
    placed = placed.select("file", "at", "length", (F.col("shard_start") + F.col("inside")).alias("start"))
    # Rows are few and small but stand for much work, so the number of tasks is named.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(tasks, "file", "at").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame) -> DataFrame:
    """Encode, write and read back all documents."""
    index, frequencies = write_token_files(docs, scratch_path(docs.sparkSession, "tokens"))
    return read_token_files(index, frequencies)


@register("op3_token_files")
def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place, length and checksum, as the token files have them."""
    return token_output(read_table(spark, folder, "documents"))
