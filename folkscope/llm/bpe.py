"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by a UTF-8 state machine.

A vocabulary of ranks says which adjacent parts merge, least rank first. A sequence of
tokens is what the merges make of its bytes exactly if each two neighbours are what they
make of those two alone (Berglund, Martens, van der Merwe, "Constructing a BPE tokenization
DFA", 2024). So, reading bytes from the left, each prefix has one last token: the one that
begins where a token that it agrees with ends. The transducer's nondeterministic states are
the open tokens, each with the tokens before it. A determinised state is the set of all of
them at one place. What their histories share from the left is emitted, so a token leaves
as soon as no reading of the next bytes can change it. States and moves are made when a
text first needs them and kept while there is room; work is linear in the text.

Texts are cut into pieces by a pattern first, and what was met before is looked up. A piece
that is a token as a whole is that token, whatever the merges make of it.

Decoding goes the other way, token by token: a state machine holds the bytes of an
unfinished character until the tokens that follow complete it, so every chunk that it
gives is whole characters. Bytes that no character can begin with or go on with become
U+FFFD, one for each longest piece that could have begun a character, as in Python.

Defined cases: a null text is an empty one and has no ids; null ids decode to an empty text,
null elements among them and numbers that are no token stop the job; rows that repeat a
doc_id, or have none, are documents each; no cap on a text's length.
"""

from __future__ import annotations

import base64
import gc
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folkscope.llm.registry import read_table, register
from folkscope.llm.tokens import gathered

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
MAX_STATES = 1 << 18  # of the transducer; beyond it, it starts anew
MAX_PAIRS = 1 << 19
CACHE_UNITS = 3 << 18
CACHE_CHARS = 1 << 23
CHUNK = 1 << 20  # characters; longer texts are cut into pieces some at a time
FLUSH_IDS = 1 << 20
START = -1
NEVER = 1 << 62

# The pattern under which a text may be cut unit by unit, and its white space.
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# The same pattern for the first 256 characters, with their classes spelt out.
LETTERS, NUMBERS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
NARROW_PATTERN = (
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{WHITE}{LETTERS}{NUMBERS}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
# Letters and numbers of Unicode versions after the one that the splitting follows, as ranges of code points.
LATER = (
    "558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1 "
    "ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f "
    "12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 "
    "191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 "
    "1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def merge_steps(data: bytes, ranks: dict[bytes, int]) -> tuple[list[bytes], list[tuple[int, bytes, bytes]]]:
    """What the merges make of some bytes, by their definition, for short ones; and of each step its rank and the outer parts after it."""
    parts, steps = [data[k : k + 1] for k in range(len(data))], []
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == NEVER:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        steps.append((rank, parts[0], parts[-1]))
    return parts, steps


class Node:
    """Bytes that a token begins with: the token that they are, if any, and what longer tokens go on with."""

    __slots__ = ("following", "token")

    def __init__(self):
        self.following: dict[int, Node] = {}
        self.token: int | None = None


class State(dict):
    """One place of a text: the open tokens, oldest first, each as (node reached, token before it, tokens not yet emitted).

    As a mapping it holds its moves, (next state, tokens emitted on the way) by byte, each made at its first use.
    """

    __slots__ = ("final", "of", "open")

    def __init__(self, of: Transducer, open_: tuple):
        self.of, self.open, self.final = of, open_, open_[-1][2]

    def __missing__(self, byte: int) -> tuple[State, tuple]:
        found = self[byte] = self.of.move(self.open, byte)
        return found


class Transducer:
    """Bytes in, tokens out."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.top = Node()
        for token, rank in ranks.items():
            node = self.top
            for byte in token:
                node = node.following.get(byte) or node.following.setdefault(byte, Node())
            node.token = rank
        self.pairs: dict[tuple[int, int], bool] = {}
        self.steps: dict[int, list[tuple[int, bytes, bytes]] | None] = {}
        self.states: dict[tuple, State] = {}
        self.reset()

    def reset(self) -> None:
        for state in self.states.values():
            state.clear()  # states refer to each other; without their moves they go at once
        self.states = {}
        self.start = self.state(((self.top, START, ()),))

    def state(self, open_: tuple) -> State:
        found = self.states.get(open_)
        if found is None:
            found = self.states[open_] = State(self, open_)
        return found

    def made(self, token: int) -> list[tuple[int, bytes, bytes]] | None:
        """The steps that make a token of its bytes, closed by one that never comes; None if the merges make something else."""
        if token not in self.steps:
            data = self.tokens[token]
            parts, steps = merge_steps(data, self.ranks)
            self.steps[token] = [*steps, (NEVER, data, data)] if len(parts) == 1 else None
        return self.steps[token]

    def agree(self, before: int, token: int) -> bool:
        """Whether the merges keep two neighbours apart; at the start, whether they make the token at all."""
        if before == START:
            return self.made(token) is not None
        found = self.pairs.get((before, token))
        if found is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            found = self.pairs[before, token] = self.apart(before, token)
        return found

    def apart(self, before: int, token: int) -> bool:
        """Both sides' steps in the order of the merges: least rank first, then from the left. A merge across comes if its turn does."""
        ours, theirs = self.made(before), self.made(token)
        if ours is None or theirs is None:
            return False
        left, right = self.tokens[before][-1:], self.tokens[token][:1]
        i = j = 0
        while True:
            ours_next, theirs_next = ours[i][0], theirs[j][0]
            across = self.ranks.get(left + right, NEVER)
            if across < ours_next and across <= theirs_next:
                return False
            if ours_next == theirs_next == NEVER:
                return True
            if ours_next <= theirs_next:
                left = ours[i][2]
                i += 1
            else:
                right = theirs[j][1]
                j += 1

    def move(self, open_: tuple, byte: int) -> tuple[State, tuple]:
        """What a byte does to the open tokens: the next state and what is emitted on the way."""
        if len(self.states) > self.max_states:
            self.reset()
        going, last = [], None
        for node, before, waiting in open_:
            node = node.following.get(byte)
            if node is None:
                continue
            if last is None and node.token is not None and self.agree(before, node.token):
                last = (self.top, node.token, (*waiting, node.token))
            if node.following:
                going.append((node, before, waiting))
        if last is None:
            raise ValueError(f"no token ends after byte {byte}: the vocabulary lacks single bytes")
        going.append(last)
        histories = [waiting for _, _, waiting in going]
        least, most = min(histories), max(histories)  # what these two share, all share
        shared = 0
        while shared < len(least) and least[shared] == most[shared]:
            shared += 1
        if shared:
            going = [(node, before, waiting[shared:]) for node, before, waiting in going]
        return self.state(tuple(going)), least[:shared]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        state = self.start
        for byte in piece:
            state, emitted = state[byte]
            if emitted:
                out += emitted
        out += state.final
        return out


def is_narrow(text: str) -> bool:
    """Whether all characters are among the first 256."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Splitter:
    """Cuts texts into pieces by the pattern.

    Under the known pattern no piece goes on from a character that is no white space to one
    that is, so a text falls into units, white space and what follows it up to the next, that
    are cut each by itself. Under another pattern a text is one unit.
    """

    def __init__(self, pattern: str):
        later = "".join(f"{chr(int(a, 16))}-{chr(int(b, 16))}" for a, b in (r.split("-") for r in LATER.split()))
        self.later, self.usual = regex.compile(f"[{later}]"), regex.compile(pattern)
        kept = pattern.replace(r"\p{L}", rf"[\p{{L}}--[{later}]]").replace(r"\p{N}", rf"[\p{{N}}--[{later}]]")
        self.unusual = regex.compile(kept, regex.V1)
        self.narrow = re.compile(NARROW_PATTERN) if pattern == KNOWN_PATTERN else None
        self.unit = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+" if pattern == KNOWN_PATTERN else r"(?s).+")

    def units(self, text: str) -> Iterator[list[str]]:
        """A text's units; a text of the first 256 characters only falls into its pieces at once."""
        pattern = self.narrow if self.narrow and is_narrow(text) else self.unit
        if len(text) <= CHUNK:
            yield pattern.findall(text)
            return
        found = pattern.finditer(text)
        while part := [m.group() for m in islice(found, CHUNK >> 3)]:
            yield part

    def pieces(self, unit: str) -> list[str]:
        if self.narrow and is_narrow(unit):
            return self.narrow.findall(unit)
        return (self.unusual if self.later.search(unit) else self.usual).findall(unit)


class Encoder:
    """Texts to ids: units met before by lookup, the pieces of others by lookup or through the transducer."""

    def __init__(self, path: str, pattern: str):
        self.transducer, self.splitter = Transducer(read_ranks(path)), Splitter(pattern)
        self.reset()

    def reset(self) -> None:
        self.place: dict[str, int] = {}  # of each kept unit or piece
        self.held = 0
        self.ids = array("i")  # of all kept ones, one after the other
        self.bounds = array("q", [0])

    def keep(self, unit: str, ids: list[int]) -> int:
        place = len(self.place)
        self.ids.extend(ids)
        self.bounds.append(len(self.ids))
        self.place[unit] = place
        self.held += len(unit)
        return place

    def learn(self, unit: str) -> int:
        pieces = self.splitter.pieces(unit)
        if len(pieces) == 1:
            return self.keep(unit, self.transducer.encode(pieces[0].encode()))
        ids: list[int] = []
        for piece in pieces:
            place = self.place.get(piece)
            if place is None:
                place = self.keep(piece, self.transducer.encode(piece.encode()))
            ids += self.ids[self.bounds[place] : self.bounds[place + 1]]
        return self.keep(unit, ids)

    def encode(self, text: str) -> np.ndarray:
        parts = []
        for units in self.splitter.units(text):
            if len(self.place) > CACHE_UNITS or self.held > CACHE_CHARS:
                self.reset()
            at = np.fromiter(map(self.place.get, units, repeat(-1)), np.int64, len(units))
            for k in np.flatnonzero(at < 0).tolist():
                place = self.place.get(units[k])
                at[k] = self.learn(units[k]) if place is None else place
            bounds = np.frombuffer(self.bounds, np.int64)
            parts.append(gathered(np.frombuffer(self.ids, np.int32), bounds[at], bounds[at + 1])[0])
            del bounds  # arrays grow only while nothing looks at them
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int32)


def utf8_machine() -> list[list[int]]:
    """Next state by state and byte. 0: between characters; 1, 2, 3: so many bytes are missing; 4 to 7: the next byte
    is limited, by what shortest forms, surrogates and the last code point rule out; -1: no character goes on so."""
    table = [[-1] * 256 for _ in range(8)]

    def allow(state: int, low: int, high: int, to: int) -> None:
        table[state][low : high + 1] = [to] * (high - low + 1)

    allow(0, 0x00, 0x7F, 0)
    allow(0, 0xC2, 0xDF, 1)
    allow(0, 0xE0, 0xEF, 2)
    allow(0, 0xF0, 0xF4, 3)
    for missing in (1, 2, 3):
        allow(missing, 0x80, 0xBF, missing - 1)
    for state, lead, low, high, missing in ((4, 0xE0, 0xA0, 0xBF, 1), (5, 0xED, 0x80, 0x9F, 1), (6, 0xF0, 0x90, 0xBF, 2), (7, 0xF4, 0x80, 0x8F, 2)):
        allow(0, lead, lead, state)
        allow(state, low, high, missing)
    return table


class StreamDecoder:
    """Tokens in, whole characters out; what a token gives after some unfinished bytes is worked out once."""

    REPLACEMENT = "�"

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens, self.machine = tokens, utf8_machine()
        self.moves: dict[bytes, dict[int, tuple[str, bytes]]] = {}
        self.pending = b""  # bytes of an unfinished character
        self.steady = {token: text for token in tokens for text, left in [self.read(b"", token)] if not left}

    def read(self, pending: bytes, token: int) -> tuple[str, bytes]:
        out, held, state = [], b"", 0
        for byte in pending + self.tokens[token]:
            following = self.machine[state][byte]
            if following < 0 and held:  # what was held begins no character
                out.append(self.REPLACEMENT)
                held, following = b"", self.machine[0][byte]
            if following < 0:
                out.append(self.REPLACEMENT)
                state = 0
                continue
            held, state = held + bytes([byte]), following
            if not state:
                out.append(held.decode())
                held = b""
        return "".join(out), held

    def feed(self, ids: Iterable[int]) -> Iterator[str]:
        """The whole characters that each token completes; the state goes on to the next call."""
        pending = self.pending
        moves = self.moves.setdefault(pending, {})
        for token in ids:
            found = moves.get(token)
            if found is None:
                found = moves[token] = self.read(pending, token)
            text, after = found
            if after != pending:
                pending, moves = after, self.moves.setdefault(after, {})
            yield text
        self.pending = pending

    def finish(self) -> str:
        """What the end makes of unfinished bytes."""
        left, self.pending = self.pending, b""
        return self.REPLACEMENT if left else ""

    def decode(self, ids: list[int]) -> str:
        """A whole sequence. Where each token, read between characters, ends between characters, its text is known at once."""
        texts = list(map(self.steady.get, ids))
        if None in texts:
            return "".join(self.feed(ids)) + self.finish()
        return "".join(texts)


def vocabulary_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return path


def split_pattern(pattern: str | None) -> str:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return pattern


IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def encoded(batches: Iterator[pa.RecordBatch], path: str | None, pattern: str | None) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, text) as batches of (doc_id, ids), of bounded size whatever the texts."""
    gc.disable()  # hundreds of thousands of kept states, which a collection would walk through again and again
    try:
        encoder = Encoder(vocabulary_path(path), split_pattern(pattern))
        for batch in batches:
            names: list = []
            parts: list[np.ndarray] = []
            size = 0
            for k, (doc_id, text) in enumerate(zip(*batch.columns, strict=True), 1):
                names.append(doc_id.as_py())
                parts.append(encoder.encode(text.as_py() or ""))
                size += len(parts[-1])
                if size >= FLUSH_IDS or k == batch.num_rows:
                    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(parts).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), ids], schema=IDS)
                    names, parts, size = [], [], 0
    finally:
        gc.enable()


def decoded(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, ids) with the text of the ids."""
    decoder = StreamDecoder({rank: token for token, rank in read_ranks(vocabulary_path(path)).items()})
    for batch in batches:
        lists = batch.column(1)
        texts, begin, size = [], 0, 0
        for k, ids in enumerate(lists, 1):
            texts.append(decoder.decode(ids.values.to_numpy(zero_copy_only=True).tolist() if ids.is_valid else []))
            size += len(texts[-1])
            if size >= FLUSH_IDS or k == len(lists):
                part = batch.slice(begin, k - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])
                texts, begin, size = [], k, 0


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids): every whole text's tokens. ``path`` names a file of ranks that all executors can open."""
    columns = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(*columns).mapInArrow(lambda batches: encoded(batches, path, pattern), "doc_id long, ids array<int>")


def decode_documents(coded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of ``coded`` (doc_id, ids) with ``text``, decoded token by token."""

    columns = "doc_id long, ids array<int>, text string"
    return coded.select("doc_id", "ids").mapInArrow(lambda batches: decoded(batches, path), columns)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids, text): every whole text's tokens and what these decode to, in one pass of one worker per task."""
    columns = F.col("doc_id").cast("long"), F.col("text").cast("string")
    both = "doc_id long, ids array<int>, text string"
    return docs.select(*columns).mapInArrow(lambda batches: decoded(encoded(batches, path, pattern), path), both)


@register("op11_byte_bpe")
def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Number and digest of every document's ids, and digest of what they decode to."""
    return round_trip(read_table(spark, folder, "documents")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )
