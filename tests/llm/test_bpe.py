import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from folkscope.llm import bpe as B

PATH = public_tokenizers.path(B.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return B.Encoder(PATH, public_tokenizers.PATTERN)


LETTERS = ["ab", "aeiourstln", "éèñàçü", "中文字漢語", "аеинтор", "  \n\t", "0123456789", "!?.,-'", "  　", "😀👍🏽", "՘\U000323b0"]
LETTERS += ["אבגד", "กขค", "हिंदी", "a", "\x1c\x1f\x85 ᠎​", "'stmdrevl "]


def test_texts_as_the_library(library, encoder):
    rng = random.Random(3)
    for _ in range(8000):
        letters = "".join(rng.choices(LETTERS, k=rng.randint(1, 3)))
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 8, 20, 60])))
        assert encoder.encode(text).tolist() == library.encode_ordinary(text), repr(text)


def test_bytes_and_token_sequences_as_the_library(library, encoder):
    rng = random.Random(4)
    tokens = list(encoder.transducer.ranks)
    for k in range(6000):
        data = bytes(rng.choices(range(256), k=rng.randint(1, 30))) if k % 2 else b"".join(rng.choices(tokens, k=rng.randint(1, 6)))
        assert encoder.transducer.encode(data) == library._encode_single_piece(data)


def test_long_pieces_are_linear_and_leave_early(library, encoder):
    for text in ("a" * 300_000, "ab" * 100_000, " " * 200_000 + "x", "é" * 60_000, "word " * 400_000):
        assert encoder.encode(text).tolist() == library.encode_ordinary(text)
    state, waiting = encoder.transducer.start, 0
    for byte in ("a" * 5000 + "ab" * 500 + "é" * 500).encode():
        state, _ = state[byte]
        waiting = max(waiting, len(state.final))
    assert waiting < 16  # tokens leave after a bounded lookahead


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(B, "CACHE_UNITS", 3)
    monkeypatch.setattr(B, "CHUNK", 50)
    monkeypatch.setattr(B, "MAX_PAIRS", 5)
    small = B.Encoder(PATH, public_tokenizers.PATTERN)
    small.transducer.max_states = 4
    rng = random.Random(5)
    for _ in range(300):
        text = " ".join("".join(rng.choices("abcdeé1.", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 40)))
        assert small.encode(text).tolist() == library.encode_ordinary(text)


def test_another_pattern_and_vocabulary(tmp_path):
    ranks = {bytes([k]): k for k in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259, b"aaaa": 260, b" a": 261}
    file = tmp_path / "own.tiktoken"
    file.write_bytes(b"".join(B.base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    pattern = r"\p{L}+|[^\p{L}]+"
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    own = B.Encoder(str(file), pattern)
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choices("aabc 1", k=rng.randint(0, 25)))
        assert own.encode(text).tolist() == library.encode_ordinary(text), text


def test_decoding_of_any_ids():
    tokens = {rank: token for token, rank in B.read_ranks(PATH).items()}
    decoder, rng = B.StreamDecoder(tokens), random.Random(7)
    for k in range(6000):
        ids = [rng.randrange(len(tokens)) if k % 2 else rng.randrange(256) for _ in range(rng.randint(0, 12))]
        assert decoder.decode(ids) == b"".join(tokens[i] for i in ids).decode(errors="replace")


def test_decoding_gives_whole_characters_only(encoder):
    decoder = B.StreamDecoder(encoder.transducer.tokens)
    text = "aé中😀z"
    chunks = list(decoder.feed([encoder.transducer.ranks[bytes([b])] for b in text.encode()]))
    assert [c for c in chunks if c] == list(text) and decoder.finish() == ""
    list(decoder.feed([encoder.transducer.ranks[b"\xe4"]]))
    assert decoder.finish() == "�" and decoder.finish() == ""


SCHEMA = "doc_id long, text string, ids string, n_tokens string"


def test_rows_of_any_kind(spark, library, tmp_path):
    rows = [(1, "Plain words, and 123 numbers.", "x", None), (None, "no id", None, None), (3, None, None, None), (4, "", None, None)]
    rows += [(5, "twice", None, None), (5, "twice", None, None), (6, "né 中文 😀 " * 40_000, None, None), (-7, "\x00\t\n ", None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    coded = B.decode_documents(B.encode_documents(frame))
    got = sorted(((r["doc_id"], r["ids"], r["text"]) for r in coded.collect()), key=repr)
    want = sorted(((d, library.encode_ordinary(t or ""), t or "") for d, t, _, _ in rows), key=repr)
    assert got == want
    assert sorted(map(tuple, B.round_trip(frame).collect()), key=repr) == want
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in B.op11_byte_bpe(spark, str(tmp_path)).collect()}

    def digest(data: str) -> str:
        return hashlib.sha256(data.encode()).hexdigest()

    assert found == {(d, len(i), digest(",".join(map(str, i))), digest(t)) for d, i, t in want}


def test_empty_table_and_null_ids(spark):
    assert B.decode_documents(B.encode_documents(spark.createDataFrame([], SCHEMA))).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {tuple(r) for r in B.decode_documents(nulls).select("doc_id", F.col("text")).collect()} == {(1, ""), (2, "")}
