import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.dataset as ds
import pytest
from tokenizers import Tokenizer

from folkscope.llm import tokens as T
from folkscope.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " \n\t ", "one", "It's  é ́x 　 wide space", "<|endoftext|> <|startoftext|>x <|end oftext|>", "ΣΑΣ ΟΔΟΣ. ΣΑ Σ", "it 's 't don't",
    "a\x1cb\x0bc\x85d e", "한국어 각", "😀👍🏽 123,456.7", "x" * 30_000, "word " * 30_000, "\x00 ﻿", "ﬁ Å İ ẞ",
]


def plain_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_piece_by_piece_is_the_whole_text(monkeypatch):
    tokenizer, encoder = Tokenizer.from_file(PATH), T.TextEncoder(PATH)
    assert encoder.in_pieces
    monkeypatch.setattr(T, "CACHE_PIECES", 5_000)
    monkeypatch.setattr(T, "GATHER_WORDS", 700)
    texts = ODD + ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table(columns=["text"])["text"].to_pylist()
    for k in range(0, len(texts), 100):
        part = texts[k : k + 100]
        for text, ids in zip(part, encoder.encode(pa.array(part, pa.string())), strict=True):
            assert ids.tolist() == plain_ids(tokenizer, text), repr((text or "")[:80])


def test_every_plain_character_by_itself_and_between_others():
    tokenizer, encoder = Tokenizer.from_file(PATH), T.TextEncoder(PATH)
    plain = [chr(c) for c in range(0x3000) if encoder.plain.fullmatch(chr(c))]
    rng = random.Random(8)
    texts = [f"a{c}B {c}{c}1 '{c}'s {c}" for c in plain] + ["".join(rng.choices(plain, k=60)) for _ in range(3000)]
    texts += ["".join(rng.choices([*plain, "ſ", "İ", "\u0301", "\xa0", "あ", "'re", "'ll", "<|endoftext|>"], k=30)) for _ in range(2000)]
    for text, ids in zip(texts, encoder.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == plain_ids(tokenizer, text), repr(text)


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = T.TextEncoder(path)
    assert not encoder.in_pieces
    for text, ids in zip(ODD, encoder.encode(pa.array(ODD, pa.string())), strict=True):
        assert ids.tolist() == plain_ids(Tokenizer.from_file(path), text)


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 40_000])
def test_coder_round_trip_and_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 999).astype(np.uint32)
    count = np.bincount(ids, minlength=1000) if n else np.ones(1000, np.int64)
    coder = T.Coder(T.shared_frequencies(count))
    half = n // 2
    view = T.BlockView(coder, T.pack_block(coder, [(7, ids[:half]), (None, ids[half:])], checkpoint_rows=16))
    assert view.doc_ids == [7, None] and view.lengths.tolist() == [half, n - half]
    if n:
        assert (view.ids() == ids).all()
        for point in range(len(view.points)):  # each part by itself
            assert (view.part(point) == ids[point * 16 * T.LANES : (point + 1) * 16 * T.LANES]).all()


def test_size_is_near_the_entropy():
    ids = np.random.default_rng(1).geometric(0.02, 300_000).astype(np.uint32)
    count = np.bincount(ids)
    share = count[count > 0] / len(ids)
    coder = T.Coder(T.shared_frequencies(count))
    words, _ = coder.encode(ids)
    assert len(words) * 32 < 1.01 * len(ids) * -(share * np.log2(share)).sum() + 64 * T.LANES


def test_damage_is_noticed():
    ids = np.arange(5_000, dtype=np.uint32) % 50
    coder = T.Coder(T.shared_frequencies(np.bincount(ids)))
    data = bytearray(T.pack_block(coder, [(1, ids)]))
    data[-1] ^= 1
    with pytest.raises((ValueError, IndexError)):
        T.BlockView(coder, bytes(data)).ids()


@pytest.mark.parametrize("block_ids", [1, 1 << 19])
def test_files_against_plain_encoding(spark, block_ids):
    tokenizer, rng = Tokenizer.from_file(PATH), random.Random(6)
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(None, "null id"), (9, "repeated"), (9, "repeated"), (9, "other")]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, start string")
    index, frequencies = T.write_token_files(frame, scratch_path(spark, "tokens"), block_ids=block_ids)
    out = T.read_token_files(index, frequencies).collect()
    coded = [(d, np.array([*plain_ids(tokenizer, t), 2], "<u4")) for d, t in rows]
    coded.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].astype("<u2").tobytes()))
    want, start = [], 0
    for doc_id, ids in coded:
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, out), key=lambda r: r[1]) == want


def test_empty_table(spark):
    assert T.token_output(spark.createDataFrame([], "doc_id long, text string")).count() == 0
