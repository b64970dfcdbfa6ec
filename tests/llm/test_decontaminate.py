import hashlib
import random
import re

import numpy as np
import pytest

from folkscope.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    windows = {}
    for item_id, text in items:
        w = plain_words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("null" if item_id is None else str(item_id))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (names := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def tables(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "ñandú", "日本", "x1"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(11, 40)))) for i in range(25)]
    items += [(90, "short one here"), (91, "w1 w2"), (92, "..."), (93, None), (None, "no id item w3 w4 w5 w6 w7 w8 w9 w10"), (3, "second text of three with ten or more words in it"), (3, items[3][1])]
    docs = []
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        for _ in range(rng.choice([0, 0, 1, 3])):
            source = plain_words(rng.choice(items)[1])
            at = rng.randint(0, len(words))
            words[at:at] = source[rng.randint(0, 3) :][: rng.randint(5, 40)]
        docs.append((i, rng.choice([" ", ", ", "\n-- "]).join(words).upper() if i % 3 else " ".join(words)))
    docs += [(500, None), (501, ""), (502, "short one here"), (502, "short one here"), (None, items[0][1]), (503, "SHORT-one_HERE ok"), (504, (items[1][1] + " ") * 500), (505, "w1 w2 " * 3000)]
    return docs, items


@pytest.mark.parametrize(("shard", "block_bytes"), [(1 << 20, 8 << 20), (200, 300)])
def test_against_all_windows(spark, monkeypatch, tmp_path, shard, block_bytes):
    monkeypatch.setattr(D, "SHARD_WORDS", shard)
    docs, items = tables()
    found = D.find_contamination(
        spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, spans string"),
        spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, items string"),
        block_bytes=block_bytes,
    )
    out = []
    for r in found.collect():
        hit = sum(s.end - s.begin for s in r["spans"])
        out.append((r.doc_id, r.n_words, hit, len(r["items"]), D.digest(r["items"]), hit > 0))
        assert all(a.end < b.begin for a, b in zip(r["spans"], r["spans"][1:], strict=False))
    assert sorted(out, key=str) == brute(docs, items)


def test_query_on_given_and_empty_tables(spark, tmp_path):
    docs, items = tables(2)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    assert sorted(map(tuple, D.op2_decontaminate(spark, f"{tmp_path}/a").collect()), key=str) == brute(docs, items)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    assert D.op2_decontaminate(spark, f"{tmp_path}/b").count() == 0
    nothing = D.find_contamination(spark.read.parquet(f"{tmp_path}/a/documents.parquet"), spark.read.parquet(f"{tmp_path}/b/benchmark.parquet"))
    assert all(not r["spans"] for r in nothing.collect())


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_and_search(seed):
    rng = np.random.default_rng(seed)
    text = np.concatenate([rng.integers(1, 2 + 3 * seed, 300), np.tile([2, 3, 1], 40), [0]])
    order = D.suffix_array(text)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    index = D.FMIndex(text)
    lengths = np.array([1, 2, 3, 5, 8] * 20)
    table = np.zeros((100, 8), np.int64)
    for row, n in zip(table, lengths, strict=True):
        at = rng.integers(0, len(text) - n - 1)
        row[8 - n :] = text[at : at + n] if rng.random() < 0.8 else rng.integers(1, 9, n)
    low, high = index.search(table, lengths)
    for row, n, a, b in zip(table, lengths, low, high, strict=True):
        want = [k for k in range(len(text) - n) if text[k : k + n].tolist() == row[8 - n :].tolist()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_cut_words():
    text = "Keep this, NOT these words! but that."
    assert D.cut_words(text.encode(), [(2, 5)]).decode() == "Keep this, ! but that."
    assert D.cut_words(b"a b", []) == b"a b" and D.cut_words(b"a b", [(0, 2)]) == b""
