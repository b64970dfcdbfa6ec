import random
import re

import numpy as np
import pytest

from folkscope.llm import substrings as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window):
    """The contract as it is worded."""
    texts = [(S.LAST if d is None else d, WORD.findall(t or "")) for d, t in docs]
    least = {}
    for doc_id, w in texts:
        for k in range(len(w) - window + 1):
            run = tuple(w[k : k + window])
            least[run] = min(least.get(run, doc_id), doc_id)
    out = []
    for (doc_id, w), (given, _) in zip(texts, docs, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < doc_id:
                gone |= set(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((given, len(w), len(gone), " ".join(kept)))
    return sorted(out, key=str)


def corpus(seed, window):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "日本", "x,y"]
    shared = [rng.choices(vocabulary, k=rng.randint(window - 2, 4 * window)) for _ in range(8)]
    docs = []
    for i in range(90):
        words = rng.choices(vocabulary, k=rng.randint(0, 3 * window))
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            piece = list(rng.choice(shared))
            if rng.random() < 0.4:
                piece[rng.randrange(len(piece))] = "edit"
            at = rng.randint(0, len(words))
            words[at:at] = piece[rng.randint(0, 3) :]
        docs.append((rng.randint(0, 10_000), rng.choice([" ", "\n", " \t "]).join(words)))
    docs += [(rng.randint(0, 20_000), docs[7][1]) for _ in range(12)] + [(docs[5][0], docs[9][1]), docs[4], docs[4]]
    docs += [(None, docs[3][1]), (None, docs[3][1]), (1, None), (2, ""), (20_001, "a " * 5 * window), (20_002, "a " * 3 * window), (20_003, "a b " * window)]
    docs += [(20_004, " ".join(d[1] or "" for d in docs[:20])), (20_005, "z" * 50_000)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(
    ("seed", "crowded", "hot", "slab", "block"),
    [(1, 700, 16_000, 512, 1 << 19), (2, 3, 3, 512, 1 << 19), (3, 0, 0, 16, 100), (4, 3, 8, 16, 300), (5, 700, 900, 1, 1), (6, 0, 900, 64, 50)],
)
def test_against_all_windows(spark, monkeypatch, seed, crowded, hot, slab, block):
    monkeypatch.setattr(S, "BLOCK_WORDS", block)
    docs = corpus(seed, 20)
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, tag string")
    out = S.remove_duplicates(frame, window=20, gram=4, crowded=crowded, hot=hot, slab=slab).collect()
    assert sorted(map(tuple, out), key=str) == brute(docs, 20)


def test_query_on_whole_windows_of_fifty(spark, tmp_path):
    docs = corpus(9, 50)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(d, n, gone, S.kept_digest(kept.split())) for d, n, gone, kept in brute(docs, 50)]
    assert sorted(map(tuple, S.op4_substring_dedup(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert S.remove_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("size", [1, 2, 7, 8, 50])
def test_hashes_of_runs(size):
    rng = np.random.default_rng(size)
    words = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    words[200:260] = words[20:80]
    got = S.run_hashes(words, size, 12345)
    assert len(got) == 300 - size + 1
    same = {}
    for k in range(len(got)):
        same.setdefault(got[k], set()).add(tuple(words[k : k + size]))
    assert all(len(v) == 1 for v in same.values()) and got[20] == got[200]


def test_every_window_has_an_anchor():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    places, grams = S.anchors(words, 20, 4)
    every = S.run_hashes(words, 4, 0x9E3779B97F4A7C15)
    for k in range(500 - 20 + 1):
        inside = every[k : k + 17]
        assert k + int(inside.argmin()) in places
    assert (every[places] == grams).all() and len(places) < 100


def test_factors_cross_their_ends():
    texts = ["abcdefgh", "ghijklmn", "xxcdefgh", "efghijkl", "abcdefghijkl"]
    block = S.ReferenceBlock([" ".join(t).encode() for t in texts], np.array([len(t) for t in texts]), np.array([1, 2, 3, 4, 5]), 4)
    for k in range(5):
        gone = set()
        for a, b in block.factors(k):
            gone |= set(range(a, b))
        want = set()
        for i in range(len(texts[k]) - 3):
            if any(texts[k][i : i + 4] in texts[j] for j in range(k)):
                want |= set(range(i, i + 4))
        assert gone == want


def test_a_line_that_a_document_repeats_sends_its_windows_once(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    texts = [" ".join([*(f"u{rng.random()}" for _ in range(30)), *["is", "on"] * 400, f"e{k}", *["is", "on"] * 300]) for k in range(6)]
    docs = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc_id long, tag long, text string")
    marks = S.find_anchors(docs, 20, 4).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("place", F.lit(1).cast("long").alias("key"), F.lit(True).alias("hot"))).alias("marks"))
    sent = S.cut_passages(docs.join(marks, ["doc_id", "tag"]), 20, 4).collect()
    for k, text in enumerate(texts):
        rows = [r for r in sent if r.doc_id == k]
        words = text.split()
        assert len(rows) < 100 and len(words) > 1400
        assert len({(r.key, r.check) for r in rows}) == len(rows) == len({tuple(words[i : i + 20]) for i in range(len(words) - 19)})
        for r in rows:
            window = words[r.spans[0].begin : r.spans[0].begin + 20]
            places = [i for i in range(len(words) - 19) if words[i : i + 20] == window]
            assert {i for a, b in r.spans for i in range(a, b)} == {i + j for i in places for j in range(20)}
