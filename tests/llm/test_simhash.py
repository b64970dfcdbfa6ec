import random

import numpy as np
import pytest
import xxhash

from folkscope.llm import simhash as S


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_roots(values, radius=3):
    label = list(range(len(values)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


TEXTS = [None, "", " \t\n\x0b\f\r", "one", "One two", "one TWO three", "a b c d", "É é x y z", "the cat sat on the mat " * 5000, "x" * 100_000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert S.fingerprint((text or "").encode()) == brute_fingerprint(text)


def clustered(rng, n):
    values = set()
    while len(values) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 5, 40])):
            values.add(base)
            for _ in range(rng.choice([1, 1, 2, 3, 4])):
                base ^= 1 << rng.randrange(64)
    return sorted(values)[:n]


def test_forest_finds_all_pairs():
    rng = random.Random(1)
    values = clustered(rng, 400)
    rng.shuffle(values)
    groups = np.sort(np.array([rng.randrange(3) for _ in values]))
    forest = S.BKForest(np.array(values, np.uint64), groups)
    found = set()
    for a, b in forest.within(np.arange(len(values)), 3):
        found |= set(zip(a.tolist(), b.tolist(), strict=True))
    want = {(i, j) for i in range(400) for j in range(400) if i != j and groups[i] == groups[j] and (values[i] ^ values[j]).bit_count() <= 3}
    assert found == want


@pytest.mark.parametrize(("split", "batch", "pairs"), [(4096, 1 << 17, 1 << 20), (2, 50, 64)])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, split, batch, pairs):
    monkeypatch.setattr(S, "BATCH_NODES", batch)
    monkeypatch.setattr(S, "SEARCH_PAIRS", pairs)
    rng = random.Random(2)
    values = clustered(rng, 700) + [0, 1, (1 << 64) - 1]
    values = sorted(set(values))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.node: r.root for r in S.components(S.shard_links(nodes, split=split)).collect()}
    mine = [roots.get(v, v) for v in signed]
    want = brute_roots(values)
    classes = lambda labels: {frozenset(i for i, x in enumerate(labels) if x == y) for y in set(labels)}
    assert classes(mine) == classes(want)


def test_long_chains_settle(spark):
    n = 300
    links = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(n + 5, n + 4)], "a long, b long")
    roots = {r.node: r.root for r in S.components(links).collect()}
    assert roots == {i: 0 for i in range(n + 1)} | {n + 5: n + 4, n + 4: n + 4}


def test_documents(spark):
    rng = random.Random(3)
    base = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(900)]
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, " ".join(base[:k] + ["changed"] + base[k:])) for i, k in enumerate((3, 400, 800))]
    rows += [(50, " ".join(base).upper()), (60, " ".join(base)), (60, " ".join(base)), (None, " ".join(base)), (None, "alone here now")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fp string")
    out = S.near_duplicates(frame).select("doc_id", "fp", "component_id").collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    label = brute_roots(fps)
    want = []
    for (doc_id, _), fp, root in zip(rows, fps, label, strict=True):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == root and rows[j][0] is not None]
        want.append((doc_id, fp - (1 << 64) if fp >> 63 else fp, min(ids, default=None)))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert S.near_duplicates(frame.limit(0)).count() == 0
