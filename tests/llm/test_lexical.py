import math
import random
import re

import numpy as np
import pytest

from folkscope.llm import lexical as L

DOC = "doc_id long, text string, place string, score string, n string"
ITEM = "item_id long, text string, rank string, score string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k=50):
    found = [(d, WORD.findall((t or "").translate(LOWER))) for d, t in docs]
    found = [(d, t) for d, t in found if t]
    count, total = len(found), sum(len(t) for _, t in found)
    df = {}
    for _, t in found:
        for term in set(t):
            df[term] = df.get(term, 0) + 1
    out = []
    for item, text in items:
        terms = set(WORD.findall((text or "").translate(LOWER)))
        scores = []
        for d, t in found:
            m, s = 100 - 50 + 50 * len(t) * count // total, 0
            for term in terms:
                if tf := t.count(term):
                    s += math.floor(1000 * math.log((2 * count + 2) / (2 * df[term] + 1))) * (10**9 * tf // (1000 * tf + 20 * m))
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def mine(spark, docs, items, **kw):
    docs = spark.createDataFrame([(*d, "clash", "clash", "clash") for d in docs], DOC).repartition(3)
    items = spark.createDataFrame([(*i, "clash", "clash") for i in items], ITEM)
    return sorted(map(tuple, L.search_lexical(docs, items, **kw).collect()), key=repr)


def corpus(rng, n, vocabulary=300):
    words = [f"w{k}" if k % 5 else f"É{k}Ünï" for k in range(vocabulary)]
    weights = [1 / (k + 1) for k in range(vocabulary)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 40, 120])))) for i in range(n)]
    items = [(i, "; ".join(rng.choices(words, k=rng.randint(1, 12))).upper() if i % 3 else rng.choice(docs)[1][:80]) for i in range(25)]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_against_all_documents(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(L, "BLOCK_DOCS", 3)
        monkeypatch.setattr(L, "SHARD_DOCS", 40)
    rng = random.Random(1)
    docs, items = corpus(rng, 600)
    docs += [(1000 + k, docs[7][1]) for k in range(200)] + [(None, docs[7][1]), (None, "w1 w2"), (5, docs[5][1]), (5, "w9")]
    docs += [(2000, None), (2001, ""), (2002, " \t.;"), (2003, "w3 " * 30_000), (2004, "w3 w250 \x00 w299" * 500)]
    items += [(None, "w2 w3"), (100, None), (101, ""), (102, "nowhere"), (3, "w8 w9"), (104, "w1"), (105, docs[7][1])]
    assert mine(spark, docs, items, **({"k": 7, "item_bytes": 300} if small else {})) == brute(docs, items, 7 if small else 50)


def test_few_rows(spark):
    assert mine(spark, [], []) == []
    assert mine(spark, [(1, "a b")], []) == []
    assert mine(spark, [], [(1, "a b")]) == []
    docs = [(k, "same words") for k in range(3)]
    assert mine(spark, docs, [(1, "same")]) == brute(docs, [(1, "same")])


def test_summaries_bound_and_spare():
    rng = np.random.default_rng(2)
    width, n = 60, 4000
    topics = rng.dirichlet(np.full(width, 0.08), 40)
    rows = [np.unique(rng.choice(width, 12, p=topics[rng.integers(40)])) for _ in range(n)]
    begin, term = np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows)
    impact = rng.integers(1, 1000, len(term))
    weights = rng.integers(1, 500, width)
    shard = L.Shard(np.arange(n), np.zeros(n, bool), begin, term, impact, width)
    dense = np.zeros((n, width), np.int64)
    dense[shard.row, term] = impact
    items = [rng.choice(width, 4, replace=False).tolist() for _ in range(20)]
    queries = L.Queries(items, weights)
    best = [L.Best(10) for _ in items]
    shard.search(queries, best)
    for own, found in zip(queries.terms, best, strict=True):
        scores = dense[:, own] @ weights[own]
        want = np.lexsort((np.arange(n), -scores))[:10]
        want = want[scores[want] > 0]
        assert found.doc.tolist() == want.tolist() and found.score.tolist() == scores[want].tolist()
        blocks = L.Blocks(shard, int(own[0]), queries)
        bound = blocks.bounds(own, weights)
        for b in range(len(bound)):
            docs = blocks.docs[blocks.begin[b] : blocks.begin[b + 1]]
            assert len(docs) <= L.BLOCK_DOCS and bound[b] >= scores[docs].max() and blocks.least[b] == docs.min()
        assert sorted(blocks.docs) == np.flatnonzero(dense[:, own[0]]).tolist()
    assert shard.scored < 20 * n / 4  # far fewer than documents times queries
