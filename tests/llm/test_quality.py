import random
import zlib

import pytest

from folkscope.llm import quality as Q

WORDS = "river stone light under morning garden answer winter letter silver yellow bridge mountain simple".split()


def text_of(rng, good):
    words = [rng.choice(WORDS) for _ in range(rng.randint(40, 300))]
    return " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!$$" for w in words)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    kinds = {i: int(rng.random() < 0.7) for i in range(600)}
    docs = spark.createDataFrame([(i, text_of(rng, k), "clash") for i, k in kinds.items()], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, k, 0) for i, k in kinds.items()], "doc_id long, quality int, toxic int")
    return docs.cache(), labels.cache(), kinds


def test_held_out_accuracy(tables):
    docs, labels, kinds = tables
    model = Q.fit_quality(docs, labels.where(~Q.is_held_out(labels.doc_id)))
    out = {r.doc_id: r.score for r in Q.score_documents(docs, model).collect()}
    held = [i for i in kinds if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((out[i] >= 0.5) == kinds[i] for i in held) > 0.97 * len(held)
    assert all(0 <= s <= 1 for s in out.values())


def test_held_out_labels_do_not_matter(tables, spark):
    docs, labels, _ = tables
    turned = labels.withColumn("quality", Q.F.when(Q.is_held_out(labels.doc_id), 1 - labels.quality).otherwise(labels.quality))
    models = [Q.fit_quality(docs, t.where(~Q.is_held_out(t.doc_id))) for t in (labels, turned)]
    assert models[0] == models[1]


def test_odd_rows(tables, spark):
    docs, labels, _ = tables
    model = Q.fit_quality(docs.union(docs), labels.union(labels), max_samples=50)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (None, "x"), (3, "é " * 100_000)], "doc_id long, text string")
    out = Q.score_documents(odd, model).collect()
    assert len(out) == 5 and out[0].score == out[1].score and out[2].score == out[3].score


def test_without_usable_labels(tables, spark):
    docs, labels, _ = tables
    none = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1)], "doc_id long, quality int")
    assert {r.score for r in Q.score_documents(docs, Q.fit_quality(docs, none)).collect()} == {0.5}
    only = labels.where("quality = 1")
    assert {r.score for r in Q.score_documents(docs, Q.fit_quality(docs, only)).collect()} == {1.0}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert Q.score_documents(empty, Q.fit_quality(empty, labels)).count() == 0
