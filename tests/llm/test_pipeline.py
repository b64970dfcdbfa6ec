import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from folkscope.llm import decontaminate, quality, simhash, tokens

WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha je ki lo mu".split() for b in "ran ten lin son tur mar pel".split()]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choices(WORDS, k=n))
    benchmark = [(i, text(25)) for i in range(6)] + [(9, None)]
    rows, labels = [], []
    for i in range(400):
        bad = rng.random() < 0.3
        body = text(rng.randint(30, 200))
        rows.append((i, " ".join(w.upper() + "$$%" for w in body.split()) if bad else body, "en", f"s{i % 4}" if i % 9 else None, len(body)))
        if i < 350:
            labels.append((i, int(not bad), 0))
    for i in range(400, 420):  # exact copies
        rows.append((i, rows[3 if rows[3][1].islower() else 4][1], "en", "s0", 1))
    for i in range(420, 440):  # with benchmark passages
        rows.append((i, text(40) + " " + benchmark[i % 6][1] + " " + text(40), "en", "s1", 1))
    rows += [(500, None, None, None, None), (501, "", "en", "s2", 0), (502, text(50_000), "en", "s3", 9), (None, text(60), "en", "s1", 3)]
    rows += [rows[10], rows[10], (rows[11][0], text(80), "en", "s1", 5), (503, benchmark[2][1], "en", "s2", 2)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], P.DOCUMENT + ", name string")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def outputs(spark, folder, tmp_path_factory):
    """What each stage gets and gives."""
    docs, found = P.documents(spark.read.parquet(f"{folder}/documents.parquet")), []
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp(name)) + "/out"
        stage(spark, docs, folder).write.parquet(path)
        out = spark.read.parquet(path)
        found.append((docs.collect(), out.collect(), out.columns))
        docs = out
    return found


def test_columns(outputs):
    assert [c for *_, c in outputs[:-1]] == [P.COLUMNS] * 4
    assert outputs[-1][2] == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_quality_stage(spark, folder, outputs):
    before, after, _ = outputs[0]
    docs = P.documents(spark.read.parquet(f"{folder}/documents.parquet"))
    model = quality.fit_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = quality.score_documents(docs, model, P.DOCUMENT + ", score double").collect()
    assert Counter(map(tuple, after)) == Counter(tuple(r)[:-1] for r in scores if r.score >= 0.5)
    good = [r for r in before if r.text and r.text.islower()]
    kept = Counter(map(tuple, after))
    assert sum(tuple(r) in kept for r in good) > 0.97 * len(good)
    assert sum(bool(r.text) and r.text.isupper() for r in after) < 5


def test_near_duplicate_stage(outputs):
    before, after, _ = outputs[1]
    fps = [simhash.fingerprint((r.text or "").encode()) for r in before]
    label = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    want = []
    for root in set(label):
        members = [before[i] for i in range(len(before)) if label[i] == root]
        smallest = min((m.doc_id for m in members if m.doc_id is not None), default=None)
        want.append(smallest)
    assert Counter(r.doc_id for r in after) == Counter(want)
    assert not Counter(map(tuple, after)) - Counter(map(tuple, before))


def test_decontamination_stage(spark, folder, outputs):
    before, after, _ = outputs[2]
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.text]
    windows = {tuple(w[k : k + 10]) for w in map(str.split, items) for k in range(len(w) - 9)}
    want = []
    for r in before:
        words, hit = (r.text or "").split(), set()
        for k in range(len(words) - 9):
            if tuple(x.lower() for x in words[k : k + 10]) in windows:
                hit |= set(range(k, k + 10))
        left = [w for k, w in enumerate(words) if k not in hit]
        if left or not hit:
            want.append((r.doc_id, tuple(left)))
    assert Counter((r.doc_id, tuple((r.text or "").split())) for r in after) == Counter(want)
    same = {tuple(r) for r in before}
    assert all(tuple(r) in same or r.n_chars == len(r.text) for r in after)
    assert len(want) < len(before)


def test_mixing_stage(outputs):
    before, after, _ = outputs[3]
    times = Counter(map(tuple, after))
    copies = Counter(map(tuple, before))
    assert all(n <= 2 * copies[row] for row, n in times.items())
    total = sum(len((r.text or "").split()) for r in before)
    taken = sum(len((r.text or "").split()) for r in after)
    assert abs(taken - 1.5 * total) <= 2 * max(len((r.text or "").split()) for r in before)


def test_token_stage(outputs):
    before, after, _ = outputs[4]
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
    ordered = sorted(after, key=lambda r: r.start)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:], strict=False))


def test_stages_on_repeated_and_nameless_rows(spark, folder):
    rows = [(1, "a b c d", "en", "s", 1)] * 3 + [(1, "other words", "en", "s", 1), (None, "a b c d", None, None, None), (None, None, None, None, None)] * 2
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], P.DOCUMENT + ", hit long, spans string")
    one = P.keep_one_of_each_group(spark, docs, folder).collect()
    assert Counter((r.doc_id, r.text) for r in one) == Counter([(1, "a b c d"), (1, "other words"), (None, None)])
    assert Counter(map(tuple, P.cut_benchmark(spark, docs, folder).collect())) == Counter(rows)
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
        stage(spark, docs, folder).count()


def test_run_ends_in_token_rows(spark, folder):
    assert P.run(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stages_call_their_operators():
    names = [name for name, _ in P.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]
    assert all(m.__name__.startswith("folkscope.llm") for m in (decontaminate, tokens)) and F is not None
