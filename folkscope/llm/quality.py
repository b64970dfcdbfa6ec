"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are built from labelled texts of either kind. A text that resembles good
ones becomes smaller with the good dictionary; the normalised difference of the two
compressed sizes, over the whole text and over its windows, and the text's own
compressibility are brought to a score from 0 to 1 by logistic regression on labelled rows
that the dictionaries have not seen.

Training uses at most ``MAX_SAMPLES`` labelled texts per label, the first ones in the order
of a digest of their ids, and at most ``SAMPLE_BYTES`` of each; both are parameters. So what
reaches the driver is bounded. Scoring is one pass over whole texts without a shuffle.

Defined cases: a null text is scored as an empty one; an empty text gets the share of good
labels; labels that are null, differ for one document, or belong to no document are not
learned; without labels of both kinds every score is that share, or 0.5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folkscope.llm.registry import read_table, register

MAX_SAMPLES = 3_000
SAMPLE_BYTES = 16_384
DICTIONARY_BYTES = 65_536
PIECE_BYTES = 4_096  # of which a dictionary's training samples are made
WINDOW_BYTES = 1_024
LEVEL = 3
RIDGE = 0.05
MIN_DICTIONARY_PIECES = 8


@dataclass(frozen=True)
class Model:
    """Dictionaries and the coefficients over standardised features; plain data, small, sent with the tasks."""

    good: bytes
    bad: bytes
    mean: tuple[float, ...] = ()
    spread: tuple[float, ...] = ()
    coefficients: tuple[float, ...] = ()
    prior: float = 0.5


class Features:
    """Compressed sizes of a text, as features."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        kinds = [zstandard.ZstdCompressionDict(data) for data in (good, bad)]
        for kind in kinds:
            kind.precompute_compress(level=LEVEL)
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.good, self.bad = (zstandard.ZstdCompressor(level=LEVEL, dict_data=kind, **plain) for kind in kinds)
        self.alone = zstandard.ZstdCompressor(level=1, **plain)

    def of(self, data: bytes) -> list[float]:
        size = len(data)
        good, bad = len(self.good.compress(data)), len(self.bad.compress(data))
        if size <= WINDOW_BYTES:
            windows = [(bad - good) / size]
        else:
            # Windows of nearly equal length, so that none is a short rest.
            count = math.ceil(size / WINDOW_BYTES)
            cuts = [size * k // count for k in range(count + 1)]
            view = memoryview(data)
            pieces = [view[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            windows = [(len(self.bad.compress(p)) - len(self.good.compress(p))) / len(p) for p in pieces]
        return [
            (bad - good) / (bad + good),
            (bad - good) / size,
            math.log(len(self.alone.compress(data)) / size),
            min(windows),
            max(windows),
        ]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Coefficients of a ridge logistic regression, by Newton steps until they stand still."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (y - p) - penalty @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), slope)
        step *= min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        w = w + step
        if np.abs(step).max() < 1e-8:
            return w
    raise ArithmeticError("the calibration did not settle")


def train(samples: list[tuple[bytes, int]]) -> Model:
    """A model from (text, label) samples: every other one builds the dictionaries, the rest calibrate."""
    import zstandard

    samples = [(data, label) for data, label in samples if data]
    prior = (sum(label for _, label in samples) + 1) / (len(samples) + 2) if samples else 0.5
    by_label = [[data for data, label in samples if label == k] for k in (0, 1)]
    pieces = [[d[i : i + PIECE_BYTES] for d in texts[::2] for i in range(0, len(d), PIECE_BYTES)] for texts in by_label]
    held = [(data, k) for k in (0, 1) for data in by_label[k][1::2]]
    if min(len(p) for p in pieces) < MIN_DICTIONARY_PIECES or len({k for _, k in held}) < 2:
        return Model(b"", b"", prior=prior)

    def dictionary(parts: list[bytes]) -> bytes:
        size = min(DICTIONARY_BYTES, max(1_024, sum(map(len, parts)) // 8))
        try:
            return zstandard.train_dictionary(size, parts).as_bytes()
        except zstandard.ZstdError:  # too little or too uniform for the trainer: the texts themselves serve
            return b"".join(parts)[:DICTIONARY_BYTES]

    bad, good = map(dictionary, pieces)
    features = Features(good, bad)
    x, y = np.array([features.of(data) for data, _ in held]), np.array([k for _, k in held], float)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = logistic(np.column_stack([np.ones(len(x)), (x - mean) / spread]), y)
    # Samples are drawn per label; the intercept goes back to the labels' true shares with score_documents.
    return Model(good, bad, tuple(mean), tuple(spread), tuple(w), prior)


def labelled_samples(docs: DataFrame, labels: DataFrame, max_samples: int, sample_bytes: int) -> tuple[list[tuple[bytes, int]], float]:
    """A bounded sample per label, in the order of a digest of the ids, and the share of good among all labels."""
    one = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("labelled_id"))
        .agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
        .where("label = other")
    )
    good_share = one.agg(F.avg("label").alias("share")).first()["share"]
    order = [F.xxhash64("labelled_id"), F.col("labelled_id")]
    picked = [one.where(F.col("label") == k).orderBy(*order).limit(max_samples) for k in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]).select("labelled_id", "label"))  # at most 2 * max_samples rows
    text = F.substring(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8"), 1, sample_bytes)
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("data"))
        .join(chosen, F.col("doc_id") == F.col("labelled_id"))
        .groupBy("doc_id", "label")
        .agg(F.min("data").alias("data"))  # one text per label, whatever rows repeat
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .collect()
    )
    return [(bytes(r["data"]), r["label"]) for r in rows], 0.5 if good_share is None else float(good_share)


def fit_quality(docs: DataFrame, labels: DataFrame, max_samples: int = MAX_SAMPLES, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from all given labels of documents, by way of a bounded sample."""
    samples, good_share = labelled_samples(docs, labels, max_samples, sample_bytes)
    model = train(samples)
    if not model.coefficients:
        return Model(b"", b"", prior=good_share if samples else 0.5)
    # Where one label was sampled more sparsely, the intercept moves by the difference of log odds.
    share = sum(label for _, label in samples) / len(samples)
    shift = math.log(good_share / (1 - good_share)) - math.log(share / (1 - share))
    coefficients = (model.coefficients[0] + shift, *model.coefficients[1:])
    return Model(model.good, model.bad, model.mean, model.spread, coefficients, good_share)


def score_documents(docs: DataFrame, model: Model, keep: str = "doc_id long, score double") -> DataFrame:
    """Each document's score; only the text is looked at.

    ``docs`` has ``text``; of its other columns those named in ``keep`` come along.
    """
    names = [part.split()[0] for part in keep.split(", ") if not part.startswith("score ")]
    sent = names if "text" in names else [*names, "text"]
    at = sent.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.good, model.bad) if model.coefficients else None
        mean, spread, w = (np.array(v) for v in (model.mean, model.spread, model.coefficients))
        for batch in batches:
            scores = np.full(batch.num_rows, model.prior)
            if features is not None:
                texts = batch.column(at).cast(pa.large_binary()).to_pylist()
                full = [k for k, t in enumerate(texts) if t]
                if full:
                    x = (np.array([features.of(texts[k]) for k in full]) - mean) / spread
                    scores[full] = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(scores)], names=[*names, "score"])

    return docs.select(*sent).withColumn("text", F.col("text").cast("string")).mapInArrow(run, keep)


def is_held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


@register("op9_quality_score")
def op9_quality_score(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's score, learned from the labels that are not held out."""
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    model = fit_quality(docs, labels.where(~is_held_out(F.col("doc_id"))))
    return score_documents(docs, model).select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
