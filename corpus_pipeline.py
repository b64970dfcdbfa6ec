"""The corpus pipeline: documents become mixed, clean token files in five stages.

Each stage takes ``(spark, docs, sf_dir)``; what it returns is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of documents.

Defined cases: every stage takes null, empty and very long texts, repeated rows, empty
tables and further columns as its operator says; columns besides the ones of documents are
dropped by the first stage.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folkscope.llm.decontaminate import cut_words, find_contamination
from folkscope.llm.mixing import label_weights, mix_sources
from folkscope.llm.quality import fit_quality, score_documents
from folkscope.llm.registry import read_table
from folkscope.llm.simhash import RADIUS, SHINGLE_WORDS, near_duplicates
from folkscope.llm.tokens import token_output
from folkscope.session import scratch_path

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = [part.split()[0] for part in DOCUMENT.split(", ")]
MIN_SCORE = 0.5


def documents(docs: DataFrame) -> DataFrame:
    """The columns of documents in their types, whatever else the table holds."""
    types = dict(part.split() for part in DOCUMENT.split(", "))
    return docs.select(*(F.col(c).cast(types[c]).alias(c) for c in COLUMNS))


def named(docs: DataFrame) -> DataFrame:
    """Documents with a ``name`` that only equal rows share, as rows may repeat a doc_id or have none."""
    docs = documents(docs)
    return docs.withColumn("name", F.xxhash64(*COLUMNS))


def with_names(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Documents of the given names, once each. ``names``: name, rows (how many rows have it), and further columns."""
    further = [c for c in names.columns if c not in ("name", "rows")]
    found = docs.join(names.withColumnRenamed("name", "wanted"), F.col("name") == F.col("wanted")).select(*COLUMNS, "name", "rows", *further)
    return found.where("rows = 1").unionByName(found.where("rows > 1").dropDuplicates(["name"])).drop("name", "rows")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts; it learns from all labels of the given documents."""
    docs = documents(docs)
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return score_documents(docs, model, f"{DOCUMENT}, score double").where(F.col("score") >= MIN_SCORE).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies; where none has a doc_id, any one.

    Near copies have SimHash fingerprints over three-word shingles that differ in at most 3 of
    64 bits, over any number of links.
    """
    docs = named(docs)
    rows = near_duplicates(docs, RADIUS, SHINGLE_WORDS, carry="name")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "name")).alias("first")
    counted = rows.groupBy("root", "doc_id", "name").agg(F.count(F.lit(1)).alias("rows"))
    chosen = counted.groupBy("root").agg(first).select(F.col("first.name").alias("chosen"))
    names = counted.join(chosen, F.col("name") == F.col("chosen")).select("name", "rows")
    return with_names(docs, names)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their benchmark passages; one that has no word left goes."""
    docs = named(docs)
    found = find_contamination(docs.select(F.col("name").alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    hits = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("hit"), "spans").distinct()

    def run(batches):
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            texts = columns["text"].to_pylist()
            for k, spans in enumerate(columns["spans"].to_pylist()):
                texts[k] = cut_words(texts[k].encode(), [(s["begin"], s["end"]) for s in spans]).decode()
            columns["text"], columns["n_chars"] = pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([columns[c] for c in COLUMNS], names=COLUMNS)

    marked = docs.join(hits, F.col("name") == F.col("hit"), "left")
    clean = marked.where("spans is null").select(*COLUMNS)
    cut = marked.where("spans is not null").select(*COLUMNS, "spans").mapInArrow(run, DOCUMENT)
    return clean.unionByName(cut.where(F.col("text").rlike(r"[A-Za-z0-9]|[^\x00-\x7F]")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights: a document stands once for each time it is taken."""
    docs = named(docs)
    mixed = mix_sources(docs, label_weights(read_table(spark, sf_dir, "labels")), carry="name")
    times = F.sum(F.col("epochs") + F.col("picked").cast("long")).cast("int").alias("times")
    taken = mixed.groupBy("name").agg(F.count(F.lit(1)).alias("rows"), times).where("times > 0")
    found = with_names(docs, taken)
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents in ascending doc_id, and what they hold."""
    return token_output(documents(docs))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", cut_benchmark),
    ("mixing", mix),
    ("tokens", write_tokens),
]

#: Compression, fingerprints and token files have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared scratch folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
