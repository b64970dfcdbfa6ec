"""Mixing sources to target weights: weighted sampling without replacement to word budgets.

Each document draws an exponential key, ``-ln(u) / weight`` (Efraimidis and Spirakis,
"Weighted random sampling with a reservoir", 2006); ``u`` comes from a digest of its id, size
and text, so reruns agree and rows of one id, or of none, do not share a key unless they are equal. A source takes whole epochs of all its documents first, then, in order of
the keys, documents until the rest of its target is met. Sums of sizes in key order are
formed in two levels: per slice of the key range, then within a slice, so a source with a
third of all rows is spread over many tasks.

Everything here is DataFrame expressions. Only the table of sources, one row each, is
ordered as a whole.

Defined cases: a null text has size 0; a null source is a source and comes last; documents
of size 0 are taken never or in whole epochs without effect; repeated rows count each, with
ties in the key broken by size; weights that are null or not above 0 count as 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folkscope.llm.registry import read_table, register
from folkscope.session import materialise

CYCLE = (5, 2, 1)  # weights of sources in their order, repeating
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2.0
SLICE_ROWS = 4_000  # rows of a source per slice of its key range
WORDS = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def uniform(doc_id: Column, size: Column, text_digest: Column) -> Column:
    """A number in (0, 1) from the id, the size and the text: 52 bits of an MD5. Rows that share an id, or have none, still spread."""
    digest = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), size.cast("string"), text_digest))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, cycle: tuple[int, ...], total_share: float, max_epochs: float) -> DataFrame:
    """One row per source: rows, source_size, target.

    Sharing by weight with a cap per source, the excess reshared until none is above, ends
    at one level: ``target = min(cap, level * weight)``. With sources in order of cap over
    weight, those before some place are capped; the level is what the others share, and
    the first place whose source stays within its cap has it, the largest such level.
    """
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(F.col("place") - 1, F.lit(len(cycle))) + 1).cast("int"))
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
        .withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("share", weight.cast("double"))
        .withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    )
    order = Window.orderBy(F.col("cap") / F.col("share"), "place")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    wanted = F.lit(total_share) * F.sum("source_size").over(whole)
    level = (wanted - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("share").over(rest)
    return (
        sources.withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") * F.col("share") <= F.col("cap"), F.col("level"))).over(whole))
        .withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("share"), F.col("cap"))))
        .select("source", "source_size", "source_rows", "target")
    )


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    cycle: tuple[int, ...] = CYCLE,
    total_share: float = TOTAL_SHARE,
    max_epochs: float = MAX_EPOCHS,
    slice_rows: int = SLICE_ROWS,
    carry: str | None = None,
) -> DataFrame:
    """How many words the mix takes of each document.

    ``docs`` has doc_id, text and source; ``weights`` may give a quality ``weight`` for a
    doc_id, once each; ``carry`` names a further column that comes along. Returns doc_id, source, size, key, source_size, target, epochs (whole
    passes of its source), picked (taken once more), taken.
    """
    also = [carry] if carry else []
    size = word_count(F.col("text").cast("string")).alias("size")
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_digest")
    sizes = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size, digest, *also)
    if weights is not None:
        named = weights.select(F.col("doc_id").cast("long").alias("weighted_id"), "weight")
        sizes = sizes.join(named, F.col("doc_id") == F.col("weighted_id"), "left").drop("weighted_id")
    else:
        sizes = sizes.withColumn("weight", F.lit(1.0))
    usable = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    keyed = sizes.select("doc_id", "source", "size", *also, (-F.log(uniform(F.col("doc_id"), F.col("size"), F.col("text_digest"))) / usable).alias("key"))
    keyed = materialise(keyed, "mix-keys")  # words are counted once, and every pass sees the same keys

    targets = source_targets(keyed, cycle, total_share, max_epochs)
    targets = materialise(
        targets.select(
            F.col("source").alias("of"), "source_size", "target",
            F.greatest(F.lit(1), F.ceil(F.col("source_rows") / slice_rows)).alias("slices"),
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("epochs"),
        ).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")),
        "mix-targets",
    )

    # exp(-key) falls as the key grows and lies in (0, 1): slices by it are in the order of the keys.
    slice_of = F.floor((1 - F.exp(-F.col("key"))) * F.col("slices"))
    sliced = keyed.join(targets, F.col("source").eqNullSafe(F.col("of"))).withColumn("slice", slice_of)
    earlier = Window.partitionBy("of").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        sliced.groupBy("of", "slice")
        .agg(F.sum("size").alias("slice_size"))
        .select(
            F.col("of").alias("slice_source"), F.col("slice").alias("slice_no"),
            F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)).alias("before"),
        )
    )
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sliced.withColumn("upto", F.sum("size").over(inside)).join(
        slices, F.col("source").eqNullSafe(F.col("slice_source")) & (F.col("slice") == F.col("slice_no"))
    )
    # The document in which the rest ends is taken if that comes nearer to the target.
    middle = F.col("before") + F.col("upto") - F.col("size") / 2
    picked = (F.col("size") > 0) & (middle < F.col("rest"))
    return placed.select(
        "doc_id", "source", "size", "key", "source_size", "target",
        F.col("epochs").cast("long").alias("epochs"),
        picked.alias("picked"),
        (F.col("size") * (F.col("epochs") + picked.cast("long"))).cast("long").alias("taken"),
        *also,
    )


def label_weights(labels: DataFrame) -> DataFrame:
    """Quality weights from labels: 2 for good, 1/2 for bad, between them where labels of a document differ."""
    mean = F.avg(F.col("quality").cast("double"))
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.pow(F.lit(2.0), 2 * mean - 1).alias("weight"))


MIX_SQL = """
WITH s AS (
    SELECT doc_id, source, CASE WHEN text IS NULL THEN 0
        ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size,
        md5(coalesce(text, '')) AS text_digest FROM documents
), w AS (
    SELECT doc_id AS weighted_id, pow(2.0, 2 * avg(quality::DOUBLE) - 1) AS weight FROM labels
    WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), k AS (
    SELECT doc_id, source, size,
        -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || size || ':' || text_digest), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
            / CASE WHEN weight > 0 THEN weight ELSE 1.0 END AS key
    FROM s LEFT JOIN w ON doc_id = weighted_id
), p AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM k GROUP BY source
), c AS (
    SELECT *, 2.0 * source_size AS cap, [5.0, 2.0, 1.0][(place - 1) % 3 + 1]::DOUBLE AS share FROM p
), l AS (
    SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / share, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(share) OVER (ORDER BY cap / share, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c
), m AS (
    SELECT *, least(cap, coalesce(max(CASE WHEN level * share <= cap THEN level END) OVER () * share, cap)) AS target FROM l
), t AS (
    SELECT source AS of, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM m
), r AS (
    SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS rest,
        sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0 AS middle
    FROM k JOIN t ON source IS NOT DISTINCT FROM of
)
SELECT doc_id, size, source_size, target,
    (size * (epochs + CASE WHEN size > 0 AND middle < rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""


@register("op5_source_mix", MIX_SQL)
def op5_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, mixed to the contract's weights."""
    weights = label_weights(read_table(spark, folder, "labels"))
    mixed = mix_sources(read_table(spark, folder, "documents"), weights)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
