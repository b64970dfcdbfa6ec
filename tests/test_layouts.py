"""Membership in tables against plain sets, and plans of bucketed joins."""

import random

import pytest
from pyspark.sql import functions as F

from folkscope.operators import membership as M
from folkscope.queries import QUERIES
from folkscope.sources import buckets as B

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("kind", ["long", "string", "double"])
def test_members_are_those_of_a_plain_set(spark, kind):
    rng = random.Random(3)
    values = [rng.choice([None, *range(200)]) for _ in range(1_000)]
    keys = [None, None] + [rng.randrange(300) for _ in range(60)] * 2
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int").withColumn("v", F.col("v").cast(kind))
    table = spark.createDataFrame([(k, "clash") for k in keys], "v int, i string")
    wanted = {i for i, v in enumerate(values) if v is not None and v in set(keys)}
    assert sorted(r.i for r in M.in_table(rows, "v", table, "v").collect()) == sorted(wanted)
    assert sorted(r.i for r in M.not_in_table(rows, "v", table, "v").collect()) == sorted(set(range(1_000)) - wanted)
    flags = {r.i: r.member for r in M.flag_in_table(rows, "v", table, "v", "member").collect()}
    assert len(flags) == 1_000 and {i for i, f in flags.items() if f} == wanted


def test_empty_sets_and_tables(spark):
    rows, none = spark.createDataFrame([(1, 5)], "i int, v int"), spark.createDataFrame([], "k long")
    assert M.in_table(rows, "v", none, "k").count() == 0
    assert M.not_in_table(rows, "v", none, "k").count() == 1
    assert M.in_table(rows.where("false"), "v", spark.range(3), "id").count() == 0


def test_a_set_beyond_the_bound_goes_without_a_filter(spark):
    rows = spark.range(100).withColumnRenamed("id", "v")
    kept = M.in_table(rows, "v", spark.range(50, 300), "id", n_keys=1 << 40)
    assert M.filter_bits(1 << 40) is None and "ubquery" not in plan(kept)
    assert kept.count() == 50


def test_the_filter_errs_seldom_and_on_one_side_only(spark):
    keys = spark.range(20_000).select((F.col("id") * 7 + 1).alias("k"))
    bits = M.filter_bits(20_000)
    words = M.bloom_words(keys, "k", bits).scalar()
    passed = spark.range(200_000).where(M.may_contain(words, F.col("id"), bits)).select("id").collect()
    members = {7 * i + 1 for i in range(20_000)}
    passed = {r.id for r in passed}
    assert {m for m in members if m < 200_000} <= passed
    assert len(passed - members) < 0.01 * 200_000


def test_rows_without_a_partner_are_not_shuffled(spark, no_broadcast):
    rows = spark.range(100_000).select(F.col("id").alias("v"), F.lit("x").alias("rest")).repartition(4)
    keys = spark.range(0, 100_000, 500)
    kept = M.in_table(rows, "v", keys, "id", n_keys=200)
    assert kept.count() == 200
    text = plan(kept)
    join = text[text.index("LeftSemi") :]
    # Below the join: an exchange, and below that the filter with the subquery of the words.
    assert 0 < join.index("Exchange hashpartitioning") < join.index("+- Filter") < join.index("ubquery")
    bits = M.filter_bits(200)
    words = M.bloom_words(keys, "id", bits).scalar()
    assert rows.where(M.may_contain(words, F.col("v"), bits)).count() < 2_000


def test_bucketed_join_and_totals_move_no_rows(spark, no_broadcast):
    out = QUERIES["join_bucketed"](spark, FOLDER)
    text = plan(out)
    assert "SortMergeJoin" in text and "Exchange" not in text
    out.collect()
    assert "Exchange" not in plan(out)


def test_star_chain_fact_join_and_repeated_aggregate_without_exchange(spark, no_broadcast, tmp_path):
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_partkey", "l_extendedprice")
    parts = spark.read.parquet(f"{FOLDER}/part.parquet").select("p_partkey", "p_type")
    facts, dimension = B.write_bucketed(lines, "l_partkey", 8), B.write_bucketed(parts, "p_partkey", 8)
    joined = facts.join(dimension, F.col("l_partkey") == F.col("p_partkey"))
    assert "Exchange" not in plan(joined)
    once = joined.groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("s"))
    again = joined.groupBy("l_partkey").agg(F.max("l_extendedprice").alias("m"))
    both = once.join(again, "l_partkey")
    assert "Exchange" not in plan(both)
    plain = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_partkey").agg(F.max("l_extendedprice").alias("m"))
    assert sorted(map(tuple, both.select("l_partkey", "m").collect())) == sorted(map(tuple, plain.collect()))


def test_files_of_an_earlier_application_are_registered(spark, no_broadcast, tmp_path):
    frame = spark.createDataFrame([(i % 50, i) for i in range(500)] + [(None, -1)], "k int, v int")
    B.write_bucketed(frame, "k", 8, name="buckets_written", path=str(tmp_path / "t"))
    assert len(list((tmp_path / "t").glob("*.parquet"))) <= 8
    back = B.register_bucketed(spark, "buckets_again", str(tmp_path / "t"), "k int, v int", "k", 8)
    assert back.count() == 501 and "Exchange" not in plan(back.groupBy("k").count())
    for name in ("buckets_written", "buckets_again"):
        spark.sql(f"DROP TABLE {name}")


def test_bucket_counts_and_shares(spark):
    assert [B.bucket_count(n, 100) for n in (0, 800, 801, 10_000)] == [8, 8, 16, 128]
    hot = spark.range(100).select(F.when(F.col("id") < 60, 1).otherwise(F.col("id")).alias("k"))
    assert B.largest_bucket_share(hot, "k", 8) >= 0.6
    assert B.largest_bucket_share(hot.where("false"), "k", 8) == 0
