"""Null, tie, skew and order cases of the operators against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folkscope.fixed_values import ACCEPTANCE_LEVELS, CULTURE_CODES, IMPORTANCE_LEVELS, NAME_ALIASES
from folkscope.operators import aggregates, joins, missing, ordering, profile, reshape, survey
from folkscope.operators.quantiles import exact_quantiles
from folkscope.plans import culture, films
from folkscope.sources import delimited, records

# Published weighted answers of two countries, their majority and merged levels.
RELIGION = [
    ("Argentina", "Very important", 480.212463884697, 1035.0, 0.463973395057678),
    ("Argentina", "Somewhat important", 212.166835074897, 1035.0, 0.204992111183475),
    ("Argentina", "Not too important", 181.753070521621, 1035.0, 0.175606831421856),
    ("Argentina", "Not at all important", 150.415299193442, 1035.0, 0.145328791491248),
    ("Argentina", "Dont know (DO NOT READ)", 3.90886554152692, 1035.0, 0.0037766816826347),
    ("Argentina", "Refused (DO NOT READ)", 6.54346578381713, 1035.0, 0.00632218916310833),
]
ACCEPTANCE = [
    ("Argentina", "Homosexuality should be accepted by society", 790.943084174895, 0.764196216594101),
    ("Argentina", "Homosexuality should not be accepted by society", 197.709831767548, 0.19102399204594),
    ("Argentina", "Dont know (DO NOT READ)", 18.2484332844827, 0.0176313365067466),
    ("Argentina", "Refused (DO NOT READ)", 28.0986507730747, 0.0271484548532123),
]
MERGED = {"religion_Neut": 10.452331325344, "religion_Y": 692.379298959594, "lgbtqi_Neut": 46.3470840575574}


def test_published_shares_majority_and_merged_levels(spark):
    rows = spark.createDataFrame([(c, a, n) for c, a, n, _, _ in RELIGION], "country string, answer string, weight double")
    shares = aggregates.weighted_shares(rows, "country", "answer").collect()
    published = {a: (size, share) for _, a, _, size, share in RELIGION}
    for row in shares:
        assert row.weighted_group_size == pytest.approx(published[row.answer][0], abs=1e-9)
        assert row.weighted_estimate == pytest.approx(published[row.answer][1], abs=1e-12)
    best = aggregates.majority(spark.createDataFrame(shares), "country", "weighted_estimate").collect()
    assert [r.answer for r in best] == ["Very important"]

    names = {k: f"religion_{v}" for k, v in IMPORTANCE_LEVELS.items()}
    wide = reshape.pivot_wide(rows, ["country"], "answer", "weight", names)
    merged = survey.collapse_levels(wide, survey.importance_merges("religion")).first()
    assert merged.religion_Neut == pytest.approx(MERGED["religion_Neut"], abs=1e-9)
    assert merged.religion_Y == pytest.approx(MERGED["religion_Y"], abs=1e-9)

    accepted = spark.createDataFrame([(c, a, n) for c, a, n, _ in ACCEPTANCE], "country string, answer string, weight double")
    names = {k: f"lgbtqi_{v}" for k, v in ACCEPTANCE_LEVELS.items()}
    wide = reshape.pivot_wide(accepted, ["country"], "answer", "weight", names)
    merged = survey.collapse_levels(wide, {"lgbtqi_Neut": ("lgbtqi_DK", "lgbtqi_R")}).first()
    assert merged.lgbtqi_Neut == pytest.approx(MERGED["lgbtqi_Neut"], abs=1e-9)


def test_collapse_keeps_a_missing_operand_missing(spark):
    df = spark.createDataFrame([("Australia", 3.6, None)], "country string, g_DK double, g_R double")
    assert survey.collapse_levels(df, {"g_Neut": ("g_DK", "g_R")}).first().g_Neut is None


def test_strict_aggregates_void_on_missing_input(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), (None, 4.0)], "k string, w double")
    rows = df.groupBy("k").agg(
        aggregates.strict_sum("w").alias("s"), aggregates.strict_mean("w").alias("m")
    )
    assert {r.k: (r.s, r.m) for r in rows.collect()} == {"a": (None, None), "b": (2.0, 2.0), None: (4.0, 4.0)}
    assert {r.k: r.w for r in aggregates.maximum(df, ["k"], "w").collect()} == {"a": None, "b": 2.0, None: 4.0}


def test_group_total_keeps_missing_keys_and_hot_groups(spark):
    rows = [("hot" if i % 3 else None, float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double")
    out = aggregates.attach_group_total(df, ["k"], "v", "total").collect()
    totals = defaultdict(float)
    for k, v in rows:
        totals[k] += v
    assert len(out) == len(rows) and all(r.total == totals[r.k] for r in out)


def test_majority_keeps_ties(spark):
    df = spark.createDataFrame([("x", "p", 0.5), ("x", "q", 0.5), ("y", "p", 0.1), ("y", "q", 0.9)], "c string, a string, s double")
    assert sorted((r.c, r.a) for r in aggregates.majority(df, "c", "s").collect()) == [("x", "p"), ("x", "q"), ("y", "q")]


@pytest.mark.parametrize("hot", [0.0, 0.7])
def test_row_index_numbers_every_row_once_in_order(spark, hot):
    rng = random.Random(5)
    rows = [(7 if rng.random() < hot else rng.randint(0, 10_000), i) for i in range(20_000)]
    df = spark.createDataFrame(rows, "v long, id long").repartition(8)
    out = ordering.row_index(df, [F.desc("v")], "i").orderBy("i").collect()
    assert [r.i for r in out] == list(range(1, len(rows) + 1))
    assert [r.v for r in out] == sorted((v for v, _ in rows), reverse=True)
    assert sorted(r.id for r in out) == list(range(len(rows)))


def test_row_index_spreads_one_hot_value(spark):
    df = spark.range(40_000).select(F.lit(1).alias("v"), "id").repartition(8)
    staged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(8, "v", "_tie")
    sizes = [r["count"] for r in staged.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 10_000


def test_row_index_of_an_empty_table(spark):
    assert ordering.row_index(spark.range(0), ["id"]).count() == 0


def test_bind_and_drop_positions(spark):
    a = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, x string")
    b = spark.createDataFrame([(30,), (10,), (20,)], "y int")
    assert sorted((r.x, r.y) for r in ordering.bind_columns(a, b, ["k"], ["y"]).collect()) == [("a", 10), ("b", 20), ("c", 30)]
    assert [r.x for r in ordering.drop_positions(a, ["k"], [2]).orderBy("k").collect()] == ["a", "c"]


def test_top_n_keeps_all_ties_and_skips_missing(spark):
    df = spark.createDataFrame([(5,), (5,), (4,), (4,), (4,), (3,), (None,)], "v int")
    assert sorted(r.v for r in ordering.top_n_ties(df, "v", 3).collect()) == [4, 4, 4, 5, 5]
    assert ordering.top_n_ties(df, "v", 100).count() == 6


def test_pivot_names_by_value_and_missing_level(spark):
    df = spark.createDataFrame([("x", "b", 1), ("x", None, 2), ("y", "a", 3)], "id string, k string, v int")
    wide = reshape.pivot_wide(df, ["id"], "k", "v")
    assert wide.columns == ["id", "NA", "a", "b"]
    assert {r.id: tuple(r)[1:] for r in wide.collect()} == {"x": (2, None, 1), "y": (None, 3, None)}
    named = reshape.pivot_wide(df, ["id"], "k", "v", {"b": "second", "a": "first"})
    assert named.columns == ["id", "second", "first"]


def test_unbounded_pivot_is_refused(spark):
    with pytest.raises(ValueError, match="more than 10 levels"):
        reshape.bounded_levels(spark.range(50).selectExpr("CAST(id AS STRING) AS k"), ["k"], 10)


def test_level_profile_against_counts(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xxxxxyz"), rng.choice(["d", "e", None])) for _ in range(400)] + [("small", "d")] * 50
    df = spark.createDataFrame(rows, "c string, g string")
    grid = {(r.c, r.g): r.perc for r in reshape.level_profile(df, "c", "g").collect()}
    counts = Counter((c, g or "NA") for c, g in rows)
    totals = Counter(c for c, _ in rows)
    kept = [c for c, n in totals.items() if n > 50]
    assert "small" not in kept
    assert grid == {(c, g): round(100 * counts[c, g] / totals[c], 2) for c in kept for g in ("NA", "d", "e")}


def test_profile_accepts_level_names_with_dots(spark):
    df = spark.createDataFrame([("x", "a.b")] * 60, "c string, g string")
    assert reshape.level_profile(df, "c", "g").collect()[0].perc == 100.0


def test_recode_is_single_pass_and_exact(spark):
    df = spark.createDataFrame([("SLV",), ("SAL",), ("SALT",), ("XXX",), (None,)], "code string")
    assert [r.code for r in survey.recode(df, "code", CULTURE_CODES).collect()] == ["SVN", "SLV", "SALT", "XXX", None]
    names = spark.createDataFrame([("United States",), ("United States of America",), ("Korea, Rep.",)], "country string")
    out = survey.recode(names, "country", NAME_ALIASES["income"])
    assert [r.country for r in out.collect()] == ["United States of America", "United States of America", "South Korea"]
    assert len(CULTURE_CODES) == 48


def test_null_safe_join_matches_missing_keys(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, v int")
    b = spark.createDataFrame([(None, 20)], "k string, w int")
    assert {r.v: r.w for r in joins.null_safe_join(a, b, ["k"]).collect()} == {1: None, 2: 20}


def test_natural_join_needs_a_shared_column(spark):
    with pytest.raises(ValueError):
        joins.join_natural(spark.range(1), spark.range(1).toDF("other"), "left")


def test_adult_rules(spark):
    rows = [("X", "en", 10.0, "Action", "FALSE"), ("X", "en", 20.0, "Drama", "TRUE"), ("X", "en", 30.0, None, "FALSE")]
    df = spark.createDataFrame(rows, "production_countries_name string, original_language string, budget double, genres_name string, adult string")
    df = df.withColumn("release_date", F.lit("1/1/2012"))
    counts = {}
    for rule in films.ADULT_RULES:
        r = films.country_content(df, adult=rule).first()
        counts[rule] = (r.maturecontent_sum, r.notmature_sum)
    assert counts == {"ignore": (1, 1), "exclude": (1, 0), "as_mature": (2, 0)}
    with pytest.raises(ValueError):
        films.mature_flags(df, adult="other")


@pytest.mark.parametrize("accuracy,limit", [(10_000, 200_000), (50, 100), (50, 5), (1000, 100)])
def test_exact_quantiles_against_numpy(spark, accuracy, limit):
    rng = np.random.default_rng(3)
    smooth = rng.normal(size=5000)
    hot = np.where(rng.random(5000) < 0.4, 1.0, rng.integers(0, 4, 5000))
    rows = [(float(a), None if i % 7 == 0 else float(b), None) for i, (a, b) in enumerate(zip(smooth, hot))]
    df = spark.createDataFrame(rows, "a double, b double, empty double").repartition(8)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    out = {(r.feature, r.prob): r.value for r in exact_quantiles(df, ["a", "b", "empty"], probs, accuracy, limit).collect()}
    kept = [r[1] for r in rows if r[1] is not None]
    for p in probs:
        assert out["a", p] == pytest.approx(np.quantile(smooth, p), abs=1e-12)
        assert out["b", p] == pytest.approx(np.quantile(kept, p), abs=1e-12)
    assert not [k for k in out if k[0] == "empty"]


@pytest.mark.parametrize("order", ["up", "down", "zigzag", "hot"])
def test_exact_quantiles_on_adverse_orders_and_one_hot_value(spark, order):
    x = np.arange(20_000, dtype=float)
    x = {"up": x, "down": x[::-1], "zigzag": np.where(x % 2, x, -x), "hot": np.where(x % 3, 7.0, x)}[order]
    df = spark.createDataFrame([(float(v), float("nan") if i % 5 == 0 else 1.0) for i, v in enumerate(x)], "v double, w double").repartition(4)
    probs = [0.0, 0.001, 0.333, 0.5, 0.999, 1.0]
    out = {(r.feature, r.prob): r.value for r in exact_quantiles(df, ["v", "w"], probs, 200, 50).collect()}
    for p in probs:
        assert out["v", p] == pytest.approx(np.quantile(x, p), abs=1e-9) and out["w", p] == 1.0


def test_csv_round_trip_of_hostile_text(spark, tmp_path):
    from folkscope.sources import delimited

    texts = ['He said "hi", twice', "a,b;c", "line\nbreak", "closing backslash\\", "", None, " padded ", '"', "tab\tand é", "NA-ish", 'x"\n"y', "crlf\r\nend"]
    rows = [(i, t, i * 1.5 if i % 2 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, t string, v double")
    for sep in (",", ";"):
        path = f"{tmp_path}/{ord(sep)}"
        delimited.write_csv(df, path, sep=sep)
        back = delimited.read_csv(spark, path, "id int, t string, v double", sep=sep, multi_line=True)
        assert sorted(map(tuple, back.collect())) == rows
        both = delimited.read_csv_two_nulls(spark, path, back.schema, sep=sep, multi_line=True)
        assert sorted((r.id, r.t) for r in both.collect() if r.t is not None) == [(i, t) for i, t, _ in rows if t]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        delimited.read_csv(spark, f"{tmp_path}/44", "id int, t int, v double", multi_line=True).collect()


def test_ranges_with_gaps_and_their_size(spark, tmp_path):
    from folkscope.sources import delimited

    df = spark.createDataFrame([(1, "a"), (2, "b"), (1000, "c")], "id long, t string")
    delimited.write_id_ranges(df, "id", 100, f"{tmp_path}/r")
    read = lambda starts=None: {(r.id, r.t, r.range_start) for r in delimited.read_ranges(spark, f"{tmp_path}/r", "id long, t string", starts).collect()}
    assert read() == {(1, "a", 0), (2, "b", 0), (1000, "c", 1000)}
    assert read([1000, 500]) == {(1000, "c", 1000)}
    assert delimited.range_size(spark.range(1000), "id", 100) == 100
    assert delimited.range_size(spark.range(0), "id") == 1


def test_level_profile_counts_every_row_in_the_total(spark):
    rows = [("a", "Drama")] * 60 + [("a", None)] * 40 + [("b", "total")] * 51 + [("b", "drama")] * 51 + [("c", "Drama")] * 3
    df = spark.createDataFrame(rows, "c string, g string")
    grid = {(r.c, r.g): r.perc for r in reshape.level_profile(df, "c", "g").collect()}
    assert grid["a", "Drama"] == 60.0 and grid["a", "NA"] == 40.0 and grid["a", "total"] == 0.0
    assert grid["b", "total"] == 50.0 and grid["b", "drama"] == 50.0 and grid["b", "Drama"] == 0.0
    assert not any(c == "c" for c, _ in grid)
    listed = {(r.c, r.g): r.perc for r in reshape.level_profile(df, "c", "g", ["Drama"]).collect()}
    assert listed == {("a", "Drama"): 60.0, ("b", "Drama"): 0.0}


def test_level_profile_has_no_level_limit(spark):
    df = spark.range(10_000).selectExpr("CAST(id % 2 AS STRING) AS c", "CAST(id % 5000 AS STRING) AS g")
    out = reshape.level_profile(df, "c", "g")
    assert out.count() == 10_000 and out.filter("perc > 0").count() == 5_000


def test_pivot_refuses_unlisted_levels(spark):
    df = spark.createDataFrame([(1, "yes", 1.0), (1, "maybe", 2.0)], "id int, k string, v double")
    with pytest.raises(Exception, match="not listed: maybe"):
        reshape.pivot_wide(df, ["id"], "k", "v", ["yes", "no"]).collect()
    assert reshape.pivot_wide(df, ["id"], "k", "v", ["yes", "no"], unlisted="drop").first().yes == 1.0


def test_unreadable_records_are_told_from_records_without_id(spark, tmp_path):
    from folkscope.sources import records

    (tmp_path / "r.json").write_text('{"imdb_id": "a", "budget": 1.5}\n{"budget": 2}\n{"imdb_id": "b", \nnot json\n')
    rows = records.read_film_records(spark, str(tmp_path), ["imdb_id", "budget"]).collect()
    assert [tuple(r) for r in rows] == [("a", 1.5)]
    assert sorted(r[0] for r in records.unreadable_records(spark, str(tmp_path)).collect()) == ["not json", '{"imdb_id": "b", ']


def test_text_profile(spark):
    df = spark.createDataFrame([("a", 1), ("", 1), ("  ", 1), (None, 1), ("a", 1)], "t string, n int")
    assert profile.text_columns(df) == ["t"]
    row = profile.profile_text(df, ["t"]).first()
    assert (row.n_missing, row.complete_rate, row.min_chars, row.max_chars, row.empty, row.blank, row.n_distinct) == (1, 0.8, 0, 2, 1, 1, 3)


def test_level_index(spark):
    from folkscope.operators.ordering import level_index

    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), (None, 5), (None, 4)], "k string, v int")
    assert {(r.k, r.v): r.i for r in level_index(df, "k", ["v"], "i").collect()} == {("a", 1): 1, ("a", 3): 2, ("b", 2): 1, (None, 4): 1, (None, 5): 2}


def test_scratch_is_cleared(spark, tmp_path, monkeypatch):
    from folkscope import session

    # A folder of its own, so that what other tests have written stays.
    monkeypatch.setattr(session, "_application_scratch", lambda spark: f"{tmp_path}/scratch")
    assert session.materialise(spark.range(3)).count() == 3 and list((tmp_path / "scratch").iterdir())
    session.clear_scratch(spark)
    assert not (tmp_path / "scratch").exists()


def test_kolmogorov_smirnov_against_brute_force(spark):
    from statistics import NormalDist

    rng = np.random.default_rng(1)
    x = np.sort(rng.gamma(2.0, size=500))
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    curve = NormalDist(float(x.mean()), float(x.std(ddof=1)))
    cdf = np.array([curve.cdf(v) for v in x])
    n = len(x)
    distance = max(np.max(np.arange(1, n + 1) / n - cdf), np.max(cdf - np.arange(n) / n))
    assert profile.ks_normality(df, ["x"]).first().statistic == pytest.approx(distance, abs=1e-9)


def test_kolmogorov_smirnov_of_many_columns_in_fixed_jobs(spark):
    """Ties over several parts, missing values, a hot value and constant columns; as Spark's own test of one column."""
    from pyspark.ml.stat import KolmogorovSmirnovTest

    rng = np.random.default_rng(2)
    n = 4_000
    data = {
        "a": rng.normal(size=n), "b": np.round(rng.gamma(2.0, size=n), 1), "c": np.where(rng.random(n) < 0.4, 3.0, rng.random(n)),
        "d": rng.integers(0, 5, n).astype(float), "flat": np.full(n, 2.0), "none": np.full(n, np.nan), "far": np.where(rng.random(n) < 0.5, np.inf, 1.0),
    }
    rows = [tuple(float(data[c][i]) if (c != "a" or i % 7) else None for c in data) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(5)
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        tracker = spark.sparkContext.statusTracker()
        jobs = []
        for columns in (["a", "b"], list(data)):
            spark.sparkContext.setJobGroup(f"ks{len(columns)}", "")
            out = {r.feature: r for r in profile.ks_normality(df, columns).collect()}
            jobs.append(len(tracker.getJobIdsForGroup(f"ks{len(columns)}")))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    assert jobs[0] == jobs[1]
    assert set(out) == {"a", "b", "c", "d"}
    for c in out:
        values = df.select(c).dropna()
        m = values.agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd")).first()
        own = np.sort([r[0] for r in values.collect()])
        curve = np.array([0.5 * math.erfc(-(v - m.mean) / m.sd / math.sqrt(2)) for v in own])
        k = len(own)
        distance = max(np.max(np.arange(1, k + 1) / k - curve), np.max(curve - np.arange(k) / k))
        assert out[c].statistic == pytest.approx(distance, abs=1e-12)
        theirs = KolmogorovSmirnovTest.test(values, c, "norm", m.mean, m.sd).first()
        assert (out[c].statistic, out[c].p_value) == pytest.approx((theirs.statistic, theirs.pValue), abs=1e-9)
    assert profile.ks_normality(df.where("false"), ["a", "b"]).count() == 0


def test_select_by_position(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert missing.by_position(df, [1, 3]).columns == ["a", "c"]
    assert missing.by_position(df, [-2, -3]).columns == ["a", "d"]


def test_csv_null_marks(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("k,v,name\n1,NA,x\n2,,NA\nNA,3.5,\n")
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL("k int, v double, name string")
    both = delimited.read_csv_two_nulls(spark, str(path), schema)
    assert [tuple(r) for r in both.collect()] == [(1, None, "x"), (2, None, None), (None, 3.5, None)]
    semi = tmp_path / "semi.csv"
    semi.write_text("ctr;pdi;ivr\nALB;;15\nARG;49;62\n")
    scores = delimited.read_csv(spark, str(semi), "ctr string, pdi int, ivr int", ";", "")
    assert [tuple(r) for r in scores.dropna(subset=["pdi"]).collect()] == [("ARG", 49, 62)]


def test_records_first_present_name(spark):
    docs = [
        '{"imdb_id":"t1","adult":true,"genres":[{"id":1},{"id":2,"name":"War"}],"production_countries":[]}',
        '{"imdb_id":null,"genres":[{"id":1,"name":"Crime"}]}',
        "not a record",
    ]
    flat = records.flatten_film_records(spark.createDataFrame([(d,) for d in docs], "record string")).collect()
    assert [(r.imdb_id, r.adult, r.genres_name, r.production_countries_name) for r in flat] == [("t1", "TRUE", "War", None)]


def test_scratch_folder_follows_the_session(spark):
    from folkscope.session import scratch_path

    root = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_path(spark, "x")
    assert path.startswith(root) if root else "folkscope" in path
    assert path != scratch_path(spark, "x")


def test_population_year_is_picked_before_the_join(spark):
    countries = spark.createDataFrame([("X",), ("Y",)], "country string")
    population = spark.createDataFrame([("X", 2020, 1.0), ("X", 2021, 2.0)], "country string, year int, population double")
    out = culture.countries_with_population(countries, population, 2021).collect()
    assert {r.country: r.population for r in out} == {"X": 2.0, "Y": None} and len(out) == 2


def test_chart_countries(spark):
    rows = [("United States of America", "High income"), ("United States of America", "High income"), ("Narnia", "NA"), ("Oz", None)]
    df = spark.createDataFrame(rows, "production_countries_name string, income_level string")
    assert [tuple(r) for r in culture.chart_countries(df).collect()] == [("United States", "High income")]


def test_stored_split_reads_the_same_rows(spark):
    df = spark.range(90).select((F.col("id") % 3).cast("string").alias("level"), "id")
    for stored in (False, True):
        parts = missing.split_by_level(df, "level", ["0", "1"], stored=stored)
        assert {k: sorted(r.id for r in p.collect()) for k, p in parts.items()} == {
            "0": list(range(0, 90, 3)),
            "1": list(range(1, 90, 3)),
        }


def test_diverging_share_counts_all_other_answers_as_no(spark):
    df = spark.createDataFrame([("yes", 0.6), ("no", 0.3), ("refused", 0.1), (None, 0.2)], "a string, s double")
    out = survey.diverging_share(df, "a", "s", ["yes"]).collect()
    assert [(r.a, r.response) for r in out] == [("Yes", 0.6), ("No", -0.3), ("No", -0.1), (None, None)]
