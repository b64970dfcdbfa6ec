"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folkscope.fixed_values import CULTURE_CODES, NAME_ALIASES, SCORE_BIN_EDGES
from folkscope.functions import dates, numbers, text
from folkscope.operators.aggregates import weighted_counts
from folkscope.operators.reshape import pivot_wide
from folkscope.operators.survey import collapse_levels, recode, recode_all_columns
from folkscope.plans.culture import harmonised
from folkscope.plans.films import model_table
from folkscope.queries.analogs import FILMS, PRIORITIES, SCORES, SURVEY, films, scores, survey
from folkscope.queries.registry import query
from folkscope.sources.tables import table

# A code table whose rules would chain (NATION_1 -> NATION_2 -> NATION_3) and
# whose keys are parts of other names (NATION_1 in NATION_10), for the single-pass lookup.
CODES = {"NATION_1": "NATION_2", "NATION_2": "NATION_3", "NATION_10": "TENTH", "NATION_20": "NATION_1"}
ALIASES = {"AUTOMOBILE": "Cars", "BUILDING": "Houses", "BUILD": "Wrong", "FURNITURE": "Chairs"}


def _case(column: str, mapping: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {column} END"


@query(
    "replace_first",
    "SELECT doc_id, regexp_replace(text, '[aeiou]+n', '<$>') AS text FROM documents",
)
def replace_first(spark, folder):
    documents = table(spark, folder, "documents")
    return documents.select("doc_id", text.replace_first("text", "[aeiou]+n", "<$>").alias("text"))


@query("replace_all", "SELECT doc_id, regexp_replace(text, '[aeiou]+n', '<$>', 'g') AS text FROM documents")
def replace_all(spark, folder):
    documents = table(spark, folder, "documents")
    return documents.select("doc_id", text.replace_every("text", "[aeiou]+n", "<$>").alias("text"))


@query(
    "map_all_columns",
    "SELECT " + ", ".join(f"regexp_replace(CAST({c} AS VARCHAR), '1', 'one', 'g') AS {c}"
                          for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")) + " FROM customer",
)
def map_all_columns(spark, folder):
    return recode_all_columns(table(spark, folder, "customer"), "1", "one")


@query(
    "code_mapping",
    f"""SELECT c_custkey, {_case('n_name', CODES)} AS code FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def code_mapping(spark, folder):
    nation = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("code"))
    customers = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return recode(customers.select("c_custkey", "code"), "code", CODES)


@query("name_harmonise", f"SELECT c_custkey, {_case('c_mktsegment', ALIASES)} AS c_mktsegment FROM customer")
def name_harmonise(spark, folder):
    return recode(table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ALIASES)


CULTURE_KEYS = [*CULTURE_CODES, "USA", "FRA"]  # the last two stand for themselves
ALIAS_KEYS = [*dict.fromkeys(k for names in NAME_ALIASES.values() for k in names), "France", "United States of America States"]


def _cycled(keys: list[str]) -> str:
    return "[" + ", ".join(f"'{k}'" for k in keys) + f"][c_custkey % {len(keys)} + 1]"


def _one_of(keys: list[str]):
    return F.element_at(F.lit(keys), (F.col("c_custkey") % len(keys) + 1).cast("int"))


@query(
    "code_mapping_culture",
    f"SELECT c_custkey, {_case('code', CULTURE_CODES)} AS code FROM (SELECT c_custkey, {_cycled(CULTURE_KEYS)} AS code FROM customer)",
)
def code_mapping_culture(spark, folder):
    """The whole code table of the culture scores, with codes it does not list."""
    customers = table(spark, folder, "customer").select("c_custkey", _one_of(CULTURE_KEYS).alias("code"))
    return recode(customers, "code", CULTURE_CODES)


@query(
    "name_harmonise_sources",
    "SELECT c_custkey, "
    + ", ".join(f"{_case('country', names)} AS {source}" for source, names in NAME_ALIASES.items())
    + f" FROM (SELECT c_custkey, {_cycled(ALIAS_KEYS)} AS country FROM customer)",
)
def name_harmonise_sources(spark, folder):
    """The names of every source as the names used everywhere."""
    customers = table(spark, folder, "customer").select("c_custkey", _one_of(ALIAS_KEYS).alias("country"))
    for source in NAME_ALIASES:
        customers = harmonised(customers.withColumn(source, F.col("country")), source, source)
    return customers.drop("country")


@query(
    "concat_text",
    """SELECT doc_id, 'doc ' || doc_id || '-' || coalesce(CAST(quality AS VARCHAR), 'NA') || ' range.csv' AS name
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def concat_text(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id")
    rated = documents.join(table(spark, folder, "labels"), "doc_id", "left")
    name = text.join_text(F.lit("doc "), "doc_id", F.lit("-"), "quality", F.lit(" range.csv"))
    return rated.select("doc_id", name.alias("name"))


@query(
    "format_labels",
    """SELECT o_orderkey, CASE WHEN v < 0 THEN '-' ELSE '' END || '$'
        || format('{:,}', CAST(round_even(abs(v) * 1e-6, 0) AS BIGINT)) || 'M' AS money,
        format('{:,}', CAST(round_even(p * 100, 0) AS BIGINT)) || '%' AS percent
    FROM (SELECT o_orderkey, (o_totalprice - 250000) * 100000 AS v, o_totalprice / 500000 AS p FROM orders)""",
)
def format_labels(spark, folder):
    total = F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        text.money_millions((total - 250000) * 100000).alias("money"),
        text.percent_label(total / 500000).alias("percent"),
    )


@query(
    "parse_dmy",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS release_date
    FROM orders""",
)
def parse_dmy(spark, folder):
    """Dates written in two ways, and text that is no date at all."""
    day = F.col("o_orderdate")
    written = (
        F.when(F.col("o_orderpriority") == "5-LOW", F.when(F.col("o_orderstatus") == "P", "").otherwise("31/31/1999"))
        .when(F.col("o_orderstatus") == "O", F.date_format(day, "d-M-yyyy"))
        .otherwise(F.date_format(day, "dd/MM/yyyy"))
    )
    orders = table(spark, folder, "orders").select("o_orderkey", written.alias("release_date"))
    return orders.select("o_orderkey", dates.parse_dmy("release_date").alias("release_date"))


@query("year_of", f"WITH {FILMS} SELECT CAST(year AS INTEGER) AS year, count(*) AS n FROM films GROUP BY 1")
def year_of(spark, folder):
    rows = films(spark, folder, country=False, genre=False)
    return rows.groupBy(F.year(dates.parse_dmy("release_date")).alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "round_even",
    "SELECT l_orderkey, l_partkey, round_even(l_quantity / 8, 2) AS eighths, round_even(l_quantity / 2, 0) AS halves FROM lineitem",
)
def round_even(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        numbers.round_even(F.col("l_quantity") / 8, 2).alias("eighths"),
        numbers.round_even(F.col("l_quantity") / 2, 0).alias("halves"),
    )


@query(
    "log_exp_logit",
    """SELECT o_orderkey, round(ln(o_totalprice), 8) AS log_price, round(exp(o_totalprice / 500000), 8) AS exp_share,
       round(ln((o_totalprice / 1e6) / (1 - o_totalprice / 1e6)), 8) AS logit FROM orders""",
)
def log_exp_logit(spark, folder):
    total = F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.round(F.ln(total), 8).alias("log_price"),
        F.round(F.exp(total / 500000), 8).alias("exp_share"),
        F.round(numbers.log_odds(total / 1e6), 8).alias("logit"),
    )


@query(
    "extrapolate_population",
    f"""WITH {SURVEY}, {SCORES}, wide AS (SELECT country,
        sum(CASE WHEN answer IN ('1-URGENT', '2-HIGH') THEN weight END) AS y,
        sum(CASE WHEN answer IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN weight END) AS n,
        sum(CASE WHEN answer = '5-LOW' AND country <> 'NATION_3' THEN weight END) AS neut FROM survey GROUP BY 1)
    SELECT country, round(ln(y * (idv * 1000000 / (y + n + coalesce(neut, 0)))), 8) AS "extrapolated_genderY"
    FROM wide JOIN scores USING (country)""",
)
def extrapolate_population(spark, folder):
    names = dict(zip(PRIORITIES, ["a", "b", "c", "d", "gender_Neut"]))
    counts = weighted_counts(survey(spark, folder), ["country", "answer"])
    wide = pivot_wide(counts, ["country"], "answer", "weighted_n", names)
    merged = collapse_levels(wide, {"gender_Y": ("a", "b"), "gender_N": ("c", "d")})
    unknown = merged.withColumn("gender_Neut", F.when(F.col("country") != "NATION_3", F.col("gender_Neut")))
    people = scores(spark, folder).select("country", (F.col("idv") * 1_000_000).alias("population"))
    scaled = model_table(unknown.join(people, "country"))
    return scaled.select("country", F.round("extrapolated_genderY", 8).alias("extrapolated_genderY"))


@query("scale_thousands", "SELECT o_orderkey, round_even(o_totalprice / 1000, 2) AS budget FROM orders")
def scale_thousands(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", numbers.thousands("o_totalprice").alias("budget"))


@query(
    "bin_fixed",
    """SELECT c_custkey, CASE WHEN v < 0 THEN NULL WHEN v < 20 THEN '[0,20)' WHEN v < 40 THEN '[20,40)'
       WHEN v < 60 THEN '[40,60)' WHEN v < 80 THEN '[60,80)' WHEN v < 100 THEN '[80,100)' ELSE '[100,Inf)' END AS bin
    FROM (SELECT c_custkey, c_acctbal / 80 AS v FROM customer)""",
)
def bin_fixed(spark, folder):
    customers = table(spark, folder, "customer")
    return customers.select("c_custkey", numbers.fixed_bin(F.col("c_acctbal") / 80, SCORE_BIN_EDGES).alias("bin"))


@query(
    "scale_min_max",
    """SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 10) AS shade FROM customer,
    (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)""",
)
def scale_min_max(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    scaled = numbers.min_max_scale(customers, "c_acctbal", "shade")
    return scaled.select("c_custkey", F.round("shade", 10).alias("shade"))


@query(
    "row_caption",
    """SELECT p_partkey, 'Part: ' || p_name || '<br/>Size: ' || p_size || '<br/>Type: '
        || coalesce(nullif(p_type, 'LARGE'), 'NA') AS caption FROM part""",
)
def row_caption(spark, folder):
    part = table(spark, folder, "part").withColumn("p_type", F.nullif("p_type", F.lit("LARGE")))
    shown = text.caption({"Part": "p_name", "Size": "p_size", "Type": "p_type"})
    return part.select("p_partkey", shown.alias("caption"))


@query(
    "number_sequence",
    """SELECT CAST(round(-1 + i * 0.2, 6) AS DOUBLE) AS tick, (SELECT count(*) FROM customer
        WHERE c_acctbal / 10000 >= -1 + i * 0.2 - 1e-9) AS n_above
    FROM range(0, 11) t(i)""",
)
def number_sequence(spark, folder):
    """Axis ticks from -1 to 1 with the number of customers at or above each."""
    ticks = numbers.number_sequence(spark, -1.0, 1.0, 0.2).select(F.round("value", 6).alias("tick"))
    # Customers are counted by the highest tick they reach, so the ticks join a few counts.
    reached = F.floor((F.col("c_acctbal") / 10000 + 1 + 1e-9) / 0.2)
    customers = table(spark, folder, "customer").groupBy(F.least(reached, F.lit(10)).alias("reached"))
    counts = customers.agg(F.count(F.lit(1)).alias("n"))
    joined = ticks.join(counts, F.round((F.col("tick") + 1) / 0.2).cast("long") <= F.col("reached"), "left")
    return joined.groupBy("tick").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_above"))
