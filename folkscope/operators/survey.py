"""Survey answers: merging levels, diverging shares, name and code tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folkscope.fixed_values import ACCEPTANCE_YES, IMPORTANCE_YES

from folkscope.functions.conditions import ladder
from folkscope.operators.joins import left_join_sql


def collapse_levels(df: DataFrame, merges: dict[str, tuple[str, str]]) -> DataFrame:
    """Add each pair of level columns into one and drop the pair.

    A missing operand gives a missing sum: "nobody refused" and "not asked" are
    not told apart by the source data.
    """
    merged = df.withColumns({name: F.col(a) + F.col(b) for name, (a, b) in merges.items()})
    return merged.drop(*{part for pair in merges.values() for part in pair})


def importance_merges(prefix: str) -> dict[str, tuple[str, str]]:
    """Neutral, yes and no columns of a four-step importance question."""
    return {
        f"{prefix}_Neut": (f"{prefix}_DK", f"{prefix}_R"),
        f"{prefix}_Y": (f"{prefix}_VI", f"{prefix}_SI"),
        f"{prefix}_N": (f"{prefix}_NTI", f"{prefix}_NIAA"),
    }


def diverging_share(df: DataFrame, answer: str, share: str, yes: list[str] = IMPORTANCE_YES + ACCEPTANCE_YES) -> DataFrame:
    """Answers as Yes/No and the share signed so that both sides leave zero.

    Every answer outside ``yes``, undecided and refused ones too, counts as No.
    """
    side = F.when(F.col(answer).isin(yes), "Yes").when(F.col(answer).isNotNull(), "No")
    sided = df.withColumn(answer, side)
    signed = ladder((F.col(answer) == "No", -1 * F.col(share)), (F.col(answer) == "Yes", F.col(share)))
    return sided.withColumn("response", signed)


def answer_chart(shares: DataFrame, countries: DataFrame, question: str, yes: list[str] = IMPORTANCE_YES + ACCEPTANCE_YES) -> DataFrame:
    """Chart rows of one question: signed shares with the income level of the country."""
    sided = diverging_share(shares, question, "weighted_estimate", yes)
    return left_join_sql(sided, countries, question)


def recode(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Replace whole values by a lookup table in one pass; others stay.

    A single exact lookup has no order hazards (``A->B`` beside ``B->C``) and no
    partial matches (``X_1`` inside ``X_10``). The table is a literal of the
    program; the planner sees its size and broadcasts it.
    """
    table = df.sparkSession.createDataFrame(list(mapping.items()), "_old string, _new string")
    joined = df.join(table, F.col(column) == F.col("_old"), "left")
    return joined.withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def recode_all_columns(df: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """Apply one text replacement to every column; all become text."""
    cells = [F.regexp_replace(F.col(c).cast("string"), pattern, replacement).alias(c) for c in df.columns]
    return df.select(*cells)
