"""Release dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators between day, month and year; the spellings of a year with the
# digits to put before it; spellings with a month name.
SEPARATOR = r"[/.\- ]"
YEARS = {r"\d{4}": "", r"[0-6]\d": "20", r"[7-9]\d|69": "19"}
NAMED_MONTH_FORMATS = ["d MMM yyyy", "d MMMM yyyy"]


def _rearranged(text: Column | str, year: str, century: str) -> Column:
    """One regular expression turns the three numbers round; anything else becomes a text that is no date."""
    pattern = rf"(?s)^(?:\s*(\d{{1,2}}){SEPARATOR}(\d{{1,2}}){SEPARATOR}({year})\s*|.*)$"
    return F.regexp_replace(text, pattern, f"{century}$3-$2-$1").try_cast("date")


def parse_dmy(col: Column | str) -> Column:
    """Day-month-year text to a date, null where the text is no date.

    The column is read once for the usual four-digit year, also inside a filter, where
    Spark does not share common parts of an expression; the other spellings are tried
    only on what is left. The cast takes one fixed form without a pattern formatter.
    """
    numeric = [_rearranged(col, year, century) for year, century in YEARS.items()]
    named = [F.try_to_date(F.trim(col), fmt) for fmt in NAMED_MONTH_FORMATS]
    letters = (F.col(col) if isinstance(col, str) else col).rlike("[A-Za-z]")
    return F.coalesce(*numeric, F.when(letters, F.coalesce(*named)))


def released_after(date: Column | str, year: int) -> Column:
    """``year(date) > year`` written as a bound on the date itself.

    A comparison of the bare column reaches the parquet reader as a pushed filter
    and prunes row groups; a comparison of ``year(date)`` does not.
    """
    date = F.col(date) if isinstance(date, str) else date
    return date >= F.lit(f"{year + 1}-01-01").cast("date")
