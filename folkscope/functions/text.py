"""Text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _literal_replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def replace_first(col: Column | str, pattern: str, replacement: str) -> Column:
    """Replace the first match of a regular expression only.

    Spark's ``regexp_replace`` replaces every match, so the text before the first
    match is captured lazily and put back; the rest is left untouched.
    """
    return F.regexp_replace(
        col, f"(?s)^(?<head>.*?)(?:{pattern})", "${head}" + _literal_replacement(replacement)
    )


def replace_every(col: Column | str, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(col, pattern, _literal_replacement(replacement))


def join_text(*cols: Column | str, sep: str = "") -> Column:
    """Concatenate; a missing part reads ``NA`` instead of voiding the whole text."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("NA")) for c in cols]
    return F.concat_ws(sep, *parts)


def money_millions(col: Column | str) -> Column:
    """``13250000`` as ``$13M``; the sign stands before the currency mark."""
    col = F.col(col) if isinstance(col, str) else col
    sign = F.when(col < 0, F.lit("-")).when(col.isNotNull(), F.lit(""))
    return F.concat(sign, F.lit("$"), F.format_number(F.abs(col) * 1e-6, 0), F.lit("M"))


def percent_label(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.concat(F.format_number(col * 100, 0), F.lit("%"))


def caption(fields: dict[str, Column | str], line_break: str = "<br/>") -> Column:
    """One ``label: value`` line per field."""
    lines = [join_text(F.lit(f"{label}: "), col) for label, col in fields.items()]
    return F.concat_ws(line_break, *lines)
