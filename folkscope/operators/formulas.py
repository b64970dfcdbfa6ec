"""Model formulas as text: ``y ~ a + b:c + d*e - f - 1``.

A formula names the response, or ``cbind(successes, failures)``, and terms: variables,
interactions ``a:b``, ``a*b`` for both and their interaction, ``a/b`` for a and its interaction
with b, ``.`` for all other columns, ``- term`` to take one out, ``- 1`` or ``+ 0`` for no
intercept, and ``offset(x)``. Main effects come first, then interactions by order. A text
variable is coded against its first level where the rest of its term is in the model, and by
a column per level where it is not.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product
from operator import and_, mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folkscope.operators.models import INTERCEPT, TERMS, BinomialFit, Design, design, fit_binomial

TOKEN = re.compile(r"\s*(?:(`[^`]+`|[A-Za-z_.][A-Za-z0-9_.]*)|(\d+)|(.))")


@dataclass(frozen=True)
class Formula:
    """``response``: one name, or successes and failures; ``terms``: variables of each term, in order."""

    response: tuple[str, ...]
    terms: tuple[tuple[str, ...], ...]
    intercept: bool = True
    offset: str | None = None

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(v for term in self.terms for v in term))


class _Parser:
    """Sums of products of names. A term is a tuple of names; the empty one is the intercept."""

    def __init__(self, text: str, others: list[str]):
        self.text, self.others, self.offset, self.kept = text, others, None, True  # kept: the intercept
        self.tokens = [m.group(1) or m.group(2) or m.group(3) for m in TOKEN.finditer(text) if m.group().strip()]
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, wanted: str | None = None) -> str:
        found = self.peek()
        if found is None or (wanted is not None and found != wanted):
            raise ValueError(f"{wanted or 'a term'} expected instead of {found or 'the end'} in {self.text!r}")
        self.at += 1
        return found

    def sum(self) -> list[tuple[str, ...]]:
        """Terms in order of appearance, later ``-`` taking out earlier ones."""
        sign = self.take() if self.peek() in ("+", "-") else "+"
        found: list[tuple[str, ...]] = []
        while True:
            terms = self.crossed()
            if sign == "+":
                found += [t for t in terms if t not in found]
            else:
                found = [t for t in found if t not in terms]
            if terms == [()] or terms == [("0",)]:
                self.kept = (terms == [()]) == (sign == "+")
                found = [t for t in found if t not in ((), ("0",))]
            if self.peek() not in ("+", "-"):
                return found
            sign = self.take()

    def crossed(self) -> list[tuple[str, ...]]:
        left = self.joined()
        while self.peek() in ("*", "/"):
            sign, right = self.take(), self.joined()
            if sign == "*":
                left = left + right + [merge(a, b) for a in left for b in right]
            else:
                whole = reduce(merge, left)
                left = left + [merge(whole, b) for b in right]
        return list(dict.fromkeys(left))

    def joined(self) -> list[tuple[str, ...]]:
        left = self.single()
        while self.peek() == ":":
            self.take()
            left = [merge(a, b) for a, b in product(left, self.single())]
        return left

    def single(self) -> list[tuple[str, ...]]:
        token = self.take()
        if token == "(":
            inner = self.sum()
            self.take(")")
            return inner
        if token == "offset" and self.peek() == "(":
            self.take()
            self.offset = name_of(self.take())
            self.take(")")
            return []
        if token == ".":
            return [(c,) for c in self.others]
        if token in ("0", "1"):
            return [()] if token == "1" else [("0",)]
        if not re.match(r"[`A-Za-z_.]", token):
            raise ValueError(f"{token} is no term in {self.text!r}")
        return [(name_of(token),)]


def name_of(token: str) -> str:
    return token.strip("`")


def merge(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys((*a, *b)))


def parse(text: str, columns: list[str]) -> Formula:
    """Read a formula; names must be among the columns, ``.`` stands for those that the left side and offset leave."""
    if text.count("~") != 1:
        raise ValueError(f"one ~ between response and terms is wanted in {text!r}")
    left, right = text.split("~")
    pair = re.fullmatch(r"\s*cbind\(\s*(`[^`]+`|[\w.]+)\s*,\s*(`[^`]+`|[\w.]+)\s*\)\s*", left)
    response = tuple(map(name_of, pair.groups())) if pair else (name_of(left.strip()),)
    offset = re.search(r"offset\(\s*(`[^`]+`|[\w.]+)\s*\)", right)
    taken = {*response, *([name_of(offset.group(1))] if offset else [])}
    parser = _Parser(right, [c for c in columns if c not in taken])
    found = parser.sum()
    if parser.peek() is not None:
        raise ValueError(f"{parser.peek()} is not understood in {text!r}")
    terms = tuple(dict.fromkeys(sorted((t for t in found if t), key=len)))
    # a:b and b:a are one term.
    distinct = {frozenset(t): t for t in reversed(terms)}
    terms = tuple(t for t in terms if distinct[frozenset(t)] == t)
    formula = Formula(response, terms, parser.kept, parser.offset)
    unknown = [v for v in (*response, *formula.variables, *([parser.offset] if parser.offset else [])) if v not in columns]
    if unknown:
        raise ValueError(f"no column {', '.join(unknown)} for {text!r}")
    return formula


@dataclass(frozen=True)
class FormulaDesign(Design):
    """Terms of a formula as columns; a factor varies faster than those after it in the same term."""

    formula: Formula | None = None

    def coded(self) -> list[list[tuple[str, list[str] | None]]]:
        """Per term its variables, each with the levels that get a column (None for a number)."""
        present = {frozenset(t) for t in self.formula.terms} | ({frozenset()} if self.intercept else set())
        out = []
        for term in self.formula.terms:
            parts: list[tuple[str, list[str] | None]] = []
            for v in term:
                if v not in self.levels:
                    parts.append((v, None))
                    continue
                rest = frozenset(term) - {v}
                whole = rest not in present
                parts.append((v, self.levels[v] if whole else self.levels[v][1:]))
                if whole:
                    present.add(rest)  # its columns add up to what the rest would give
            out.append(parts)
        return out

    def columns(self) -> list[list[tuple[str, str | None]]]:
        """Per column of the design its (variable, level) pairs."""
        found = []
        for parts in self.coded():
            choices = [[(v, None)] if levels is None else [(v, level) for level in levels] for v, levels in parts]
            # The last varies slowest.
            found += [list(reversed(c)) for c in product(*reversed(choices))]
        return found

    @property
    def names(self) -> list[str]:
        named = [":".join(v if level is None else f"{v}_{level}" for v, level in c) for c in self.columns()]
        return [INTERCEPT, *named] if self.intercept else named

    def terms(self) -> list[tuple[str, Column]]:
        found = [F.lit(1.0)] if self.intercept else []
        for column in self.columns():
            found.append(reduce(mul, [self.number(v) if level is None else self.dummy(v, level) for v, level in column]))
        return list(zip(self.names, found, strict=True))

    def number(self, v: str) -> Column:
        return F.col(v).cast("double")

    def dummy(self, v: str, level: str) -> Column:
        return F.when(F.col(v).isin(self.levels[v]), (F.col(v) == level).cast("double"))

    def row_terms(self) -> Column:
        """A row has at most one non-zero column per term, whatever the levels: its place is worked out from the row's levels."""
        parts, at, complete = [], 0, F.lit(True)
        if self.intercept:
            parts.append(F.struct(F.lit(0).alias("i"), F.lit(1.0).alias("x")))
            at = 1
        for v in self.formula.variables:
            if v in self.levels:
                complete = complete & F.coalesce(F.col(v).isin(self.levels[v]), F.lit(False))
            else:
                complete = complete & F.col(v).isNotNull() & ~F.isnan(self.number(v))
        for coded in self.coded():
            value, place, width, shown = F.lit(1.0), F.lit(0), 1, F.lit(True)
            for v, levels in coded:
                if levels is None:
                    value = value * self.number(v)
                    continue
                places = {level: levels.index(level) if level in levels else -1 for level in self.levels[v]}
                found = F.element_at(F.from_json(F.lit(json.dumps(places)), "map<string,int>"), F.col(v))
                place, shown = place + found * width, shown & (found >= 0)
                width *= len(levels)
            parts.append(F.struct(F.when(shown, place + at).otherwise(-1).alias("i"), value.alias("x")))
            at += width
        whole = F.array(*parts) if parts else F.from_json(F.lit("[]"), TERMS)
        return F.when(complete, F.filter(whole, lambda t: (t["i"] >= 0) & (t["x"] != 0)))


def formula_design(df: DataFrame, formula: Formula) -> FormulaDesign:
    """Levels read off the rows that have all variables."""
    plain = design(df, formula.variables)
    return FormulaDesign(plain.predictors, plain.levels, plain.numeric, formula.intercept, formula)


def fit_formula(df: DataFrame, text: str, response_level: str | None = None) -> BinomialFit:
    """Binomial regression of a formula: 0/1 response, or ``cbind(successes, failures)``.

    ``response_level``: for a text response, the level that counts as success.
    """
    formula = parse(text, df.columns)
    if len(formula.response) == 2:
        m, o = map(F.col, formula.response)
    elif response_level is not None:
        m = (F.col(formula.response[0]) == response_level).cast("int")
        o = 1 - m
    else:
        m, o = F.col(formula.response[0]), 1 - F.col(formula.response[0])
    used = [m.isNotNull(), o.isNotNull(), m + o > 0] + ([F.col(formula.offset).isNotNull()] if formula.offset else [])
    plan = formula_design(df.where(reduce(and_, used)), formula)
    return fit_binomial(df, m, o, formula.variables, formula.offset, plan)


def without(formula: Formula, *names: str) -> Formula:
    """The formula without every term that a variable takes part in."""
    return replace(formula, terms=tuple(t for t in formula.terms if not set(t) & set(names)))
