"""Facet filters: which are set, and the condition they make."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SC, HC = "sc", "hc"
SC_COURT = "Supreme Court"


@dataclass(frozen=True)
class Filters:
    """Facets of a search. A falsy value (none, empty, 0) isn't applied."""

    citation: str | None = None
    petitioner: str | None = None
    respondent: str | None = None
    category: str | None = None
    disposal: str | None = None
    court: str | None = None
    year_from: int | None = None
    year_to: int | None = None
    judge: str | None = None
    act: str | None = None
    keyword: str | None = None

    @classmethod
    def parse(cls, params: dict) -> Filters:
        """From the strings of a request: trimmed, years as whole numbers; what can't be read isn't set."""
        got = {}
        for f in fields(cls):
            value = params.get(f.name)
            if isinstance(value, str):
                value = value.strip()
            if f.name.startswith("year_"):
                value = int(value) if str(value or "").lstrip("-").isdigit() else None
            got[f.name] = value or None
        return cls(**got)

    def active(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name)}

    def merged(self, over: Filters) -> Filters:
        """These, with the facets that ``over`` sets in their place."""
        return replace(self, **over.active())


_EQUAL = ("citation", "petitioner", "respondent", "category", "disposal")
_HAS = {"judge": "judges", "act": "acts", "keyword": "keywords"}


def one_clause(name: str, value) -> Column:
    if name in _EQUAL:
        return F.col(name) == F.lit(value)
    if name in _HAS:
        return F.coalesce(F.array_contains(_HAS[name], value), F.lit(False))
    if name == "year_from":
        return F.col("year") >= value
    if name == "year_to":
        return F.col("year") <= value
    # a court chooses the register as well: pruned where source_table is a partition column
    return (F.col("source_table") == SC) if value == SC_COURT else (F.col("source_table") == HC) & (F.col("court") == F.lit(value))


def condition(filters: Filters) -> Column:
    return reduce(lambda a, b: a & b, (one_clause(k, v) for k, v in filters.active().items()), F.lit(True))


def apply(cases: DataFrame, filters: Filters) -> DataFrame:
    return cases.where(condition(filters))


def options_like(values: DataFrame, column: str, typed: str, limit: int = 200) -> DataFrame:
    """The first values that contain what was typed, whatever the case."""
    return values.where(F.contains(F.lower(column), F.lit(typed.lower()))).orderBy(column).limit(limit)
