"""Canonical names of grains, units, coins and places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import GRAIN_NAMES, MONEY_NAMES, PLACES, UNIT_NAMES


def by_prefix(form: Column, names: tuple[tuple[str, str], ...]) -> Column:
    """The name of the first prefix that the normalized form has; else the form itself."""
    out = F.when(form == "", form)
    for prefix, name in names:
        out = out.when(form.startswith(prefix), name)
    return out.otherwise(form)


def by_pattern(text: Column, names: tuple[tuple[str, str], ...], blank: str = "Unknown") -> Column:
    """The name of the first pattern that is found in the normalized text; else blank."""
    out = F.when(F.coalesce(text, F.lit("")) == "", blank)
    for pattern, name in names:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(blank)


def grain(norm: Column) -> Column:
    return by_prefix(norm, GRAIN_NAMES)


def unit(norm: Column) -> Column:
    return by_prefix(norm, UNIT_NAMES)


def currency(norm: Column) -> Column:
    return by_prefix(norm, MONEY_NAMES)


def place(norm: Column) -> Column:
    return by_pattern(norm, PLACES)
