"""Numbers: NaN never gets into a frame, missing is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(c: Column) -> Column:
    """Text as a double; suffixes that Spark takes and plain numbers do not have are refused."""
    text = F.trim(c.cast("string"))
    value = F.when(text.rlike(r"^[+-]?(\d+(_\d+)*(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    return value


def to_float(c: Column) -> Column:
    """Null for blanks and what is no number; n/d as a ratio, null over zero."""
    text = F.trim(c.cast("string"))
    ratio = F.try_divide(F.regexp_extract(text, r"^(\d+)/(\d+)$", 1).try_cast("double"), F.regexp_extract(text, r"^(\d+)/(\d+)$", 2).try_cast("double"))
    return F.when(text.rlike(r"^\d+/\d+$"), ratio).otherwise(_number(c))


def to_num(c: Column) -> Column:
    return _number(c)


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def lookup(key: Column, table: dict[str, float]) -> Column:
    """table[key], null where the key is unknown."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), key)


def prox(distance: Column, scale: float) -> Column:
    """exp(-distance / scale); 0 where there is no distance."""
    return F.when(distance.isNull(), F.lit(0.0)).otherwise(F.exp(-distance / F.lit(scale)))


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def confidence(d_gp: Column, d_gq: Column, d_pw: Column, span: Column, k_price: Column, k_qty: Column, unit_strength: Column, lines: Column) -> Column:
    """0 to 100: nearness of grain, quantity and price words, less for rivals in the window."""
    near = 10 + 40 * prox(d_gp, 12.0) + 15 * prox(d_gq, 20.0) + 10 * prox(d_pw, 8.0) + 15 * prox(span, 25.0)
    bonus = F.when(unit_strength == 2, 8.0).when(unit_strength == 1, 3.0).otherwise(0.0)
    rivals = F.least(F.lit(15.0), 5.0 * F.greatest(F.lit(0), k_price - 1)) + F.least(F.lit(8.0), 2.0 * F.greatest(F.lit(0), k_qty - 1))
    return clamp(near + bonus - rivals - 2.0 * F.least(lines, F.lit(5)))


def score_bin(score: Column, top: int = 80) -> Column:
    """Label of the bin; null outside 0 to top. Scores between 10 and 11 get one that no declared bin has."""
    low = F.floor((score - 1) / 10) * 10 + 1
    high = F.least(low + 9, F.lit(top))
    label = F.when(score <= 10, F.lit("00-10")).otherwise(F.format_string("%02d-%02d", low.cast("int"), high.cast("int")))
    return F.when((finite(score) >= 0) & (score <= top), label)


def bins(top: int = 80) -> list[str]:
    """The declared bins up to top."""
    return ["00-10", *(f"{low:02d}-{min(low + 9, top):02d}" for low in range(11, top + 1, 10))]


def quality_tier(score: Column, ambiguous: Column) -> Column:
    return F.when((score >= 65) & ~ambiguous, "A").when(score >= 60, "B").otherwise("C")


def year_from_iso(c: Column) -> Column:
    """The signed year that text begins with."""
    sign, digits = F.regexp_extract(F.trim(c), r"^([+-]?)\s*(\d{1,4})", 1), F.regexp_extract(F.trim(c), r"^([+-]?)\s*(\d{1,4})", 2)
    return F.when(digits != "", digits.try_cast("double") * F.when(sign == "-", -1.0).otherwise(1.0))


def infer_year(when: Column, not_before: Column, not_after: Column) -> Column:
    w, b, a = year_from_iso(when), year_from_iso(not_before), year_from_iso(not_after)
    return F.coalesce(w, (b + a) / 2, b, a)


def year_bin(year: Column, width: int = 25) -> Column:
    return (F.floor(year / width) * width).cast("int")
