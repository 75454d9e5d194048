"""Strings. Columns throughout; Unicode normal forms and case folding are those of the ICU library that Spark comes with."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.split() takes for white space, where it is not one blank already.
_SPACE = r"(?U)(?: [\s\x1c-\x1f]+|[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*)"


def _combining() -> str:
    """Pattern of characters with a combining class. Most are in the block of diacritics; wide gaps between the others are tested before them.

    It names them one by one: Java's own categories are of an older Unicode.
    """
    ranges: list[list[int]] = []
    # Beyond these there are none.
    for c in range(0x300, 0x1F000):
        if unicodedata.combining(chr(c)):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    spans = lambda of: "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in of)
    inside = [c for c in ranges if c[1] < 0x370]
    gaps = [(0, 0x2FF), *((a + 1, b - 1) for (_, a), (b, _) in zip(ranges, ranges[1:], strict=False) if b - a > 0x100)]
    return f"[{spans(inside)}[[^{spans(gaps)}]&&[{spans(ranges[len(inside):])}]]]+"


_COMBINING = _combining()


def _of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _icu(name: str, c: Column) -> Column:
    return F.reflect(F.lit(f"com.ibm.icu.{name.rpartition('.')[0]}"), F.lit(name.rpartition(".")[2]), c, F.lit(True))


def _composed(c: Column) -> Column:
    return _icu("text.Normalizer.compose", c)


def _bare(c: Column) -> Column:
    return F.regexp_replace(_icu("text.Normalizer.decompose", c), _COMBINING, "")


def _folded(c: Column) -> Column:
    return _icu("lang.UCharacter.foldCase", c)


def _split(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def strip_accents(c: Column | str) -> Column:
    """Decomposed, without combining characters; null as empty."""
    return _bare(_of(c))


def normalize_for_search(c: Column | str) -> Column:
    """Compatibility form, white space collapsed, accents dropped, case folded, in that order; null as empty."""
    return _folded(_bare(_split(_composed(_of(c)))))


def norm_greek(c: Column | str) -> Column:
    """As normalize_for_search, but white space last, which matters where dropping accents leaves blanks."""
    return _split(_folded(_bare(_composed(_of(c)))))


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def sorted_join(words: Column) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(words)), ";")


def ordered_join(words: Column) -> Column:
    """Distinct, in the order of their first appearance."""
    return F.array_join(F.array_distinct(words), ";")


def clean_context(c: Column, longest: int = 500) -> Column:
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r" *\n *", "\n")
    return F.substring(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), 1, longest)


def one_line(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit(" "))


def format_fraction(x: Column) -> Column:
    """Whole numbers without a point, others with at most six digits after it."""
    six = F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(six)


def parse_number(whole: Column, fractions: Column) -> Column:
    """A whole number, if any, plus every n/d of fractions; those over zero do not count."""
    pattern = F.lit(r"(\d+)\s*/\s*(\d+)")
    pairs = F.arrays_zip(F.regexp_extract_all(fractions, pattern, F.lit(1)).alias("n"), F.regexp_extract_all(fractions, pattern, F.lit(2)).alias("d"))
    start = F.coalesce(F.expr("cast(null as double)") if whole is None else whole.try_cast("double"), F.lit(0.0))
    return F.aggregate(F.coalesce(pairs, F.array().cast("array<struct<n:string,d:string>>")), start, lambda s, p: s + F.coalesce(F.try_divide(p["n"].cast("double"), p["d"].cast("double")), F.lit(0.0)))


def is_yes(c: Column, strip: bool = False) -> Column:
    return F.coalesce(F.lower(F.trim(c) if strip else c) == "yes", F.lit(False))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def token_at(text: Column, pos: Column) -> Column:
    """The same for one place, without an array: counted in the text up to it."""
    return F.greatest(F.lit(0), F.regexp_count(F.substr(text, F.lit(1), pos + 1), F.lit(r"(?U)\S+")) - 1)


def context_window(words: Column, low: Column, high: Column) -> Column:
    """Tokens low to high (from 0, inclusive) joined; line, column and page marks become line ends."""
    part = F.slice(words, F.greatest(low, F.lit(0)) + 1, F.greatest(F.lit(0), F.least(high, F.size(words) - 1) - F.greatest(low, F.lit(0)) + 1))
    joined = F.array_join(F.transform(part, lambda w: F.when(w.isin("__LB__", "__CB__", "__PB__"), F.lit("\n")).otherwise(w)), " ")
    return F.trim(F.regexp_replace(F.regexp_replace(joined, r" *\n *", "\n"), r" +", " "))
