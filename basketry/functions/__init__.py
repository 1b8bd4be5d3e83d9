"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(c: Column, places: int) -> Column:
    """Rounded half to even at `places` decimals, as a double."""
    return F.rint(c * 10.0**places) / 10.0**places + F.lit(0.0)


def strip(c: Column) -> Column:
    """Without white space (tabs and line ends too) at both ends; texts of ASCII alone are trimmed without a pattern."""
    return F.when(F.octet_length(c) == F.char_length(c), F.btrim(c, F.lit(" \t\n\x0b\f\r"))).otherwise(F.regexp_replace(c, r"^\s+|\s+$", ""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def canonical_code(c: Column) -> Column:
    """Upper-cased, trimmed code; null becomes the text NAN."""
    return F.upper(strip(F.coalesce(c.cast("string"), F.lit("nan"))))


def canonical_customer(c: Column) -> Column:
    """Customer id without one trailing .0; blanks, nan and none are null."""
    t = F.regexp_replace(strip(c.cast("string")), r"\.0$", "")
    return F.when(~F.lower(t).isin("", "nan", "none"), t)


def lenient(c: Column, kind: str) -> Column:
    """The value as `kind`; null where it doesn't parse or isn't finite."""
    v = c.try_cast(kind)
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v) if kind == "double" else v


def exact_sum(c: Column) -> Column:
    """Sum of doubles with four decimals, independent of order."""
    return F.sum(c.cast("decimal(28,4)")).cast("double")


def stamp(day: str) -> Column:
    return F.lit(day).cast("timestamp_ntz")


def days_before(cutoff: Column, days: int) -> Column:
    return cutoff - F.expr(f"INTERVAL {days} DAYS")


def formula_safe(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a leading apostrophe."""
    return F.when(F.substring(c, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), c)).otherwise(c)


def json_codes(c: Column) -> Column:
    """["a", "b"] with a space after each comma; [] when empty or null."""
    return F.when(F.size(c) > 0, F.concat(F.lit('["'), F.array_join(c, '", "'), F.lit('"]'))).otherwise(F.lit("[]"))


def score(value: Column, cuts: list[Column]) -> Column:
    """1 + how many cut points the value reaches; ties stay together."""
    return F.lit(1) + sum(((value >= c).cast("int") for c in cuts), F.lit(0))
