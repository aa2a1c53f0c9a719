"""Numeric columns: coercion, rounding, percentages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_NUMBER = (
    r"(?Ui)^[\s\x1c-\x1f]*([+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf(?:inity)?))[\s\x1c-\x1f]*\z"
)


def to_number(col: Column) -> Column:
    """Text to double; anything that is not a plain number becomes missing.

    The pattern is needed next to the cast, which would read `12d` as 12. The
    column is used once, so a costly one is not computed again.
    """
    return F.regexp_extract(col, _NUMBER, 1).try_cast("double")


def nan_to_null(col: Column) -> Column:
    """NaN counts as missing, so it must be NULL before any filter or count."""
    return F.nullif(col.cast("double"), F.lit(float("nan")))


def half_even(col: Column, digits: int = 0) -> Column:
    """Round in binary floating point, halves to the even neighbour."""
    if digits == 0:
        return F.rint(col)
    scale = float(10**digits)
    return F.rint(col * scale) / scale


def percentage(part: Column, total: Column) -> Column:
    """part / total * 100, and 0 where the total is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), total.cast("double")) * 100, F.lit(0.0))


def ratio_or_zero(part: Column, total: Column) -> Column:
    """part / total, and 0 where the total is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), total.cast("double")), F.lit(0.0))


def at_least(score: Column, threshold: float = 0.5) -> Column:
    """1 where score >= threshold, else 0."""
    return (score >= threshold).cast("int")
