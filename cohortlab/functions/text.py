"""Text columns: trimming, ids, split names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# White space of every kind, including the separators U+001C..U+001F.
_SPACES = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_NON_SPACE = r"(?U)[^\s\x1c-\x1f]"


def strip(col: Column) -> Column:
    """Remove white space of every kind at both ends."""
    return F.btrim(col, F.lit(_SPACES))


def non_blank(col: Column) -> Column:
    """Text with at least one visible character."""
    return col.rlike(_NON_SPACE)


def id_number(col: Column) -> Column:
    """First run of digits as a number; an id without digits is an error."""
    digits = F.regexp_extract(col, "([0-9]+)", 1)
    bad = F.raise_error(F.concat(F.lit("id without digits: "), F.coalesce(col, F.lit("<missing>"))))
    return F.when(digits != "", digits.cast("bigint")).otherwise(bad.cast("bigint"))


def split_kind(name: Column) -> Column:
    """Text before the first underscore: `train_sample_350_pos` -> `train`."""
    return F.substring_index(name, "_", 1)


def split_label(name: Column) -> Column:
    """Text after the last underscore: `train_sample_350_pos` -> `pos`."""
    return F.substring_index(name, "_", -1)


def split_stem(name: Column) -> Column:
    """Text before the last underscore: `train_sample_350_pos` -> `train_sample_350`."""
    return F.regexp_extract(name, "^(.*)_[^_]+$", 1)


def percent_bar(pct: Column) -> Column:
    """One block per two percent."""
    return F.repeat(F.lit("█"), F.floor(pct / 2).cast("int"))
