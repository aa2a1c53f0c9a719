"""Filter conditions.

They are plain comparisons, so a filter drops rows with a missing operand and
the comparison still reaches the Parquet scan. Used as a flag column or under
a negation, wrap them in `definite`, which turns unknown into False.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

from cohortlab.constants import UNCERTAIN


def col(name: str) -> Column:
    """Column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def definite(cond: Column) -> Column:
    """`cond` with unknown taken as False."""
    return F.coalesce(cond, F.lit(False))


def positive_count(name: str) -> Column:
    """At least one."""
    return col(name) >= 1


def nonzero(name: str) -> Column:
    """Present and not zero: wider than `positive_count` (negatives, fractions)."""
    return col(name).isNotNull() & (col(name) != 0)


def all_above_zero(names: list[str]) -> Column:
    """Every column is > 0."""
    return reduce(and_, [col(n) > 0 for n in names])


def any_at_least_one(names: list[str]) -> Column:
    """Some column is >= 1."""
    return reduce(or_, [positive_count(n) for n in names])


def with_any_other(main: str, others: list[str]) -> Column:
    """`main` is >= 1 and so is at least one of `others`."""
    return positive_count(main) & any_at_least_one(others)


def flag_value(name: str, strict: bool = False) -> Column:
    """The flag as an integer; with `strict` a missing flag raises."""
    value = col(name).cast("int")
    if not strict:
        return value
    return F.coalesce(value, F.raise_error(F.lit(f"missing value in {name}")).cast("int"))


def certain(name: str, uncertain: int = UNCERTAIN) -> Column:
    """Label is present and not the sentinel for "uncertain"."""
    return col(name) != uncertain


def range_name(number: Column, ranges: dict[str, tuple[int, int]]) -> Column:
    """Name of the inclusive range that holds `number`, NULL outside all."""
    named = [F.when(number.between(low, high), F.lit(name)) for name, (low, high) in ranges.items()]
    return F.coalesce(*named)
