"""Running sums in a given order, without a group or the whole table in one task."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlab.functions.predicates import col
from cohortlab.staging import stage

RANGE_ROWS = 1_000_000
_PART = "_part"


def running_sums(
    rows: DataFrame, group: list[str], order: list[str], sums: Mapping[str, Column], range_rows: int = RANGE_ROWS
) -> tuple[DataFrame, DataFrame]:
    """`rows` with, for each name of `sums`, the sum over the rows of its group that come before; and the groups with their totals.

    Rows are range-sorted by group and order into parts of about `range_rows`. Sums inside a part are added to those of the
    parts before, of which there is one row per part and group, so a group may hold most of the table. Missing group values form
    a group. Rows equal in group and order follow in any order.
    """
    parts = max(1, -(-rows.count() // range_rows))
    keys = [col(c) for c in group]
    ranged = stage(rows.repartitionByRange(parts, *(keys + [col(c) for c in order])).select("*", F.spark_partition_id().alias(_PART)))
    sizes = stage(ranged.groupBy(_PART, *keys).agg(*[F.sum(c).alias(name) for name, c in sums.items()]))
    earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col(_PART).alias("_p"), *[col(c).alias(f"_g{i}") for i, c in enumerate(group)],
                         *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_b{i}") for i, name in enumerate(sums)])
    inside = Window.partitionBy(_PART, *keys).orderBy(*[col(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_s{i}") for i, c in enumerate(sums.values())])
    same = reduce(and_, [col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)], F.col(_PART) == F.col("_p"))
    out = placed.join(bases, same).select(*[col(c) for c in rows.columns],
                                          *[(F.col(f"_s{i}") + F.col(f"_b{i}")).alias(name) for i, name in enumerate(sums)])
    totals = sizes.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in sums])
    return out, totals


def numbered(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """`rows` with their place, from 1, in the given order over the whole table."""
    out, _ = running_sums(rows, [], order, {name: F.lit(1).cast("bigint")})
    return out.withColumn(name, F.col(name) + 1)
