"""Cohort selection: who is in, who is out, and membership joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlab.constants import OFFICIAL_RANGES
from cohortlab.functions.predicates import col, definite, flag_value, positive_count, range_name, with_any_other


def official_split(
    df: DataFrame, id_num: str, ranges: dict[str, tuple[int, int]] = OFFICIAL_RANGES, name: str = "split"
) -> DataFrame:
    """Add the split that the id number falls into; NULL outside every range."""
    return df.withColumn(name, range_name(col(id_num), ranges))


def positives(df: DataFrame, flag: str, strict: bool = False) -> DataFrame:
    """Rows whose flag, cut to an integer, is >= 1. `strict`: a missing flag raises."""
    return df.filter(flag_value(flag, strict) >= 1)


def negative_pool(df: DataFrame, flag: str, strict: bool = False) -> DataFrame:
    """Rows whose flag, cut to an integer, is 0. `strict`: a missing flag raises."""
    return df.filter(flag_value(flag, strict) == 0)


def with_class(df: DataFrame, flag: str, name: str = "label", strict: bool = False) -> DataFrame:
    """Keep positives and negatives in one pass, named `pos` and `neg`."""
    value = flag_value(flag, strict)
    label = F.when(value >= 1, F.lit("pos")).when(value == 0, F.lit("neg"))
    return df.withColumn(name, label).filter(col(name).isNotNull())


def lesion_cohort(df: DataFrame, count: str) -> DataFrame:
    """Rows with at least one lesion; a missing count is no lesion."""
    return df.filter(positive_count(count))


def compound_cohort(df: DataFrame, main: str, others: list[str]) -> DataFrame:
    """Rows with a lesion in `main` and in at least one of `others`."""
    return df.filter(with_any_other(main, others))


def members(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose id is in `ids`; repeats in `ids` do not multiply rows."""
    return df.join(ids.select(on), on, "left_semi")


def non_members(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose id is not in `ids`: the complement, or what is still to do."""
    return df.join(ids.select(on), on, "left_anti")


def flag_members(df: DataFrame, ids: DataFrame, on: str, name: str = "is_member") -> DataFrame:
    """All rows, with a flag that says whether the id is in `ids`."""
    marks = ids.select(on).distinct().withColumn(name, F.lit(True))
    return df.join(marks, on, "left").withColumn(name, definite(col(name)))


def lookup(request: DataFrame, table: DataFrame, on: str, strict: bool = True) -> DataFrame:
    """Rows of `table` for the requested ids, one per request (repeats kept).

    An unknown id raises with `strict`; otherwise its row comes back with
    `missing` = true. The raise is in the surviving columns, so it cannot be
    pruned away.
    """
    found = request.join(table.withColumn("_known", F.lit(True)), on, "left")
    unknown = F.raise_error(F.concat(F.lit(f"unknown {on}: "), col(on).cast("string")))
    if strict:
        key: Column = F.when(col("_known"), col(on)).otherwise(unknown.cast(request.schema[on].dataType))
        return found.withColumn(on, key).drop("_known")
    return found.withColumn("missing", col("_known").isNull()).drop("_known")
