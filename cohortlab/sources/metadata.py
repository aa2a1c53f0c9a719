"""Metadata tables in CSV."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlab.functions.missing import normalise_missing
from cohortlab.functions.numeric import to_number
from cohortlab.functions.predicates import col
from cohortlab.functions.text import id_number, strip
from cohortlab.sources.quoted_csv import read_quoted


def read_metadata(
    spark: SparkSession, path: str, types: Mapping[str, str] | None = None, id_col: str | None = None,
    infer: bool = False, multi_line: bool = False,
) -> DataFrame:
    """A CSV with a header row, missing values normalised.

    Columns are read as text and only those named in `types` are converted, so
    no extra pass over the data infers a schema; `infer` asks for one when
    exploring: a column is a whole number or a number if all its values that
    are not missing are. A value that does not fit its type becomes missing.
    With `id_col`, `id_num` is the first run of digits of that column. Files
    are split over many tasks, also with `multi_line`, for quoted notes that
    hold line breaks (a quote in a quoted field is doubled).
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    table = reader.csv(path)
    if multi_line and table.columns:
        table = read_quoted(spark, path, table.columns, {"escape": '"'})
    raw = normalise_missing(table)
    types = {**(inferred_types(raw) if infer else {}), **(types or {})}

    def typed(name: str) -> Column:
        wanted = types.get(name, "string")
        if wanted == "string":
            return col(name)
        value = to_number(col(name)).try_cast(wanted)
        if wanted in ("int", "bigint"):  # long numbers do not survive a double
            value = F.coalesce(strip(col(name)).try_cast(wanted), value)
        return value.alias(name)

    table = raw.select([typed(c) for c in raw.columns])
    return table.withColumn("id_num", id_number(col(id_col))) if id_col else table


def inferred_types(texts: DataFrame) -> dict[str, str]:
    """`bigint` or `double` for columns of text whose values are all such numbers, in one aggregation."""
    def counts(name: str) -> list[Column]:
        number = to_number(col(name))
        whole = strip(col(name)).try_cast("bigint")
        return [F.count(col(name)), F.count(F.when(number.isNotNull(), whole)), F.count(number)]

    row = texts.agg(*[F.array(*counts(c)) for c in texts.columns]).first()
    kinds = {c: "bigint" if n and n == whole else "double" if n and n == number else None
             for c, (n, whole, number) in zip(texts.columns, row)}
    return {c: kind for c, kind in kinds.items() if kind}
