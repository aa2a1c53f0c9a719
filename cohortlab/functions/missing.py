"""One-time normalisation of missing values at ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortlab.constants import MISSING_TOKENS
from cohortlab.functions.numeric import nan_to_null


def text_or_null(col: Column, tokens: list[str] | None = None) -> Column:
    """Text that spells a missing value becomes NULL."""
    return F.when(~col.isin(MISSING_TOKENS if tokens is None else tokens), col)


def normalise_missing(df: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """NULL for missing-value texts in string columns and for NaN in numeric ones."""
    def clean(field: T.StructField) -> Column:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            col = text_or_null(col, tokens)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            col = nan_to_null(col).cast(field.dataType)
        return col.alias(field.name)

    return df.select([clean(f) for f in df.schema.fields])
