"""What the operators share: the word pattern, document keys, and table access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# A word, as all operators count it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
# Documents without an id come after all others.
NO_ID = 2**63 - 1


# Rows of whole texts that one Arrow batch may hold; Spark's default is made for narrow rows.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, with Arrow batches of the session bounded for rows that hold texts."""
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH)) > BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    return df


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a missing id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % n, F.lit(-1))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text, rk): id with NULL last, text with NULL as empty, and a key of the row that survives repeated ids."""
    return small_batches(docs).select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("rk", F.xxhash64("doc", "text"))


def shown_id(doc: Column) -> Column:
    """The id as given: NULL where it was missing."""
    return F.when(doc != NO_ID, doc)
