"""Size-checked small tables, and intermediates written to the shared folder."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cohortlab.session import shared_dir

SMALL_ROWS = 200_000
SMALL_BYTES = 64_000_000


_made: list[str] = []


def new_folder(spark, label: str) -> str:
    """A fresh path in the shared folder; nothing is created yet."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear_folders(spark) -> int:
    """Remove the folders this process has made, once no result that reads them is needed; returns their number."""
    conf, path_of = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    removed = 0
    while _made:
        path = path_of(_made.pop())
        removed += path.getFileSystem(conf).delete(path, True)
    return removed


def stage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage and survives lost executors; later scans prune columns
    and push filters down, which a checkpoint would not.
    """
    path = new_folder(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(df: DataFrame, max_rows: int = SMALL_ROWS, bounded: bool = False) -> tuple[DataFrame, pa.Table | None]:
    """`df` computed once, for joining to a much larger table.

    With at most `max_rows` rows and SMALL_BYTES of values it becomes a local
    table in one partition, which further grouping need not shuffle, marked
    for broadcast; its rows are returned with it. A larger one is left
    unmarked (rows: None), so a join shuffles and adaptive execution splits
    hot keys. Rows of fixed narrow types are small if they are few; others are
    staged first, and rows and bytes are counted there before any are fetched.
    `bounded` says that the size is known from a table checked before.
    """
    if not bounded and any(not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType)) for f in df.schema.fields):
        df = stage(df)
        size = sum((F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{c}`")))), F.lit(0)) for c in df.columns), F.lit(0))
        rows, nbytes = df.limit(max_rows + 1).agg(F.count("*"), F.sum(size)).first()
        if rows > max_rows or (nbytes or 0) > SMALL_BYTES:
            return df, None
        bounded = True
    rows = df.toArrow() if bounded else df.limit(max_rows + 1).toArrow()
    if bounded or rows.num_rows <= max_rows:
        return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema).coalesce(1)), rows
    return stage(df), None
