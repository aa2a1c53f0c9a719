"""Id lists: one id per line; one file or folder per split."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlab.functions.predicates import col
from cohortlab.functions.text import strip
from cohortlab.operators.running import RANGE_ROWS, running_sums
from cohortlab.sources.placed import file_sizes, write_placed


def _ids(lines: DataFrame, *keep) -> DataFrame:
    return lines.select(*keep, strip(F.col("value")).alias("id")).filter(F.length("id") > 0)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id): stripped lines, blank ones dropped, repeats kept."""
    return _ids(spark.read.text(path))


def write_ids(ids: DataFrame, path: str, id_col: str = "id") -> None:
    """Write one id per line, replacing what is at `path`."""
    ids.select(col(id_col).cast("string")).write.mode("overwrite").text(path)


def read_split_files(spark: SparkSession, folder: str) -> DataFrame:
    """(split, id) from a folder of `{split}.txt` files."""
    lines = spark.read.option("pathGlobFilter", "*.txt").text(folder)
    # Spark gives names as in a URL, where a plus sign stands for itself.
    shown = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    name = F.regexp_extract(shown, r"(?s)^(.*)\.txt$", 1)
    return _ids(lines, name.alias("split"))


def write_split_files(splits: DataFrame, folder: str, names: Iterable[str] = (), range_rows: int = RANGE_ROWS) -> None:
    """Write (split, id) as one file `{split}.txt` per split, ids in order of their text.

    Every file is written by as many tasks as its ids need, each at its place, and appears when it is complete. Files of the
    splits at hand are replaced, others stay; `names` lists splits that get a file even if they have no ids.
    """
    lines = splits.select(F.concat(col("split").cast("string"), F.lit(".txt")).alias("file"),
                          F.concat(F.coalesce(col("id").cast("string"), F.lit("")), F.lit("\n")).alias("value"))
    size = F.octet_length("value").cast("bigint")
    placed, totals = running_sums(lines, ["file"], ["value"], {"at": size}, range_rows)
    write_placed(placed, {**{f"{n}.txt": 0 for n in names}, **file_sizes(totals, "file", "at")}, folder)


def write_splits(splits: DataFrame, folder: str) -> None:
    """Write (split, id) with one sub-folder per split.

    Splits present in `splits` are replaced, others in the folder stay. The
    rebalance lets adaptive execution cut a large split into several files and
    put small ones together, whatever the mix.
    """
    lines = splits.select("split", col("id").cast("string").alias("id")).hint("rebalance", "split")
    lines.write.partitionBy("split").mode("overwrite").option("partitionOverwriteMode", "dynamic").text(folder)


def read_splits(spark: SparkSession, folder: str) -> DataFrame:
    """(split, id) as written by `write_splits`; a filter on split prunes folders."""
    lines = spark.read.schema("value string, split string").text(folder)
    return _ids(lines, "split")
