"""Files named `{id}{suffix}` in a folder: inventory and fetch manifest."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlab.functions.predicates import col
from cohortlab.operators.running import numbered
from cohortlab.sources.placed import openable, store_of
from cohortlab.staging import stage

SUFFIX = ".nii.gz"


# Folders that one task lists.
FOLDERS_TOGETHER = 50


def file_inventory(spark: SparkSession, folder: str, suffix: str = SUFFIX, recursive: bool = False) -> DataFrame:
    """(id, path, length) of the files in a folder, without reading them.

    Folders are listed by tasks, level by level, so no list of files is made on the driver. Hidden files and folders are left out. Stores
    that only Spark can open are listed by Spark, on the driver. A missing folder is an error.
    """
    from pyarrow import fs

    if openable(folder):
        store, root = store_of(folder)
        if store.get_file_info(root).type != fs.FileType.Directory:
            raise FileNotFoundError(f"no such folder: {folder}")
        found = _listed(spark, folder, suffix, recursive)
    else:
        reader = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}")
        found = reader.option("recursiveFileLookup", recursive).load(folder).select("path", "length")
    name = F.substring_index("path", "/", -1)
    return found.select(name.substr(F.lit(1), F.length(name) - len(suffix)).alias("id"), "path", "length")


def _listed(spark: SparkSession, folder: str, suffix: str, recursive: bool) -> DataFrame:
    """(path, length) of the files below a folder, one staged table per level."""
    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = store_of(path)
                rows = [(x.base_name, x.size, x.type == fs.FileType.Directory) for x in store.get_file_info(fs.FileSelector(name))
                        if x.base_name[0] not in "._" and (x.type == fs.FileType.Directory or x.base_name.endswith(suffix))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{path}/{n}" for n, _, _ in rows], pa.string()), pa.array([0 if d else size for _, size, d in rows], pa.int64()),
                     pa.array([d for _, _, d in rows], pa.bool_())], names=["path", "length", "folder"])

    level, count, files = spark.createDataFrame([(folder.rstrip("/"),)], "path string"), 1, []
    while count:
        tasks = -(-count // FOLDERS_TOGETHER)
        listed = stage(level.repartition(tasks, "path").mapInArrow(run, "path string, length long, folder boolean"))
        files.append(listed.where("NOT folder").select("path", "length"))
        level = listed.where("folder").select("path")
        count = level.count() if recursive else 0
    return reduce(DataFrame.unionAll, files)


def sorted_paths(inventory: DataFrame) -> DataFrame:
    """The inventory in path order."""
    return inventory.orderBy("path")


def numbered_paths(inventory: DataFrame) -> DataFrame:
    """The inventory with the `place` of each path in path order, from 1, counted by ranges of paths."""
    return numbered(inventory, ["path"], "place")


def fetch_manifest(requested: DataFrame, existing: DataFrame, id_col: str, folder: str, suffix: str = SUFFIX) -> DataFrame:
    """(id, path, status): every requested id with its target path, `present`
    if it is already there and `fetch` if not. One row per request."""
    there = existing.select(col(id_col)).distinct().withColumn("_there", F.lit(True))
    path = F.concat(F.lit(folder.rstrip("/") + "/"), col(id_col).cast("string"), F.lit(suffix))
    status = F.when(F.col("_there"), F.lit("present")).otherwise(F.lit("fetch"))
    return requested.select(col(id_col)).join(there, id_col, "left").select(
        col(id_col).alias("id"), path.alias("path"), status.alias("status")
    )


def still_to_fetch(requested: DataFrame, existing: DataFrame, id_col: str, folder: str, suffix: str = SUFFIX) -> DataFrame:
    """(id, path) of the requested ids that are not there yet."""
    path = F.concat(F.lit(folder.rstrip("/") + "/"), col(id_col).cast("string"), F.lit(suffix))
    return requested.join(existing.select(col(id_col)), id_col, "left_anti").select(col(id_col).alias("id"), path.alias("path"))
