"""Records of CSV files whose quoted fields hold line breaks, cut by many tasks.

Spark reads lines, a block of a file per task. Whether a line starts inside a quoted field depends on all before it, so a first pass
tells for each block how it ends in both cases; the blocks of a file in order then settle where each starts. A second pass puts lines
together into records. Only a record that goes over the border of a block is joined from its pieces afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohortlab.staging import small_table, stage

# A record longer than this is an unbalanced quote, and an error.
MAX_RECORD = 128_000_000
WHOLE, TAIL, HEAD = 0, 1, 2


def open_after(line: str, inside: bool, sep: str = ",") -> bool:
    """Does the line end inside a quoted field? `inside`: it starts inside one.

    A quote opens a field only at its start, and is closed by a quote that is not doubled; other quotes are text.
    """
    at = 0
    if not inside:
        inside, at = line[:1] == '"', 1
        if not inside:
            at = 0
    while True:
        if inside:
            end = line.find('"', at)
            while end >= 0 and line[end + 1: end + 2] == '"':
                end = line.find('"', end + 2)
            if end < 0:
                return True
            at, inside = end + 1, False
        at = line.find(sep, at) + 1
        if not at:
            return False
        if line[at: at + 1] == '"':
            at, inside = at + 1, True


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in order within each block; a carriage return stays at the end of its line."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64(meta["file_path"]).alias("file"), meta["file_block_start"].alias("block"), "value")


def _stretches(batch: pa.RecordBatch):
    """(file, block, lines) of the blocks of a batch."""
    file, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "block"))
    edges = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
        yield int(file[a]), int(block[a]), batch.column("value").slice(a, b - a)


def _quoted(lines: pa.Array) -> list[int]:
    """Numbers of the lines that hold a quote: only these can change what comes after."""
    return np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)).tolist()


def _ends(sep: str):
    """How each block ends if it starts outside of quotes, and if inside."""
    def run(batches):
        now, state = None, [False, True]

        def done():
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, *state)], names=["file", "block", "out", "in"])

        for batch in batches:
            for file, block, lines in _stretches(batch):
                if (file, block) != now:
                    if now:
                        yield done()
                    now, state = (file, block), [False, True]
                for i in _quoted(lines):
                    line = lines[i].as_py()
                    state = [open_after(line, s, sep) for s in state]
        if now:
            yield done()

    return run


def _records(sep: str, pieces: bool, max_record: int):
    """Records inside a block, or with `pieces` the parts of those that go over its borders.

    Rows are (file, block, kind, first, value); the column `inside` tells how the block starts.
    """
    def run(batches):
        now, held, size, inside, kind, first = None, [], 0, False, WHOLE, False

        def row(k: int, value: str, f: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([k], pa.int32()), pa.array([f]), pa.array([value], pa.string())],
                names=["file", "block", "kind", "first", "value"])

        def plain(lines: pa.Array) -> pa.RecordBatch:
            n = len(lines)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, now[0])), pa.array(np.full(n, now[1])), pa.array(np.full(n, WHOLE, np.int32)),
                 pa.array([first] + [False] * (n - 1)), lines.cast(pa.string())], names=["file", "block", "kind", "first", "value"])

        def hold(lines: list[str]) -> None:
            nonlocal size
            held.extend(lines)
            size += sum(map(len, lines)) + len(lines)
            if size > max_record:
                raise ValueError(f"a record of more than {max_record} characters: a quote is not closed")

        def closed_block():
            # What is open at the end of a block goes on in the next; a block all inside a field is a head that does not close.
            return row(HEAD if kind == HEAD else TAIL, "\n".join(held), first) if held and pieces else None

        for batch in batches:
            starts = batch.column("inside").to_numpy(zero_copy_only=False)
            at = 0
            for file, block, lines in _stretches(batch):
                if (file, block) != now:
                    if now and (last := closed_block()):
                        yield last
                    now, held, size, inside, first = (file, block), [], 0, bool(starts[at]), block == 0
                    kind = HEAD if inside else WHOLE
                at += len(lines)
                done = 0
                for i in [*_quoted(lines), len(lines)]:
                    if i > done:
                        if inside:
                            hold(lines.slice(done, i - done).to_pylist())
                        else:
                            if not pieces:
                                yield plain(lines.slice(done, i - done))
                            first = False
                    if i == len(lines):
                        break
                    line = lines[i].as_py()
                    done = i + 1
                    inside = open_after(line, inside, sep)
                    hold([line])
                    if not inside:
                        if pieces == (kind == HEAD):
                            yield row(kind, "\n".join(held), first)
                        held, size, kind, first = [], 0, WHOLE, False
        if now and (last := closed_block()):
            yield last

    return run


def records(spark: SparkSession, path: str, sep: str = ",", max_record: int = MAX_RECORD) -> DataFrame:
    """(value, first): the records of CSV files, `first` for the first of each file. Blank ones are left out.

    Files may be cut anywhere, so one file is read by as many tasks as Spark would use for its lines. A field that is not closed at
    the end of a file is taken as it stands; beyond `max_record` characters it is an error.
    """
    lines = _lines(spark, path)
    ends = stage(lines.mapInArrow(_ends(sep), "file long, block long, out boolean, in boolean"))
    # How a block starts: the result of the last block before it that ends alike in both cases, turned by the blocks since.
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("out") == F.col("in")
    turns = F.sum(F.when(~fixed & F.col("out"), 1).otherwise(0)).over(order)
    known = ends.withColumn("turns", turns).withColumn("mark", F.when(fixed, F.struct(F.col("out").alias("state"), "turns")))
    last = F.last("mark", ignorenulls=True).over(earlier)
    before = F.coalesce(F.lag("turns").over(order), F.lit(0))
    known = known.withColumn("odd", (before - F.coalesce(last["turns"], F.lit(0))) % 2 == 1).withColumn(
        "inside", F.coalesce(last["state"], F.lit(False)) != F.col("odd"))
    known = stage(known.select("file", "block", "inside", F.when(F.col("inside"), F.col("in")).otherwise(F.col("out")).alias("open")))
    starts, rows = small_table(known.select("file", "block", "inside"))
    if rows is None:
        # So many blocks that they are joined by shuffle: lines are numbered before and put in order again.
        joined = lines.withColumn("n", F.monotonically_increasing_id()).join(starts, ["file", "block"]).sortWithinPartitions("file", "block", "n").drop("n")
    else:
        joined = lines.join(starts, ["file", "block"])
    joined = joined.select("file", "block", "inside", "value")
    schema = "file long, block long, kind int, first boolean, value string"
    whole = joined.mapInArrow(_records(sep, False, max_record), schema).select("value", "first")
    if known.where("inside OR open").isEmpty():
        return _trimmed(whole)
    parts = stage(joined.mapInArrow(_records(sep, True, max_record), schema))
    opened = F.last(F.when(F.col("kind") == TAIL, F.col("block")), ignorenulls=True)
    head = F.when(F.col("kind") == HEAD, opened.over(Window.partitionBy("file").orderBy("block", F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)))
    owned = parts.withColumn("owner", F.coalesce(head, "block"))
    joined = owned.groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("block", "value", "first"))).alias("x")).select(
        F.array_join("x.value", "\n").alias("value"), F.get("x", F.lit(0))["first"].alias("first"))
    return _trimmed(whole.unionByName(joined))


def _trimmed(found: DataFrame) -> DataFrame:
    """Without the carriage return of a record's end, and without blank records."""
    value = F.when(F.endswith("value", F.lit("\r")), F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    return found.select(value.alias("value"), "first").where("first OR length(value) > 0")


def read_quoted(spark: SparkSession, path: str, columns: list[str], options: dict) -> DataFrame:
    """The files as columns of text, without their header rows."""
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    rows = records(spark, path, options.get("sep", ",")).where(~F.col("first"))
    parsed = rows.select(F.from_csv("value", F.lit(schema), options).alias("row"))
    return parsed.select(*[F.col("row").getField(c).alias(c) for c in columns])
