"""Scored results as nested JSON.

An entry of a finding holds three parallel arrays: study ids, labels, scores.
Files for machines are lines of numbered entries of bounded size, so no task
ever holds a whole finding. A single document with one entry per finding is
written and read by many tasks as well: each writes at its place, and reads a
range of entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlab.functions.predicates import col
from cohortlab.operators.running import RANGE_ROWS, running_sums
from cohortlab.sources.json_ranges import CHUNK_BYTES, object_entries
from cohortlab.sources.placed import openable, write_placed
from cohortlab.staging import small_table, stage

ROWS_PER_ENTRY = 100_000
LONG_BYTES = 1_000_000
_FIELDS = "study_id:array<string>,y_true:array<int>,y_score:array<double>"


def write_results(
    scored: DataFrame, path: str, key: str = "study_id", finding: str = "finding", rows_per_entry: int = ROWS_PER_ENTRY
) -> None:
    """Write (finding, key, y_true, y_score) as JSON lines `{finding: {part, arrays}}`.

    Every entry has a part number, also where a finding has only one. Rows of
    an entry are in key order. Entries split a finding by a hash of the whole
    row, sized from the largest finding. Copies of a row are counted before
    they meet and spread over entries.
    """
    rows = _rows(scored, key, finding)
    largest = rows.groupBy("finding").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    entries = max(1, -(-largest // rows_per_entry))
    fields = ["study_id", "y_true", "y_score"]
    piece = F.expr(f"explode(sequence(0L, (n - 1) div {rows_per_entry}))").alias("piece")
    pieces = rows.groupBy("finding", *fields).agg(F.count("*").alias("n")).select("finding", *fields, "n", piece)
    copies = F.least(F.lit(rows_per_entry), F.col("n") - F.col("piece") * rows_per_entry).cast("int")
    part = F.pmod(F.xxhash64(*fields), F.lit(entries)).alias("part")
    cells = F.flatten(F.collect_list(F.array_repeat(F.struct(*fields), copies)))
    nested = pieces.groupBy("finding", part, "piece").agg(F.array_sort(cells).alias("cells"))
    number = (F.col("part") + F.col("piece") * entries).alias("part")
    arrays = F.struct(number, *[F.col(f"cells.{c}").alias(c) for c in fields])
    line = F.to_json(F.create_map("finding", arrays))
    nested.select(line.alias("value")).write.mode("overwrite").text(path)


def _rows(scored: DataFrame, key: str, finding: str) -> DataFrame:
    return scored.select(
        col(finding).cast("string").alias("finding"), col(key).cast("string").alias("study_id"),
        F.col("y_true").cast("int").alias("y_true"), F.col("y_score").cast("double").alias("y_score"),
    )


def write_document(
    scored: DataFrame, path: str, key: str = "study_id", finding: str = "finding", max_rows: int | None = None, range_rows: int = RANGE_ROWS,
) -> None:
    """Write one JSON document `{finding: arrays}` as the file `path`: findings by name, rows of a finding in key order.

    Every task writes its elements where they belong in the file, so nothing is gathered, however many rows a finding has. With
    `max_rows`, more rows raise.
    """
    def text(name: str):
        """A value as it stands in JSON, and NULL as null."""
        whole = F.to_json(F.struct(F.col(name).alias("x")))
        return F.when(F.col(name).isNull(), F.lit("null")).otherwise(whole.substr(F.lit(6), F.length(whole) - 6))

    def size(c) -> Column:
        return F.octet_length(c).cast("bigint")

    fields = ["study_id", "y_true", "y_score"]
    rows = _rows(scored, key, finding).withColumn("finding", F.coalesce("finding", F.raise_error(F.lit("a finding without a name")).cast("string")))
    rows = rows.select("finding", *fields, *[text(c).alias(f"t{i}") for i, c in enumerate(fields)])
    sums = {f"b{i}": size(f"t{i}") for i in range(3)} | {"i": F.lit(1).cast("bigint")}
    rows, totals = running_sums(rows, ["finding"], fields, sums, range_rows)
    totals = stage(totals)
    n = totals.agg(F.sum("i")).first()[0] or 0
    if max_rows is not None and n > max_rows:
        raise ValueError(f"{n} rows do not go into a document of at most {max_rows} rows")
    glue = [F.concat(text("finding"), F.lit(f':{{"{fields[0]}":[')), *[F.lit(f'],"{c}":[') for c in fields[1:]], F.lit("]}")]
    parts = totals.select("finding", *[F.col(f"b{i}").alias(f"all{i}") for i in range(3)], F.col("i").alias("n"), *[g.alias(f"g{j}") for j, g in enumerate(glue)])
    # Where the glue stands inside an entry: after the elements before it and the commas between them.
    at, places = F.lit(0).cast("bigint"), []
    for j in range(4):
        places.append(at.alias(f"p{j}"))
        at = at + size(f"g{j}") + (F.col(f"all{j}") + F.col("n") - 1 if j < 3 else F.lit(0))
    parts, whole = running_sums(parts.select("*", *places, at.alias("length")), [], ["finding"], {"start": F.col("length") + 1}, range_rows)
    length = (whole.first() or [None])[0] or 0
    entries = small_table(parts.withColumn("start", F.col("start") + 1))[0]
    comma = F.when(F.col("start") > 1, F.lit(",")).otherwise(F.lit("{"))
    glued = entries.select(F.inline(F.array(
        F.struct((F.col("start") - 1).alias("at"), F.concat(comma, "g0").alias("value")),
        *[F.struct((F.col("start") + F.col(f"p{j}")).alias("at"), F.col(f"g{j}").alias("value")) for j in range(1, 4)])))
    inner = rows.join(entries, "finding").select(F.inline(F.array(*[F.struct(
        (F.col("start") + F.col(f"p{i}") + size(f"g{i}") + F.col(f"b{i}") + F.greatest(F.lit(0), F.col("i") - 1)).alias("at"),
        F.concat(F.when(F.col("i") > 0, F.lit(",")).otherwise(F.lit("")), F.col(f"t{i}")).alias("value")) for i in range(3)])))
    edge = scored.sparkSession.createDataFrame([(length or 1, "}\n")] + ([] if length else [(0, "{")]), "at long, value string")
    folder, _, name = path.rstrip("/").rpartition("/")
    placed = glued.unionByName(inner).unionByName(edge).withColumn("file", F.lit(name))
    write_placed(placed, {name: (length or 1) + 2}, folder or ".")


def read_results(
    spark: SparkSession, path: str, one_document: bool = False, chunk_bytes: int = CHUNK_BYTES, long_bytes: int = LONG_BYTES
) -> DataFrame:
    """(finding, study_id, y_true, y_score) from result files.

    Lines as written by `write_results`, or with `one_document` files that are
    a single JSON document over many lines, whose entries are read by many
    tasks (by one per file in stores that only Spark can open). Entries of
    more than `long_bytes` are read in pieces. Text that is not such JSON
    raises, and so do arrays of unequal length.
    """
    if one_document and openable(path):
        documents = object_entries(spark, path, chunk_bytes, long_bytes)
    else:
        documents = spark.read.text(path, wholetext=one_document).filter(F.trim("value") != "")
    entries = F.from_json("value", f"map<string,struct<part:bigint,{_FIELDS}>>", {"mode": "FAILFAST"})
    parsed = documents.select(F.explode(entries).alias("finding", "d"))
    sizes = [F.size(F.col(f"d.{c}")) for c in ("study_id", "y_true", "y_score")]
    equal = (sizes[0] == sizes[1]) & (sizes[0] == sizes[2]) & (sizes[0] >= 0)
    broken = F.raise_error(F.concat(F.lit("arrays of unequal length in "), "finding"))
    # An entry that lacks an array has no rows to raise on, so the check is on the arrays.
    return parsed.select("finding", F.inline(F.when(equal, F.arrays_zip("d.study_id", "d.y_true", "d.y_score")).otherwise(broken)))
