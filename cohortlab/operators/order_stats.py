"""Order statistics that no single task has to sort.

Values are cut into buckets of about equal counts over the whole column. A
bucket is a pure function of the value, so equal values share one, and it
holds a bounded share of the rows however the values are spread over groups.
Counts per bucket then say in which bucket a wanted rank lies, and only that
bucket's distinct values are sorted. The edges affect balance only: results
are exact for any edges.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from cohortlab.functions.predicates import col
from cohortlab.staging import small_table

ROWS_PER_BUCKET = 200_000
MAX_BUCKETS = 100_000
# Entries of value -> count maps that one task may hold: about 250 MB.
MAP_ENTRIES = 4_000_000
# Size of a quantile sketch, and sketches that one task merges.
SKETCH_LEAST, SKETCH_MOST, SKETCH_BRANCHES = 200, 65_535, 256
# Groups whose maps an aggregation task holds at once before it sorts instead.
OPEN_GROUPS = 128


@dataclass(frozen=True)
class Probe:
    """How many values some columns hold in all, and whether value -> count
    maps of them, one per group, are small enough for one task."""

    values: int
    few: bool
    # Whether it pays to count equal values before they travel.
    repeats: bool = field(default=True, compare=False)


def probe(df: DataFrame, columns: list[str], by: list[str] | None = None, limit: int = MAP_ENTRIES) -> Probe:
    """One scan, counts and sketches only."""
    row = df.agg(
        F.array(*[F.count(col(c)) for c in columns]).alias("values"),
        F.array(*[F.approx_count_distinct(col(c)) for c in columns]).alias("distinct"),
        F.approx_count_distinct(F.struct(*map(col, by))).alias("groups") if by else F.lit(1).alias("groups"),
    ).first()
    values = sum(row["values"])
    entries = min(values, sum(row["distinct"]) * min(row["groups"], OPEN_GROUPS))
    return Probe(values, entries <= limit, 2 * sum(row["distinct"]) * row["groups"] < values)


def value_edges(
    df: DataFrame, value: str, rows_per_bucket: int = ROWS_PER_BUCKET, rows: int | None = None
) -> list[float]:
    """Inner bucket edges; none if all rows fit into one bucket.

    Edges are quantiles of a sketch that is built where the rows lie and merged in a tree, so what meets in a task or reaches the driver
    is a sketch and two edges per bucket, however the values are spread. The sketch's rank error is a fraction of a bucket up to about a
    thousand buckets, and at most about 1 in 10,000 of the rows beyond. Edges are distinct, so one very frequent value gets a bucket
    of its own at most; grouping by value collapses it before any sort. The outer buckets hold infinities; NaN has a bucket above them,
    as in Spark's own order.
    """
    if rows is None:
        rows = df.filter(col(value).isNotNull()).count()
    buckets = min(-(-rows // rows_per_bucket), MAX_BUCKETS)
    if buckets <= 1:
        return []
    finite = df.select(col(value).cast("double").alias("x")).filter(F.abs("x") < float("inf"))
    k = min(SKETCH_MOST, max(SKETCH_LEAST, 16 * buckets))
    branches = finite.groupBy((F.spark_partition_id() % SKETCH_BRANCHES).alias("b")).agg(F.kll_sketch_agg_double("x", k).alias("s"))
    cuts = 2 * buckets
    # One literal for all ranks: they must be known when the query is built.
    ranks = F.split(F.lit(",".join(str(i / cuts) for i in range(1, cuts))), ",").cast("array<double>")
    row = branches.agg(F.kll_merge_agg_double("s", k).alias("s")).where(F.kll_sketch_get_n_double("s") > 0) \
        .select(F.kll_sketch_get_quantile_double("s", ranks).alias("edges")).first()
    return sorted(set(row.edges)) if row else []


def with_bucket(df: DataFrame, value: str, edges: list[float], name: str = "bucket") -> DataFrame:
    """Add the bucket number: how many edges are <= value; NULL for no value."""
    if not edges:
        return df.withColumn(name, F.when(col(value).isNotNull(), F.lit(0)))
    splits = [float("-inf"), *map(float, edges), float("inf")]
    number = Bucketizer(splits=splits, inputCol=value, outputCol=name, handleInvalid="keep").transform(df)
    return number.withColumn(name, col(name).cast("int"))


def exact_quantiles(
    df: DataFrame,
    measures: list[str],
    probs: list[float],
    by: list[str] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    builtin: bool | None = None,
    found: Probe | None = None,
) -> DataFrame:
    """(*by, measure, p, value): exact quantiles, linear between ranks.

    A missing group key is a group; missing values are left out, and a group
    without values has no row. `builtin` chooses Spark's own exact percentile
    (None: where its value -> count maps are checked to be small). `found` is a
    probe of the same measures, if there is one already.
    """
    by = by or []
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), col(m).cast("double").alias("value")) for m in measures])
    long = df.select(*map(col, by), F.inline(cells)).filter(F.col("value").isNotNull())
    keys = [*by, "measure"]
    if found is None and not builtin:
        found = probe(df, measures, by)
    if builtin or (builtin is None and found.few):
        # Values that repeat are counted where they lie, so what meets in one task is the checked number of distinct values.
        if found is None or found.repeats:
            counted = long.groupBy(*map(col, keys), "value").agg(F.count("*").alias("_n"))
        else:
            counted = long.withColumn("_n", F.lit(1))
        at_once = counted.groupBy(*map(col, keys)).agg(F.percentile("value", F.array(*map(F.lit, probs)), F.col("_n")).alias("values"))
        pairs = F.arrays_zip(F.array(*map(F.lit, probs)).alias("p"), F.col("values").alias("value"))
        return at_once.select(*map(col, keys), F.inline(pairs))

    long = with_bucket(long, "value", value_edges(long, "value", rows_per_bucket, found.values), "_bucket")
    # Per key at most one row per bucket, so these windows stay small.
    in_order = Window.partitionBy(*map(col, keys)).orderBy("_bucket")
    whole = Window.partitionBy(*map(col, keys))
    counts = long.groupBy(*map(col, keys), "_bucket").agg(F.count("*").alias("_n"))
    placed = counts.select(
        *map(col, keys), "_bucket", "_n",
        (F.sum("_n").over(in_order) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("_rows"),
    )
    ranks = F.array(*[
        F.struct(F.lit(p).alias("p"), (F.lit(p) * (F.col("_rows") - 1)).alias("_at")) for p in probs
    ])

    def holds(before, n, x):
        low, high = F.floor(x["_at"]), F.ceil(x["_at"])
        inside = lambda rank: (rank >= before) & (rank < before + n)
        return inside(low) | inside(high)

    wanted = placed.withColumn("_ranks", F.filter(ranks, lambda x: holds(F.col("_before"), F.col("_n"), x)))
    wanted = wanted.filter(F.size("_ranks") > 0).drop("_n")
    wanted, _ = small_table(wanted)
    renamed = wanted.select(*[col(k).alias(f"_w_{k}") for k in keys], F.col("_bucket").alias("_w_bucket"), "_before", "_ranks")
    same = [col(k).eqNullSafe(col(f"_w_{k}")) for k in by]
    same += [F.col("measure") == F.col("_w_measure"), F.col("_bucket") == F.col("_w_bucket")]
    same = reduce(and_, same)
    near = long.join(renamed, same, "left_semi")
    distinct = near.groupBy(*map(col, keys), "_bucket", "value").agg(F.count("*").alias("_n"))
    in_bucket = Window.partitionBy(*map(col, keys), "_bucket").orderBy("value")
    ranked = distinct.withColumn("_upto", F.sum("_n").over(in_bucket)).join(renamed, same)
    before = (F.col("_before") + F.col("_upto") - F.col("_n")).alias("_before")
    ranked = ranked.select(*map(col, keys), "value", before, "_n", F.inline("_ranks"))

    def value_at(rank):
        hit = (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_n"))
        return F.max(F.when(hit, F.col("value")))

    low, high = F.floor("_at"), F.ceil("_at")
    ends = ranked.groupBy(*map(col, keys), "p").agg(
        value_at(low).alias("_low"), value_at(high).alias("_high"), F.max(F.col("_at") - low).alias("_weight")
    )
    value = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_weight")
    return ends.select(*map(col, keys), "p", value.alias("value"))
