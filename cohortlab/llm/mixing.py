"""Mixing sources to target weights by a curriculum whose weights vary with training time.

Each source has a weight schedule w(t) over training time t in [0, 1]: knots joined by straight lines. Its integral is the source's
weight in the mix; the running integral, scaled to the source's target, is its cumulative demand for tokens. Documents of a source
stand in hash order; the position of a document is the time at which demand reaches the tokens that stand before it. The result is
sorted by position, so reading it in order follows the curriculum.

Defined cases: NULL or blank texts have size 0 and take nothing; a missing source is a source of its own, after all others; repeated
rows count as documents of their own (rows equal in id, size and source are interchangeable); an empty table gives an empty result;
other columns of the table are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from cohortlab.llm.common import word_count
from cohortlab.operators.running import running_sums
from cohortlab.staging import stage

MAX_REPEATS = 3
BUCKET_ROWS = 4_096
# Weights are given per source, so sources are as many as a person can name; more is an error, not a cut.
MAX_SOURCES = 100_000

Knots = list[tuple[float, float]]


def ramp(weight: float) -> Knots:
    """Light sources fade, heavy ones grow; the integral stays `weight`."""
    tilt = (weight - 2) / 2
    return [(0.0, weight * (1 - tilt / 2)), (1.0, weight * (1 + tilt / 2))]


def cycle_ramps(rank: int) -> Knots:
    """Schedules of weight 1, 2, 3, repeating over sources in code-point order."""
    return ramp(rank % 3 + 1)


def integral(knots: Knots) -> list[float]:
    """Running integral of a schedule at its knots."""
    total, out = 0.0, [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        total += (t1 - t0) * (w0 + w1) / 2
        out.append(total)
    return out


def targets(sizes: list[int], weights: list[float], repeats: float = MAX_REPEATS) -> list[float]:
    """Shares of the sum of sizes by weight; what exceeds `repeats` sizes is shared again among the others."""
    out: list[float | None] = [None] * len(sizes)
    left = float(sum(sizes))
    while any(x is None for x in out):
        open_ = [i for i, x in enumerate(out) if x is None]
        total = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / total if total else 0.0 for i in open_}
        over = [i for i in open_ if share[i] > repeats * sizes[i]]
        for i in over or open_:
            out[i] = float(repeats * sizes[i]) if over else share[i]
        left -= sum(repeats * sizes[i] for i in over)
    return out


def plan_mix(
    docs: DataFrame, schedule: Callable[[int], Knots] = cycle_ramps, repeats: float = MAX_REPEATS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keys: dict | None = None,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies, position) of every document, sorted by position.

    `taken` counts words with repeats: whole passes over the source, then one pass cut where the target is met. `copies` is the
    number of times to emit the document (a cut copy counts if at least half is taken); `position` is that of its first copy.
    `schedule` gives the knots of the source at each rank. `keys` adds columns to carry along.
    """
    spark = docs.sparkSession
    carried = list(keys or {})
    sized = stage(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        *[c.alias(k) for k, c in (keys or {}).items()],
    ).withColumn("_h", F.xxhash64("doc_id", "source", "size")))
    found = sized.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    knots = [schedule(i) for i in range(len(found))]
    areas = [integral(k) for k in knots]
    wanted = targets([r.s for r in found], [a[-1] for a in areas], repeats)
    sources = F.broadcast(spark.createDataFrame(
        [(i, r.source, r.s, t, max(1, -(-r.n // BUCKET_ROWS)), [float(x) for x, _ in k], [float(w) for _, w in k], a)
         for i, (r, t, k, a) in enumerate(zip(found, wanted, knots, areas))],
        "_sid int, _source string, source_size long, target double, _nb long, _t array<double>, _w array<double>, _a array<double>"))
    placed = sized.join(sources, sized.source.eqNullSafe(sources._source)).withColumn(
        "_b", F.shiftright(F.shiftrightunsigned("_h", 33) * F.col("_nb"), 31))
    # Tokens before each document: before its bucket of hashes, plus before it in the bucket.
    buckets = placed.groupBy("_sid", "_b").agg(F.sum("size").alias("_s"))
    before = Window.partitionBy("_sid").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("_sid", "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_sid", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    rows = placed.join(buckets, ["_sid", "_b"]).withColumn("_start", start)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = F.round("target").cast("bigint") - F.col("_passes") * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_start"))).cast("bigint")
    rows = rows.withColumn("_passes", passes).withColumn("_rest", rest).withColumn("_cut", cut)
    copies = F.col("_passes") + F.when((F.col("_cut") * 2 >= F.col("size")) & (F.col("_start") < F.col("_rest")), 1).otherwise(0)
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("_passes") * F.col("size") + F.col("_cut")).alias("taken"),
        copies.alias("copies"), position(F.col("_start")).alias("position"), *carried,
    ).orderBy("position", "doc_id")


def position(start):
    """Time at which the demand of the row's source reaches `start` tokens; 1 for what is never reached.

    The demand is quadratic between knots: the knot before is looked up by area, the rest is solved in closed form.
    """
    total = F.element_at("_a", -1)
    area = F.when(F.col("target") > 0, F.least(start * total / F.col("target"), total)).otherwise(total)
    i = F.greatest(F.lit(1), F.least(F.size("_a") - 1, F.size(F.filter("_a", lambda a: a <= area))))
    t0, t1, w0, w1 = (F.element_at(c, i + d) for c, d in (("_t", 0), ("_t", 1), ("_w", 0), ("_w", 1)))
    part = area - F.element_at("_a", i)
    slope = (w1 - w0) / (t1 - t0)
    root = F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * part))
    return F.least(F.lit(1.0), t0 + F.when(part <= 0, 0.0).otherwise(2 * part / (w0 + root)))


def mix_documents(docs: DataFrame, schedule: Callable[[int], Knots] = cycle_ramps, repeats: float = MAX_REPEATS) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, range-sorted by training position; columns unchanged.

    Rows equal in id, source and text may take different numbers of copies, where one of them is cut by the target: they are numbered
    on both sides, so each gets its own. Any may be which, as they are alike.
    """
    key = F.xxhash64("doc_id", "source", "text")
    plan = plan_mix(docs, schedule, repeats, keys={"_rk": key}).select("_rk", "copies", "position", F.col("source_size").alias("size"), "target")
    rows = docs.select(F.struct("*").alias("row"), key.alias("_rk"))
    # Only rows that are repeated need numbers: others are the first of their key.
    often = stage(rows.groupBy("_rk").agg(F.count("*").alias("n")).where("n > 1").select("_rk"))
    if often.isEmpty():
        narrow, numbered = _first(plan), _first(rows)
    else:
        narrow, numbered = _numbered(plan, often, "position", "copies"), _numbered(rows, often)
    narrow = narrow.where("copies > 0")
    out = numbered.join(narrow, ["_rk", "_no"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
    # Later passes over a source lie later by the share of its target that one pass takes.
    at = F.col("position") + F.col("copy") * F.least(F.lit(1.0), F.col("size") / F.col("target"))
    return out.orderBy(at, "_rk").select("row.*")


def _first(df: DataFrame) -> DataFrame:
    return df.withColumn("_no", F.lit(0).cast("bigint"))


def _numbered(df: DataFrame, often: DataFrame, *order: str) -> DataFrame:
    """`df` with the number of each row among those of its key, from 0; only keys in `often` have several rows."""
    several = df.join(often, "_rk", "left_semi").withColumn("_m", F.monotonically_increasing_id())
    placed, _ = running_sums(several, ["_rk"], [*order, "_m"], {"_no": F.lit(1).cast("bigint")})
    return _first(df.join(often, "_rk", "left_anti")).unionByName(placed.drop("_m"))
