"""Exact, seeded, stratified draws and splits.

Rows are put in the order of md5(seed:id), so the k smallest of a stratum are
a random draw of exactly k that depends on the seed and the ids alone, not on
partitions, retries or engine. A larger draw with the same seed contains every
smaller one; a `salt` makes draws independent.

No stratum is ever gathered or sorted. Counts per (stratum, key prefix) locate
the prefix in which the k-th key lies; the rows of that one prefix give the
k-th key itself, the cut; a prefix still too large to rank is refined by
further digits first. These steps run when a draw is built and leave one small
row per stratum. What is returned is a filter `key <= cut` over the table: a
plan without a shuffle that can be used any number of times.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlab.constants import DEFAULT_SEED
from cohortlab.functions.numeric import half_even
from cohortlab.functions.predicates import col, definite
from cohortlab.operators.least_rows import COUNT, ORDER, RANK, least_rows
from cohortlab.staging import small_table

# Most keys ranked by one task.
RANK_ROWS = 1_000_000
# Rows of all samples together up to which composed draws keep the least rows in one scan.
AT_ONCE_ROWS = 20_000
_DIGITS = 2
_KEY = "_draw_key"
_MD5_LENGTH = 32
# Sorts after every md5 text: a cut that takes the whole stratum.
_PAST_ALL = "g"


def draw_key(id_cols: list[str], seed: int | Column, salt: str | None = None) -> Column:
    """The text whose order is the draw order."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    parts = [seed.cast("string")] + ([F.lit(salt)] if salt else []) + [col(c).cast("string") for c in id_cols]
    return F.md5(F.concat_ws(":", *parts))


# ---------------------------------------------------------------- allocation


def stratum_counts(df: DataFrame, stratum: str, by: list[str] | None = None) -> DataFrame:
    """(*by, stratum, n) with missing strata left out."""
    return df.filter(col(stratum).isNotNull()).groupBy(*map(col, by or []), col(stratum)).agg(F.count("*").alias("n"))


def rounded_allocation(counts: DataFrame, size: int | Column, stratum: str, by: list[str] | None = None) -> DataFrame:
    """(*by, stratum, k): `size` spread in proportion, rounded half-even.

    The rounding drift goes in whole to the largest share (ties: larger count,
    then stratum), which it may push below zero; such a stratum draws nothing.
    Windows run over one row per stratum.
    """
    size = size if isinstance(size, Column) else F.lit(size)
    group = Window.partitionBy(*map(col, by or []))
    largest = group.orderBy(F.desc("k"), F.desc("n"), col(stratum))
    rounded = counts.withColumn("k", half_even(F.col("n") / F.sum("n").over(group) * size).cast("bigint"))
    drift = size - F.sum("k").over(group)
    k = F.col("k") + F.when(F.row_number().over(largest) == 1, drift).otherwise(0)
    return rounded.select(*map(col, by or []), col(stratum), k.cast("bigint").alias("k"))


def largest_remainder_allocation(
    counts: DataFrame, size: int | Column, stratum: str, by: list[str] | None = None
) -> DataFrame:
    """(*by, stratum, k): floors of the exact shares, the rest to the largest
    fractions (ties by stratum). Always sums to `size`."""
    size = size if isinstance(size, Column) else F.lit(size)
    group = Window.partitionBy(*map(col, by or []))
    exact = counts.withColumn("_exact", F.col("n") / F.sum("n").over(group) * size)
    floored = exact.withColumn("k", F.floor("_exact")).withColumn("_left", size - F.sum(F.floor("_exact")).over(group))
    order = group.orderBy(F.desc(F.col("_exact") - F.col("k")), col(stratum))
    k = F.col("k") + (F.row_number().over(order) <= F.col("_left")).cast("int")
    return floored.select(*map(col, by or []), col(stratum), k.cast("bigint").alias("k"))


def capacity_report(allocation: DataFrame, pool_counts: DataFrame, strata: list[str]) -> DataFrame:
    """(*strata, requested, available, shortfall) for strata that cannot be filled."""
    joined = allocation.filter(F.col("k") > 0).join(pool_counts, strata, "left")
    available = F.coalesce(F.col("n"), F.lit(0).cast("bigint"))
    report = joined.select(*map(col, strata), F.col("k").alias("requested"), available.alias("available"))
    return report.withColumn("shortfall", F.col("requested") - F.col("available")).filter("shortfall > 0")


# ---------------------------------------------------------------------- draw


@dataclass(frozen=True)
class KeyCounts:
    """Rows per (stratum, key prefix): (*strata, _prefix, n, _rankable)."""

    table: DataFrame
    rows: pa.Table | None

    def by(self, *columns: str) -> DataFrame:
        """(*columns, n): the same counts by stratum columns only."""
        return self.table.groupBy(*map(col, columns)).agg(F.sum("n").alias("n"))


def _count_keys(
    keyed: DataFrame, strata: list[str], id_cols: list[str], width: int, rank_rows: int, finer: bool = False
) -> KeyCounts:
    """`finer` counts also tell prefixes of a single id, however often copied,
    which need no ranking and would never become small."""
    rankable = F.count("*") <= rank_rows
    if finer:
        id_hash = F.xxhash64(*map(col, id_cols))
        rankable = rankable | (F.min(id_hash) == F.max(id_hash))
    return KeyCounts(*small_table(keyed.groupBy(*map(col, strata), F.substring(_KEY, 1, width).alias("_prefix")).agg(
        F.count("*").alias("n"), rankable.alias("_rankable")
    )))


def count_keys(
    pool: DataFrame, strata: list[str], id_cols: str | list[str], seed: int | Column = DEFAULT_SEED,
    salt: str | None = None, rank_rows: int = RANK_ROWS,
) -> KeyCounts:
    """The counts a draw starts from. Made beforehand, they also give the
    stratum counts that an allocation needs, which saves a scan."""
    ids = _listed(id_cols)
    return _count_keys(pool.withColumn(_KEY, draw_key(ids, seed, salt)), strata, ids, _DIGITS, rank_rows)


def _listed(id_cols: str | list[str]) -> list[str]:
    return [id_cols] if isinstance(id_cols, str) else id_cols


def _check_names(columns: list[str]) -> None:
    taken = {"n", "k"} & set(columns)
    if taken:
        raise ValueError(f"counts and allocations use the names n and k; rename {sorted(taken)}")


def _boundary(counts: DataFrame, needs: DataFrame, strata: list[str]) -> DataFrame:
    """One row per stratum: its size, the prefix in which the draw ends, and
    how many keys of that prefix are wanted. A stratum's window holds one row
    per prefix counted: 256, or 65,536 after a refinement."""
    whole = Window.partitionBy(*map(col, strata))
    n = F.coalesce("n", F.lit(0))
    placed = needs.join(counts, strata, "left").withColumn("_upto", F.sum(n).over(whole.orderBy("_prefix")))
    placed = placed.withColumn("_rows", F.sum(n).over(whole)).withColumn("_ends", F.least("_need", "_rows"))
    here = (F.col("_rows") == 0) | ((F.col("_ends") <= F.col("_upto")) & (F.col("_ends") > F.col("_upto") - F.col("n")))
    return placed.filter(here).select(
        *map(col, strata), "_need", "_rows", "_prefix", (F.col("_need") - F.col("_upto") + F.col("n")).alias("_rest"),
        "n", "_rankable",
    )


def _further_digits(rows: int, rank_rows: int) -> int:
    """Digits that bring so many evenly spread keys down to the rank limit, at
    most four: 65,536 counts per stratum."""
    return min(4, max(1, math.ceil(math.log(rows / rank_rows, 16))))


def _cut_keys(near: DataFrame, strata: list[str], id_cols: list[str]) -> DataFrame:
    """(*strata, _cut_key, _cut_0.., _spare): the `_rest`-th key, and its id,
    among rows of the boundary prefixes. Copies of an id are counted, not
    sorted; some of the last id are spare if the draw ends among them."""
    named = [col(c).alias(f"_cut_{i}") for i, c in enumerate(id_cols)]
    cut_id = [f"_cut_{i}" for i in range(len(id_cols))]
    ids = near.select(*map(col, strata), F.col(_KEY).alias("_cut_key"), *named, "_rest") \
        .groupBy(*map(col, strata), "_cut_key", *cut_id, "_rest").agg(F.count("*").alias("_copies"))
    order = Window.partitionBy(*map(col, strata)).orderBy("_cut_key", *cut_id)
    ranked = ids.withColumn("_upto", F.sum("_copies").over(order))
    last = (F.col("_rest") <= F.col("_upto")) & (F.col("_rest") > F.col("_upto") - F.col("_copies"))
    spare = (F.col("_upto") - F.col("_rest")).alias("_spare")
    return ranked.filter(last).select(*map(col, strata), "_cut_key", *cut_id, spare)


def _complain(cuts: DataFrame, rows: pa.Table | None, condition: str, text: str, show: list[str]) -> None:
    """Raise if rows of the cut table meet the condition. No job runs for a
    table without any, if its rows are at hand."""
    column = condition.split()[0]
    if rows is not None and not any(rows[column].to_pylist()):
        return
    found = cuts.filter(condition).select(*map(col, show)).limit(20).collect()
    if found:
        raise ValueError(f"{text}: {[r.asDict() for r in found]}")


def _find_cuts(
    keyed: DataFrame, needs: DataFrame, counts: KeyCounts, strata: list[str], id_cols: list[str],
    rank_rows: int, strict: bool,
) -> DataFrame:
    """(*strata, _cut_key, _cut_0..) of every stratum that gives rows."""
    bounded = counts.rows is not None
    boundary = _boundary(counts.table, needs, strata)
    fits = bounded and all(counts.rows["_rankable"].to_pylist())
    if not fits:
        boundary, _ = small_table(boundary)
    ends = [*map(col, strata), "_prefix", "_rest", "n", "_rankable"]
    open_ends = boundary.filter("_need < _rows").select(*ends)
    width = _DIGITS

    def at_boundary() -> DataFrame:
        # At most one row per stratum, so the checked counts bound these too.
        at = open_ends.select(*map(col, strata), "_prefix", "_rest")
        inside = keyed.join(F.broadcast(at) if bounded else at, strata)
        return inside.filter(F.substring(_KEY, 1, width) == F.col("_prefix"))

    while not fits and width < _MD5_LENGTH:
        largest = open_ends.filter(~F.col("_rankable")).agg(F.max("n")).first()[0]
        if largest is None:
            break
        inside = at_boundary().select(keyed.columns)
        width = min(width + _further_digits(largest, rank_rows), _MD5_LENGTH)
        finer = _count_keys(inside, strata, id_cols, width, rank_rows, finer=True)
        rest = open_ends.select(*map(col, strata), F.col("_rest").alias("_need"))
        open_ends, _ = small_table(_boundary(finer.table, rest, strata).select(*ends))
    nothing = F.lit(0).cast("bigint")
    # Strata without any row matter to the strict check only.
    closed = boundary.filter("_need >= _rows" if strict else "_need >= _rows AND _rows > 0").select(
        *map(col, strata), F.when(F.col("_rows") > 0, F.lit(_PAST_ALL)).alias("_cut_key"), nothing.alias("_spare"),
        (F.col("_need") - F.col("_rows")).alias("_short"),
    )
    inner = _cut_keys(at_boundary(), strata, id_cols).withColumn("_short", nothing)
    cuts, rows = small_table(inner.unionByName(closed, allowMissingColumns=True), bounded=bounded and not strict)
    _complain(cuts, rows, "_spare > 0", "a draw ends among copies of one id; name columns that make rows unique", strata)
    if strict:
        _complain(cuts, rows, "_short > 0", "strata too small for the draw", [*strata, "_short"])
    return cuts.drop("_spare", "_short")


def _flagged(
    pool: DataFrame, allocation: DataFrame, strata: list[str], id_cols: list[str], seed: int | Column,
    salt: str | None, strict: bool, rank_rows: int, counts: KeyCounts | None, how: str,
) -> DataFrame:
    _check_names([*strata, *id_cols])
    keyed = pool.withColumn(_KEY, draw_key(id_cols, seed, salt))
    narrow = keyed.select(*map(col, dict.fromkeys([*strata, *id_cols])), _KEY)
    counts = counts or _count_keys(narrow, strata, id_cols, _DIGITS, rank_rows)
    needs = allocation.filter(F.col("k") > 0).select(*map(col, strata), F.col("k").alias("_need"))
    cuts = _find_cuts(narrow, needs, counts, strata, id_cols, rank_rows, strict)
    this_id = F.struct(*map(col, id_cols))
    cut_id = [f"_cut_{i}" for i in range(len(id_cols))]
    last_id = F.struct(*[F.col(cut).alias(c) for cut, c in zip(cut_id, id_cols)])
    taken = (F.col(_KEY) < F.col("_cut_key")) | ((F.col(_KEY) == F.col("_cut_key")) & (this_id <= last_id))
    return keyed.join(cuts, strata, how).withColumn("_taken", definite(taken)).drop("_cut_key", *cut_id)


def draw(
    pool: DataFrame,
    allocation: DataFrame,
    strata: list[str],
    id_cols: str | list[str],
    seed: int | Column = DEFAULT_SEED,
    salt: str | None = None,
    strict: bool = False,
    rank_rows: int = RANK_ROWS,
    counts: KeyCounts | None = None,
) -> DataFrame:
    """Exactly k rows of every stratum of `allocation` (*strata, k).

    k <= 0 draws nothing. A stratum with fewer than k rows is taken whole, or
    raises with `strict`. `id_cols` must identify rows; a draw that ends among
    copies of an id raises. The pool is scanned more than once: pass a staged
    table if it is costly to compute. `counts` are those of `count_keys` for
    the same strata, ids, seed and salt; they may hold further strata.
    """
    allocation, _ = small_table(allocation)
    return _drawn(pool, allocation, strata, id_cols, seed, salt, strict, rank_rows, counts)


def _drawn(
    pool: DataFrame, allocation: DataFrame, strata: list[str], id_cols: str | list[str], seed: int | Column,
    salt: str | None, strict: bool, rank_rows: int, counts: KeyCounts | None,
) -> DataFrame:
    flagged = _flagged(pool, allocation, strata, _listed(id_cols), seed, salt, strict, rank_rows, counts, "inner")
    return flagged.filter("_taken").select(*map(col, pool.columns))


def draw_at_once(
    pool: DataFrame, allocation: DataFrame, strata: list[str], id_cols: str | list[str], seed: int = DEFAULT_SEED,
    salt: str | None = None, strict: bool = False, at_once_rows: int = AT_ONCE_ROWS,
) -> DataFrame:
    """The rows of `draw`, from one scan of the pool, if all k together are at most `at_once_rows`; beyond that, `draw` itself.

    Each task keeps the least rows per stratum, so `at_once_rows` is what a task must be able to hold. Drawn rows are staged.
    """
    allocation, rows = small_table(allocation)
    ids = _listed(id_cols)
    wanted = None if rows is None else [k for k in rows["k"].to_pylist() if k and k > 0]
    if wanted is None or sum(wanted) > at_once_rows:
        return _drawn(pool, allocation, strata, id_cols, seed, salt, strict, RANK_ROWS, None)
    _check_names([*strata, *ids])
    inside = pool.join(F.broadcast(allocation.filter("k > 0").select(*map(col, strata))), strata, "left_semi")
    candidates, counts = least_rows(inside, strata, ids, [draw_key(ids, seed, salt)], [max(wanted, default=0) + 1])
    taken = _settle(candidates, counts, allocation.withColumn(ORDER, F.lit(0)), strata, ids, strict)
    return taken.select(*map(col, pool.columns))


def _settle(candidates: DataFrame, counts: DataFrame, allocation: DataFrame, strata: list[str], ids: list[str], strict: bool) -> DataFrame:
    """The first k candidates of each order and stratum; raises as `draw` does. `allocation` is a table checked to be small."""
    # Candidates are staged and few, so they are read again rather than written again.
    needs = allocation.filter(F.col("k") > 0).select(ORDER, *map(col, strata), "k")
    placed = candidates.join(F.broadcast(needs), [ORDER, *strata]).filter(F.col(RANK) <= F.col("k") + 1)
    ends = placed.filter(F.col(RANK) >= F.col("k")).groupBy(ORDER, *map(col, strata)).agg(
        F.count("*").alias("_ends"), F.count_distinct(F.struct(*map(col, ids))).alias("_ids"))
    _complain(ends, None, "_ends > _ids", "a draw ends among copies of one id; name columns that make rows unique", strata)
    if strict:
        sizes = needs.join(counts, strata, "left").withColumn("_short", F.col("k") - F.coalesce(COUNT, F.lit(0)))
        _complain(sizes, None, "_short > 0", "strata too small for the draw", [*strata, "_short"])
    return placed.filter(F.col(RANK) <= F.col("k"))


def two_way_split(
    df: DataFrame,
    size: int,
    stratum: str,
    id_cols: str | list[str],
    seed: int = DEFAULT_SEED,
    salt: str | None = None,
    names: tuple[str, str] = ("train", "test"),
    name: str = "split",
    rank_rows: int = RANK_ROWS,
) -> DataFrame:
    """Add a column that puts `size` rows in the first part and the rest in the
    second, each with the same mix of strata (largest remainder).

    Raises as a stratified split must: when a part would be empty or smaller
    than the number of strata, or a stratum has a single row. Rows without a
    stratum are not counted and go to the second part.
    """
    counts = count_keys(df, [stratum], id_cols, seed, salt, rank_rows)
    sizes = counts.by(stratum).filter(col(stratum).isNotNull())
    total, strata, least = sizes.agg(F.sum("n"), F.count("*"), F.min("n")).first()
    total = total or 0
    if not 0 < size < total:
        raise ValueError(f"cannot put {size} of {total} rows in one part and leave some for the other")
    if least < 2:
        raise ValueError("a stratum has only one row")
    if min(size, total - size) < strata:
        raise ValueError(f"each part needs at least one row per stratum ({strata})")
    allocation = largest_remainder_allocation(sizes, size, stratum)
    flagged = _flagged(df, allocation, [stratum], _listed(id_cols), seed, salt, False, rank_rows, counts, "left")
    part = F.when(F.col("_taken"), F.lit(names[0])).otherwise(F.lit(names[1]))
    return flagged.withColumn(name, part).select(*map(col, df.columns), col(name))


def stratified_sample(
    df: DataFrame, size: int, stratum: str, id_cols: str | list[str], seed: int = DEFAULT_SEED, salt: str | None = None
) -> DataFrame:
    """`size` rows with the mix of strata kept: the first part of `two_way_split`."""
    parts = two_way_split(df, size, stratum, id_cols, seed, salt, name="_part")
    return parts.filter(F.col("_part") == "train").drop("_part")


def simple_sample(df: DataFrame, size: int, id_cols: str | list[str], seed: int = DEFAULT_SEED) -> DataFrame:
    """Exactly `size` rows (all, if there are fewer), in the same order as `draw`.

    The draw over a single stratum, whatever the size: copies of an id are
    taken together, and a sample that would have to end among them raises.
    """
    ids = _listed(id_cols)
    # One stratum for all rows. A plain constant would be folded out of the join
    # with the cut and leave a nested loop, so it is the length of the key.
    pool = df.withColumn("_all", F.length(draw_key(ids, seed)))
    allocation = df.sparkSession.createDataFrame([(_MD5_LENGTH, size)], "_all int, k bigint")
    return draw(pool, allocation, ["_all"], ids, seed).drop("_all")


# ----------------------------------------------------------- composed draws


def matched_negatives(
    df: DataFrame, sizes: Mapping[str, int], split: str, label: str, stratum: str, id_col: str,
    seed: int = DEFAULT_SEED, strict: bool = False, keep: Mapping[str, str] | None = None,
) -> DataFrame:
    """(split, id): all positives, and per split `sizes[split]` negatives drawn
    inside that split to match its own positives' mix of strata.

    `keep` maps names of further columns to those of `df`. `label` holds `pos` / `neg`. Output splits are named `{split}_{label}`.
    """
    inside = df.filter(col(split).isin(list(sizes)))
    counts = count_keys(inside, [split, label, stratum], id_col, seed)
    positive = counts.by(split, label, stratum).filter((col(label) == "pos") & col(stratum).isNotNull())
    size = F.coalesce(*[F.when(col(split) == name, F.lit(n)) for name, n in sizes.items()])
    allocation = rounded_allocation(positive, size, stratum, [split]).withColumn(label, F.lit("neg"))
    pool = inside.filter(col(label) == "neg")
    negative = _drawn(pool, allocation, [split, label, stratum], id_col, seed, None, strict, RANK_ROWS, counts)

    def named(rows: DataFrame) -> DataFrame:
        more = [col(c).alias(name) for name, c in (keep or {}).items()]
        return rows.select(F.concat(col(split), F.lit("_"), col(label)).alias("split"), col(id_col).alias("id"), *more)

    return named(inside.filter(col(label) == "pos")).unionByName(named(negative))


def ratio_subsamples(
    df: DataFrame, specs: list[tuple[str, int, int]], label: str, stratum: str, id_col: str, strict: bool = False,
    at_once_rows: int = AT_ONCE_ROWS,
) -> DataFrame:
    """(split, id): one subsample per (name, size, seed) in `specs`, all in one job.

    Each keeps the pool's pos:neg ratio (half-even) and, within each class, the
    class's own mix of strata. Output splits are named `{name}_{label}`.

    If the samples have at most `at_once_rows` rows together, the pool is read
    once: counts and the least rows of every sample come from the same scan.
    """
    spec = F.array(*[
        F.struct(F.lit(name).alias("_name"), F.lit(size).alias("_size"), F.lit(seed).alias("_seed"))
        for name, size, seed in specs
    ])
    if 0 < sum(size for _, size, _ in specs) <= at_once_rows:
        return _subsamples_at_once(df, specs, spec, label, stratum, id_col, strict)
    pool = df.select(col(id_col), col(label), col(stratum), F.inline(spec))
    strata = ["_name", label, stratum]
    counts = count_keys(pool, strata, id_col, F.col("_seed"))
    named = df.sparkSession.range(1).select(F.inline(spec)).drop("_seed")
    sizes = counts.by(*strata).join(F.broadcast(named), "_name")
    allocation = _ratio_allocation(sizes, label, stratum)
    drawn = _drawn(pool, allocation, strata, id_col, F.col("_seed"), None, strict, RANK_ROWS, counts)
    return drawn.select(F.concat("_name", F.lit("_"), col(label)).alias("split"), col(id_col).alias("id"))


def _ratio_allocation(sizes: DataFrame, label: str, stratum: str) -> DataFrame:
    """(_name, label, stratum, k) from (_name, _size, label, stratum, n)."""
    classes = Window.partitionBy("_name")
    is_pos = col(label) == "pos"
    positive, everything = F.sum(F.when(is_pos, F.col("n"))).over(classes), F.sum("n").over(classes)
    # The negative side is what the positive side leaves.
    part = half_even(F.col("_size") * F.coalesce(positive, F.lit(0)) / everything).cast("bigint")
    sizes = sizes.withColumn("_part", F.when(is_pos, part).otherwise(F.col("_size") - part))
    return rounded_allocation(sizes.filter(col(stratum).isNotNull()), F.col("_part"), stratum, ["_name", label])


def _subsamples_at_once(
    df: DataFrame, specs: list[tuple[str, int, int]], spec: Column, label: str, stratum: str, id_col: str, strict: bool
) -> DataFrame:
    """One scan for the counts and the candidates of all samples.

    A share never has more rows than its sample, but for the rounding drift, which is less than the number of strata; a drift that large
    would need more candidates than were kept, and goes by `draw`.
    """
    pool = df.select(col(id_col), col(label), col(stratum))
    room = [size + 100 for _, size, _ in specs]
    candidates, counts = least_rows(pool, [label, stratum], [id_col], [draw_key([id_col], seed) for _, _, seed in specs], room)
    counts = small_table(counts)[0]
    named = F.broadcast(df.sparkSession.range(1).select(F.posexplode(spec).alias(ORDER, "x")).select(ORDER, "x._name", "x._size"))
    every = counts.select(col(label), col(stratum), F.col(COUNT).alias("n"), F.explode(F.array(*[F.lit(i) for i in range(len(specs))])).alias(ORDER))
    allocation = _ratio_allocation(every.join(named, ORDER), label, stratum).join(named.select(ORDER, "_name"), "_name")
    allocation, rows = small_table(allocation.select(ORDER, col(label), col(stratum), "k"))
    if rows is None or any(k >= room[i] for i, k in zip(rows[ORDER].to_pylist(), rows["k"].to_pylist())):
        return ratio_subsamples(df, specs, label, stratum, id_col, strict, 0)
    taken = _settle(candidates, counts, allocation, [label, stratum], [id_col], strict)
    return taken.join(named, ORDER).select(F.concat("_name", F.lit("_"), col(label)).alias("split"), col(id_col).alias("id"))
