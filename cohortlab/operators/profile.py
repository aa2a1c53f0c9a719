"""Dataset profiles: completeness, counts, prevalence, summaries, bins.

Reports over many columns or conditions are ONE aggregation over the table
followed by an unpivot of its single row, so the table is read once however
many columns there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlab.constants import AGE_EDGES, AGE_LABELS
from cohortlab.functions.numeric import half_even, nan_to_null, percentage, to_number
from cohortlab.functions.predicates import all_above_zero, any_at_least_one, col, positive_count
from cohortlab.functions.text import non_blank, percent_bar, split_label, split_stem
from cohortlab.operators.order_stats import exact_quantiles, probe, with_bucket


def _one_row_to_long(row: DataFrame, entries: list[dict[str, Column]]) -> DataFrame:
    """Turn the single row of an aggregation into one row per entry."""
    return row.select(F.inline(F.array(*[F.struct(*[c.alias(k) for k, c in e.items()]) for e in entries])))


def _masked_report(df: DataFrame, masks: dict[str, Column], members: dict[str, list[str]], name: str) -> DataFrame:
    """Count, percentage of all rows and member means for every mask, in one pass."""
    aggregates, entries = [F.count("*").alias("_total")], []
    for i, (label, mask) in enumerate(masks.items()):
        aggregates.append(F.count_if(mask).alias(f"_n{i}"))
        for j, member in enumerate(members[label]):
            aggregates.append(F.avg(F.when(mask, col(member))).alias(f"_m{i}_{j}"))
            entries.append({
                name: F.lit(label), "member": F.lit(member), "n": F.col(f"_n{i}"), "total": F.col("_total"),
                "pct": percentage(F.col(f"_n{i}"), F.col("_total")), "mean_value": F.col(f"_m{i}_{j}"),
            })
    return _one_row_to_long(df.agg(*aggregates), entries)


def completeness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n): how many rows have a value, for every column."""
    columns = columns or df.columns
    row = df.agg(*[F.count(col(c)).alias(f"_n{i}") for i, c in enumerate(columns)])
    return _one_row_to_long(row, [{"column": F.lit(c), "n": F.col(f"_n{i}")} for i, c in enumerate(columns)])


def completeness_where_text(df: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """(column, n, n_rows) over the rows whose `text` is not blank."""
    columns = columns or df.columns
    noted = df.filter(non_blank(col(text)))
    row = noted.agg(F.count("*").alias("_rows"), *[F.count(col(c)).alias(f"_n{i}") for i, c in enumerate(columns)])
    return _one_row_to_long(row, [
        {"column": F.lit(c), "n": F.col(f"_n{i}"), "n_rows": F.col("_rows")} for i, c in enumerate(columns)
    ])


def count_where(df: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """One row: the row count and how many rows meet each condition."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(m).alias(name) for name, m in masks.items()])


def value_counts(df: DataFrame, column: str, keep_missing: bool = True) -> DataFrame:
    """(column, n), most frequent first and ties by value; NULL is a value if kept."""
    rows = df if keep_missing else df.filter(col(column).isNotNull())
    return rows.groupBy(col(column)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col(column).asc_nulls_first())


def value_shares(df: DataFrame, column: str, keep_missing: bool = False) -> DataFrame:
    """(column, n, share): the counts and their part of all counted rows.

    The total is a scalar subquery over the same counts, so no window has to
    bring a long list of values into one task.
    """
    rows = df if keep_missing else df.filter(col(column).isNotNull())
    counts = rows.groupBy(col(column)).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def value_percentages(df: DataFrame, column: str, digits: int = 2) -> DataFrame:
    """(column, n, pct): counts with missing kept, percentages rounded half-even."""
    shares = value_shares(df, column, keep_missing=True)
    return shares.select(col(column), "n", half_even(F.col("share") * 100, digits).alias("pct"))


def value_percentages_of(df: DataFrame, columns: dict[str, str], digits: int = 2) -> DataFrame:
    """(name, value, n, pct) for several text columns in one scan, missing kept.

    Every row counts once per column, so one row count serves all columns.
    """
    cells = F.array(*[
        F.struct(F.lit(name).alias("name"), col(c).cast("string").alias("value")) for name, c in columns.items()
    ])
    counts = df.select(F.inline(cells)).groupBy("name", "value").agg(F.count("*").alias("n"))
    total = (counts.agg(F.sum("n")).scalar() / len(columns)).cast("bigint")
    return counts.withColumn("pct", half_even(F.col("n") / total * 100, digits))


def grouped_mean_median(df: DataFrame, group: str, measures: list[str]) -> DataFrame:
    """{measure}_mean and {measure}_median per group; a missing group is a group.

    Medians come from `exact_quantiles`, which never brings raw rows of a group
    into one task.
    """
    means = [F.avg(col(m)).alias(f"{m}_mean") for m in measures]
    ordered = [c for m in measures for c in (f"{m}_mean", f"{m}_median")]
    found = probe(df, measures, [group])
    averages = df.groupBy(col(group)).agg(*means)
    quantiles = exact_quantiles(df, measures, [0.5], by=[group], found=found)
    medians = quantiles.groupBy(col(group).alias("_group")).agg(*[
        F.max(F.when(F.col("measure") == m, F.col("value"))).alias(f"{m}_median") for m in measures
    ])
    joined = averages.join(medians, col(group).eqNullSafe(F.col("_group")), "left")
    return joined.select(col(group), *map(col, ordered))


def cooccurrence(df: DataFrame, combinations: dict[str, list[str]]) -> DataFrame:
    """(combination, member, n, total, pct, mean_value) per combination and member.

    n counts rows in which every member column is > 0; the mean is over those
    rows, NULL if there are none.
    """
    masks = {name: all_above_zero(cols) for name, cols in combinations.items()}
    return _masked_report(df, masks, combinations, "combination")


def prevalence(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, total, pct, mean_value): rows >= 1 and the mean over them."""
    masks = {c: positive_count(c) for c in columns}
    return _masked_report(df, masks, {c: [c] for c in columns}, "column").drop("member")


def any_prevalence(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (n, total, pct): rows with at least one column >= 1."""
    row = df.agg(F.count_if(any_at_least_one(columns)).alias("n"), F.count("*").alias("total"))
    return row.withColumn("pct", percentage(F.col("n"), F.col("total")))


def coerced(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    """One column: `column` as a number, missing where it cannot be read as one."""
    is_text = df.schema[column].dataType.simpleString() == "string"
    value = to_number(col(column)) if is_text else nan_to_null(col(column))
    return df.select(value.alias(name))


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: total, valid, missing, min, max, mean, median, sample deviation."""
    values = coerced(df, column)
    basics = [
        F.count("*").alias("total"), F.count("value").alias("valid"),
        (F.count("*") - F.count("value")).alias("missing"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
    ]
    spread = F.stddev_samp("value").alias("std")
    found = probe(values, ["value"])
    median = exact_quantiles(values, ["value"], [0.5], found=found).select("value").scalar()
    return values.agg(*basics, spread).withColumn("median", median)


def describe(df: DataFrame, column: str) -> DataFrame:
    """(statistic, value): count, mean, std, min, quartiles (interpolated), max."""
    values = coerced(df, column)
    aggregates = [
        F.count("value").cast("double").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
    ]
    quartiles = {"25%": 0.25, "50%": 0.5, "75%": 0.75}
    found = probe(values, ["value"])
    exact = exact_quantiles(values, ["value"], list(quartiles.values()), found=found)
    by_p = exact.agg(F.map_from_entries(F.collect_list(F.struct("p", "value")))).scalar()
    row = values.agg(*aggregates).withColumn("_q", by_p)
    row = row.select("*", *[F.try_element_at("_q", F.lit(p)).alias(q) for q, p in quartiles.items()])
    order = ["count", "mean", "std", "min", *quartiles, "max"]
    return _one_row_to_long(row, [{"statistic": F.lit(s), "value": col(s)} for s in order])


def _zero_filled(bins: DataFrame, counts: DataFrame, on: str) -> DataFrame:
    """All bins, with 0 where nothing was counted.

    `counts` has at most one row per bin, which bounds the broadcast.
    """
    return bins.join(F.broadcast(counts), on, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def binned_distribution(
    df: DataFrame, column: str, edges: list[float] = AGE_EDGES, labels: list[str] = AGE_LABELS
) -> DataFrame:
    """(bin_ix, label, n, pct, bar) in bin order, empty brackets included.

    Percentages are of all valid values, also those outside every bracket. All
    brackets are counted in one aggregation, so an empty one is a zero.
    """
    placed = with_bucket(coerced(df, column), "value", edges, "bracket")
    counts = [F.count_if(F.col("bracket") == i + 1).alias(f"_n{i}") for i in range(len(labels))]
    row = placed.agg(F.count("bracket").alias("_valid"), *counts)
    entries = []
    for i, label in enumerate(labels):
        n, pct = F.col(f"_n{i}"), percentage(F.col(f"_n{i}"), F.col("_valid"))
        entries.append({"bin_ix": F.lit(i), "label": F.lit(label), "n": n, "pct": pct, "bar": percent_bar(pct)})
    return _one_row_to_long(row, entries)


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin_ix, lower, upper, n): equal-width bins from min to max, the last closed.

    A constant column is given a width of one around its value. An index is
    set right by one where rounding put the value across its bin's edge.
    """
    values = coerced(df, column).filter(F.col("value").isNotNull())
    ends = values.agg(F.min("value").alias("low"), F.max("value").alias("high"))
    flat = F.col("low") == F.col("high")
    ends = ends.select(
        F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
    ).select(F.struct("low", "high", ((F.col("high") - F.col("low")) / bins).alias("width")).alias("ends"))

    def edge(index: Column) -> Column:
        inner = F.col("ends.low") + index * F.col("ends.width")
        return F.when(index == bins, F.col("ends.high")).otherwise(inner)

    rough = F.least(
        F.floor((F.col("value") - F.col("ends.low")) * bins / (F.col("ends.high") - F.col("ends.low"))),
        F.lit(bins - 1).cast("bigint"),
    )
    index = F.col("rough")
    fixed = (
        F.when(F.col("value") < edge(index), index - 1)
        .when((F.col("value") >= edge(index + 1)) & (index != bins - 1), index + 1)
        .otherwise(index)
    )
    placed = values.withColumn("ends", ends.scalar()).withColumn("rough", rough)
    counts = placed.groupBy(fixed.alias("bin_ix")).agg(F.count("*").alias("n"))
    index_rows = df.sparkSession.range(bins).select(F.col("id").alias("bin_ix"))
    filled = _zero_filled(index_rows, counts, "bin_ix").withColumn("ends", ends.scalar())
    edges = [edge(F.col("bin_ix")).alias("lower"), edge(F.col("bin_ix") + 1).alias("upper")]
    return filled.select("bin_ix", *edges, "n").orderBy("bin_ix")


def label_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(finding, n_negative, n_positive, n_uncertain, n_valid, n_rows) per column."""
    aggregates, entries = [F.count("*").alias("_rows")], []
    for i, c in enumerate(columns):
        for state, value in (("neg", 0), ("pos", 1), ("unc", -1)):
            aggregates.append(F.count_if(col(c) == value).alias(f"_{state}{i}"))
        negative, positive = F.col(f"_neg{i}"), F.col(f"_pos{i}")
        entries.append({
            "finding": F.lit(c), "n_negative": negative, "n_positive": positive,
            "n_uncertain": F.col(f"_unc{i}"), "n_valid": negative + positive, "n_rows": F.col("_rows"),
        })
    return _one_row_to_long(df.agg(*aggregates), entries)


def label_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(finding, label, n): value counts of many label columns, missing dropped."""
    long = df.select([col(c) for c in columns]).unpivot([], columns, "finding", "label")
    return long.filter(F.col("label").isNotNull()).groupBy("finding", "label").agg(F.count("*").alias("n"))


def split_crosstab(df: DataFrame, splits: DataFrame, id_col: str, stratum: str, names: list[str]) -> DataFrame:
    """stratum x split counts, 0 where empty; rows without a stratum are left out.

    `splits` is (split, id). One column per name, counted in one aggregation;
    an id listed twice in a split counts once.
    """
    listed = splits.select("split", F.col("id").alias(id_col)).distinct()
    known = df.filter(col(stratum).isNotNull()).select(col(id_col), col(stratum))
    counts = [F.count_if(F.col("split") == n).alias(n) for n in names]
    return listed.join(known, id_col).groupBy(col(stratum)).agg(*counts)


def preview(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first n rows in the given order."""
    return df.orderBy(*map(col, order)).limit(n)


def stem_crosstab(df: DataFrame, splits: DataFrame, id_col: str, stratum: str) -> DataFrame:
    """(stratum, stem, label, n): the crosstab in long form, split names taken apart at their last underscore."""
    listed = splits.select("split", F.col("id").alias(id_col)).distinct()
    known = df.filter(col(stratum).isNotNull()).select(col(id_col), col(stratum))
    stem, label = split_stem(F.col("split")).alias("stem"), split_label(F.col("split")).alias("label")
    return listed.join(known, id_col).groupBy(col(stratum), stem, label).agg(F.count("*").alias("n"))
