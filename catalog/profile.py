"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.registry import AGES, ORGANS, SCANS, Tables, query
from cohortlab.constants import AGE_EDGES, AGE_LABELS
from cohortlab.functions.predicates import positive_count
from cohortlab.functions.resolve import ColumnIndex
from cohortlab.operators import profile
from cohortlab.operators.order_stats import exact_quantiles

_SCAN_COLUMNS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]
_ORGANS = ["n_pancreas", "n_liver", "n_kidney"]
_COMBINATIONS = {
    "liver + pancreas": ["n_liver", "n_pancreas"],
    "liver + kidney": ["n_liver", "n_kidney"],
    "pancreas + kidney": ["n_pancreas", "n_kidney"],
    "all three": ["n_liver", "n_pancreas", "n_kidney"],
}


def _each(template: str, columns: list[str]) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


@query(f"WITH {SCANS} " + _each("SELECT '{c}' AS \"column\", count({c}) AS n FROM scans", _SCAN_COLUMNS))
def q_completeness(t: Tables) -> DataFrame:
    return profile.completeness(t.scans("source", "n_chars"), _SCAN_COLUMNS)


@query(f"WITH {SCANS}, kept AS (SELECT * FROM scans WHERE toxic IS NOT NULL AND regexp_matches(text, '[^\\s]')) "
       + _each("SELECT '{c}' AS \"column\", count({c}) AS n, count(*) AS n_rows FROM kept", _SCAN_COLUMNS))
def q_completeness_filtered(t: Tables) -> DataFrame:
    """Whole texts, blank where there is no label."""
    noted = t.scans("source", "n_chars", "text").withColumn("note", F.when(F.col("toxic").isNotNull(), F.col("text")).otherwise(" "))
    return profile.completeness_where_text(noted, "note", _SCAN_COLUMNS)


@query(f"WITH {SCANS} SELECT quality::BIGINT AS quality, count(*) AS n FROM scans GROUP BY quality")
def q_value_counts(t: Tables) -> DataFrame:
    return profile.value_counts(t.scans(), "quality")


@query(f"""WITH {SCANS}
SELECT toxic::BIGINT AS toxic, count(*) AS n, round(count(*) / (SELECT count(toxic) FROM scans), 6) AS share
FROM scans WHERE toxic IS NOT NULL GROUP BY toxic""")
def q_value_proportions(t: Tables) -> DataFrame:
    return profile.value_shares(t.scans(), "toxic")


@query(f"""WITH {SCANS}
SELECT quality::BIGINT AS quality, count(*) AS n,
       round_even(count(*) / (SELECT count(*) FROM scans) * 100, 2) AS pct
FROM scans GROUP BY quality""")
def q_value_counts_pct(t: Tables) -> DataFrame:
    return profile.value_percentages(t.scans(), "quality")


@query("""
SELECT 'order' AS name, o_orderstatus AS value, count(*) AS n,
       round_even(count(*) / (SELECT count(*) FROM orders) * 100, 2) AS pct FROM orders GROUP BY o_orderstatus""")
def q_first_of_several_columns(t: Tables) -> DataFrame:
    """Of several columns that fit a search, the first in table order."""
    orders = t.orders.select("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    resolution = ColumnIndex(orders.columns).resolve({"order": "order attenuation"}, "t", first=True)
    return profile.value_percentages_of(orders, resolution.found)


@query("""
SELECT 'Status' AS name, o_orderstatus AS value, count(*) AS n,
       round_even(count(*) / (SELECT count(*) FROM orders) * 100, 2) AS pct FROM orders GROUP BY o_orderstatus
UNION ALL
SELECT 'Priority', o_orderpriority, count(*), round_even(count(*) / (SELECT count(*) FROM orders) * 100, 2)
FROM orders GROUP BY o_orderpriority""")
def q_resolved_value_counts(t: Tables) -> DataFrame:
    """Columns found by label and keyword where the exact name is not there."""
    orders = t.orders
    resolution = ColumnIndex(orders.columns).resolve({"Status": "o_orderstatus", "Priority": "order priority"}, "order")
    return profile.value_percentages_of(orders, resolution.found)


@query(f"""WITH {SCANS}
SELECT quality::BIGINT AS quality,
       round(avg(n_chars), 6) AS n_chars_mean, round(median(n_chars)::DOUBLE, 6) AS n_chars_median,
       round(avg(toxic), 6) AS toxic_mean, round(median(toxic)::DOUBLE, 6) AS toxic_median
FROM scans GROUP BY quality""")
def q_group_mean_median(t: Tables) -> DataFrame:
    return profile.grouped_mean_median(t.scans("n_chars"), "quality", ["n_chars", "toxic"])


@query("""
SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity_mean, round(median(l_quantity), 6) AS l_quantity_median,
       round(avg(l_extendedprice), 6) AS l_extendedprice_mean,
       round(median(l_extendedprice), 6) AS l_extendedprice_median
FROM lineitem GROUP BY l_returnflag""")
def q_group_measures(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_returnflag", "l_quantity", "l_extendedprice")
    return profile.grouped_mean_median(lines, "l_returnflag", ["l_quantity", "l_extendedprice"])


@query(_each("""
SELECT o_orderpriority, 'o_totalprice' AS measure, {c}::DOUBLE AS p,
       round(quantile_cont(o_totalprice, {c}), 6) AS value FROM orders GROUP BY o_orderpriority""", ["0.25", "0.5", "0.9"]))
def q_exact_quantiles(t: Tables) -> DataFrame:
    """The selection used where no task could hold a group's values."""
    orders = t.orders.select("o_orderpriority", "o_totalprice")
    return exact_quantiles(orders, ["o_totalprice"], [0.25, 0.5, 0.9], by=["o_orderpriority"], builtin=False)


def _combination_sql(name: str, members: list[str]) -> str:
    mask = " AND ".join(f"{m} > 0" for m in members)
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS combination, '{m}' AS member, count(*) FILTER (WHERE {mask}) AS n, count(*) AS total,
        round(count(*) FILTER (WHERE {mask}) / count(*) * 100, 6) AS pct,
        round(avg({m}) FILTER (WHERE {mask}), 6) AS mean_value FROM organs""" for m in members)


@query(f"WITH {ORGANS} " + " UNION ALL ".join(_combination_sql(n, m) for n, m in _COMBINATIONS.items()))
def q_cooccurrence(t: Tables) -> DataFrame:
    return profile.cooccurrence(t.organs(), _COMBINATIONS)


@query(f"WITH {ORGANS} " + _each(
    "SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} >= 1) AS n, count(*) AS total, "
    "round(count(*) FILTER (WHERE {c} >= 1) / count(*) * 100, 6) AS pct, "
    "round(avg({c}) FILTER (WHERE {c} >= 1), 6) AS mean_value FROM organs", _ORGANS))
def q_prevalence(t: Tables) -> DataFrame:
    return profile.prevalence(t.organs(), _ORGANS)


@query(f"""WITH {ORGANS}
SELECT count(*) FILTER (WHERE n_pancreas >= 1 OR n_liver >= 1 OR n_kidney >= 1) AS n, count(*) AS total,
       round(count(*) FILTER (WHERE n_pancreas >= 1 OR n_liver >= 1 OR n_kidney >= 1) / count(*) * 100, 6) AS pct
FROM organs""")
def q_any_of(t: Tables) -> DataFrame:
    return profile.any_prevalence(t.organs(), _ORGANS)


@query(f"""WITH {ORGANS}
SELECT count(*) AS n_rows, count(*) FILTER (WHERE n_pancreas >= 1) AS pancreas,
       count(*) FILTER (WHERE n_kidney >= 1) AS kidney FROM organs""")
def q_mask_counts(t: Tables) -> DataFrame:
    return profile.count_where(t.organs(), {"pancreas": positive_count("n_pancreas"), "kidney": positive_count("n_kidney")})


@query(f"""WITH {AGES}
SELECT count(*) AS total, count(value) AS valid, count(*) - count(value) AS missing,
       round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean,
       round(median(value), 6) AS median, round(stddev_samp(value), 6) AS std FROM num""")
def q_numeric_summary(t: Tables) -> DataFrame:
    return profile.numeric_summary(t.ages(), "age")


_STATISTICS = {
    "count": "count(o_totalprice)::DOUBLE", "mean": "avg(o_totalprice)", "std": "stddev_samp(o_totalprice)",
    "min": "min(o_totalprice)", "25%": "quantile_cont(o_totalprice, 0.25)", "50%": "quantile_cont(o_totalprice, 0.5)",
    "75%": "quantile_cont(o_totalprice, 0.75)", "max": "max(o_totalprice)",
}


@query(" UNION ALL ".join(
    f"SELECT '{s}' AS statistic, round({e}, 6) AS value FROM orders" for s, e in _STATISTICS.items()))
def q_describe(t: Tables) -> DataFrame:
    return profile.describe(t.orders, "o_totalprice")


_BRACKETS = ", ".join(
    f"({i}, '{label}', {low}, {high})" for i, (label, low, high) in enumerate(zip(AGE_LABELS, AGE_EDGES, AGE_EDGES[1:]))
)


@query(f"""WITH {AGES}, bins(bin_ix, label, lo, hi) AS (VALUES {_BRACKETS}),
valid AS (SELECT count(value) AS n_valid FROM num),
counted AS (
  SELECT b.bin_ix, b.label, count(n.value) AS n FROM bins b
  LEFT JOIN num n ON n.value >= b.lo AND n.value < b.hi GROUP BY b.bin_ix, b.label)
SELECT bin_ix::BIGINT AS bin_ix, label, n, round(n / n_valid * 100, 6) AS pct,
       repeat('█', floor(n / n_valid * 100 / 2)::BIGINT) AS bar FROM counted, valid""")
def q_binned_distribution(t: Tables) -> DataFrame:
    return profile.binned_distribution(t.ages(), "age")


@query("""WITH ends AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part),
w AS (SELECT lo, hi, (hi - lo) / 30 AS width FROM ends),
edges AS (
  SELECT i AS bin_ix, lo + i * width AS lower, CASE WHEN i = 29 THEN hi ELSE lo + (i + 1) * width END AS upper
  FROM w, range(30) r(i))
SELECT e.bin_ix, round(e.lower, 6) AS lower, round(e.upper, 6) AS upper, count(p.p_partkey) AS n
FROM edges e LEFT JOIN part p
  ON p.p_retailprice >= e.lower AND (p.p_retailprice < e.upper OR e.bin_ix = 29)
GROUP BY e.bin_ix, e.lower, e.upper""")
def q_histogram(t: Tables) -> DataFrame:
    return profile.histogram(t.part, "p_retailprice")


@query(f"WITH {SCANS}, states AS (SELECT coalesce(quality, -1) AS quality, toxic FROM scans) " + _each(
    "SELECT '{c}' AS finding, count(*) FILTER (WHERE {c} = 0) AS n_negative, "
    "count(*) FILTER (WHERE {c} = 1) AS n_positive, count(*) FILTER (WHERE {c} = -1) AS n_uncertain, "
    "count(*) FILTER (WHERE {c} IN (0, 1)) AS n_valid, count(*) AS n_rows FROM states", ["quality", "toxic"]))
def q_label_coverage(t: Tables) -> DataFrame:
    states = t.scans().withColumn("quality", F.coalesce("quality", F.lit(-1)))
    return profile.label_coverage(states, ["quality", "toxic"])


@query(_each("""
SELECT l_returnflag, 'l_extendedprice' AS measure, {c}::DOUBLE AS p,
       round(quantile_cont(l_extendedprice, {c}), 6) AS value FROM lineitem GROUP BY l_returnflag""", ["0.1", "0.5", "0.99"]))
def q_quantiles_bucketed(t: Tables) -> DataFrame:
    """The selection over many buckets of few rows."""
    lines = t.lineitem.select("l_returnflag", "l_extendedprice")
    return exact_quantiles(lines, ["l_extendedprice"], [0.1, 0.5, 0.99], by=["l_returnflag"], rows_per_bucket=2_000, builtin=False)


@query(_each("""
SELECT o_orderpriority, 'price' AS measure, {c}::DOUBLE AS p, round(quantile_cont(
  CASE WHEN o_orderstatus = 'F' THEN 1e9 ELSE o_totalprice END, {c}), 6) AS value FROM orders GROUP BY o_orderpriority""", ["0.1", "0.25"]))
def q_quantiles_nonfinite(t: Tables) -> DataFrame:
    """Infinities lie beyond every number; quantiles below them are as if they were large."""
    price = F.when(F.col("o_orderstatus") == "F", F.lit(float("inf"))).otherwise(F.col("o_totalprice"))
    orders = t.orders.select("o_orderpriority", price.alias("price"))
    return exact_quantiles(orders, ["price"], [0.1, 0.25], by=["o_orderpriority"], rows_per_bucket=500, builtin=False)
