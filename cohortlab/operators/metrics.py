"""Binary-classifier evaluation per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlab.functions.numeric import at_least, ratio_or_zero
from cohortlab.functions.predicates import col
from cohortlab.operators.order_stats import ROWS_PER_BUCKET, value_edges, with_bucket


def complete(scored: DataFrame, truth: str = "y_true", score: str = "y_score") -> DataFrame:
    """Rows that can be judged: with a truth and a score that is a number.

    All metrics of this module are over these rows; `incomplete_counts` says
    how many the others are.
    """
    return scored.filter(col(truth).isNotNull() & col(score).isNotNull() & ~F.isnan(col(score).cast("double")))


def incomplete_counts(scored: DataFrame, by: str, truth: str = "y_true", score: str = "y_score") -> DataFrame:
    """(by, n_rows, n_without_truth, n_without_score) of all rows per group."""
    without = col(score).isNull() | F.isnan(col(score).cast("double"))
    return scored.groupBy(col(by)).agg(
        F.count("*").alias("n_rows"), F.count_if(col(truth).isNull()).alias("n_without_truth"),
        F.count_if(without).alias("n_without_score"),
    )


def class_counts(scored: DataFrame, by: str, truth: str = "y_true", score: str = "y_score") -> DataFrame:
    """(by, n, n_positive) per group."""
    return complete(scored, truth, score).groupBy(col(by)).agg(F.count("*").alias("n"), F.count_if(col(truth) == 1).alias("n_positive"))


def _ratios(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1; a ratio with nothing below the line is 0."""
    return [
        ratio_or_zero(tp, tp + fp).alias("precision"), ratio_or_zero(tp, tp + fn).alias("recall"),
        ratio_or_zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def confusion_metrics(
    scored: DataFrame, by: str, truth: str = "y_true", score: str = "y_score", threshold: float = 0.5
) -> DataFrame:
    """(by, n, n_positive, tp, fp, fn, tn, precision, recall, f1).

    Predicted positive at score >= threshold.
    """
    is_pos, said_pos = col(truth) == 1, at_least(col(score), threshold) == 1
    counts = complete(scored, truth, score).groupBy(col(by)).agg(
        F.count("*").alias("n"), F.count_if(is_pos).alias("n_positive"),
        F.count_if(is_pos & said_pos).alias("tp"), F.count_if(~is_pos & said_pos).alias("fp"),
        F.count_if(is_pos & ~said_pos).alias("fn"), F.count_if(~is_pos & ~said_pos).alias("tn"),
    )
    return counts.select("*", *_ratios(F.col("tp"), F.col("fp"), F.col("fn")))


def _ranked(scored: DataFrame, by: str, truth: str, score: str, threshold: float, rows_per_bucket: int) -> DataFrame:
    """(by, _p, _n, _tp, _fp, _won): class sizes, hits at the threshold, and the
    pairs in which the positive scores higher (ties half).

    Tied scores are collapsed first; each score bucket of a group is then
    ranked on its own, and the negatives in lower buckets are added from the
    bucket totals. No task sorts a whole group.
    """
    rows = complete(scored, truth, score).select(col(by), col(score).cast("double").alias("_s"), (col(truth) == 1).cast("int").alias("_pos"))
    bucketed = with_bucket(rows, "_s", value_edges(rows, "_s", rows_per_bucket), "_bucket")
    ties = bucketed.groupBy(col(by), "_bucket", "_s").agg(
        F.sum("_pos").alias("_p"), F.sum(1 - F.col("_pos")).alias("_n")
    )
    rising = Window.partitionBy(col(by), "_bucket").orderBy("_s")
    below = F.sum("_n").over(rising) - F.col("_n")
    hit = at_least(F.col("_s"), threshold)
    per_bucket = ties.withColumn("_won", F.col("_p").cast("double") * (below + F.col("_n") / 2))
    per_bucket = per_bucket.groupBy(col(by), "_bucket").agg(
        F.sum("_p").alias("_p"), F.sum("_n").alias("_n"), F.sum("_won").alias("_won"),
        F.sum(F.col("_p") * hit).alias("_tp"), F.sum(F.col("_n") * hit).alias("_fp"),
    )
    # One row per bucket and group from here on.
    up = Window.partitionBy(col(by)).orderBy("_bucket")
    lower = F.sum("_n").over(up) - F.col("_n")
    placed = per_bucket.withColumn("_won", F.col("_won") + F.col("_p").cast("double") * lower)
    return placed.groupBy(col(by)).agg(*[F.sum(c).alias(c) for c in ("_p", "_n", "_tp", "_fp", "_won")])


def auroc(
    scored: DataFrame, by: str, truth: str = "y_true", score: str = "y_score", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """(by, auroc): chance that a positive scores above a negative, ties half.

    NULL where a group has one class only.
    """
    return _ranked(scored, by, truth, score, 0.5, rows_per_bucket).select(col(by), _area().alias("auroc"))


def _area() -> Column:
    return F.try_divide(F.col("_won"), F.col("_p").cast("double") * F.col("_n"))


def evaluation_report(
    scored: DataFrame, by: str, truth: str = "y_true", score: str = "y_score", threshold: float = 0.5,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """(by, n, n_positive, auroc, f1, precision, recall), auroc NULL for one class.

    The hits at the threshold come from the same tied-score counts that the
    ranking needs, so the scores are shuffled once for all metrics.
    """
    ranked = _ranked(scored, by, truth, score, threshold, rows_per_bucket)
    measured = ranked.select(
        col(by), (F.col("_p") + F.col("_n")).alias("n"), F.col("_p").alias("n_positive"), _area().alias("auroc"),
        *_ratios(F.col("_tp"), F.col("_fp"), F.col("_p") - F.col("_tp")),
    )
    return measured.select(col(by), "n", "n_positive", "auroc", "f1", "precision", "recall")


def macro_average(report: DataFrame) -> DataFrame:
    """One row: the mean of each metric over the groups that have both classes."""
    names = ["auroc", "f1", "precision", "recall"]
    return report.filter(F.col("auroc").isNotNull()).agg(
        F.count("*").alias("n_groups"), *[F.avg(m).alias(f"macro_{m}") for m in names]
    )
