"""Zero-shot evaluation: scores, result files, report and macro average."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlab.operators.metrics import evaluation_report, macro_average
from cohortlab.operators.zeroshot import zero_shot_scores
from cohortlab.sources.results import read_results, write_results
from cohortlab.staging import stage


def score_to_results(
    images: DataFrame, labels: DataFrame, prompts: DataFrame, findings: list[str], key: str, path: str,
    strict: bool = True,
) -> None:
    """Score every image and finding and write the nested result files."""
    scored = stage(zero_shot_scores(images, labels, prompts, findings, key, strict=strict))
    write_results(scored, path, key)


def report_results(spark: SparkSession, path: str, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(per-finding report, macro average) of result files."""
    report = evaluation_report(stage(read_results(spark, path)), "finding", threshold=threshold)
    return report, macro_average(report)


def evaluate(
    images: DataFrame, labels: DataFrame, prompts: DataFrame, findings: list[str], key: str, threshold: float = 0.5,
    strict: bool = True,
) -> DataFrame:
    """Per-finding report straight from embeddings. The scores are staged, as
    the ranking reads them twice."""
    scored = stage(zero_shot_scores(images, labels, prompts, findings, key, strict=strict))
    return evaluation_report(scored, "finding", threshold=threshold)
