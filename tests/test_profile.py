import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import order_stats, profile


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(1, 2, 0, "x", " note"), (0, 1, 3, None, ""), (None, 4, 1, "x", None), (5, 1, 1, "y", "n"), (2, None, 2, None, "\t")]
    return spark.createDataFrame(rows, "liver int, pancreas int, kidney int, kind string, note string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_completeness(cases):
    assert rows(profile.completeness(cases)) == [("liver", 4), ("pancreas", 4), ("kidney", 5), ("kind", 3), ("note", 4)]
    assert rows(profile.completeness_where_text(cases, "note", ["liver", "kind"])) == [("liver", 2, 2), ("kind", 2, 2)]


def test_value_counts(cases):
    assert rows(profile.value_counts(cases, "kind")) == [(None, 2), ("x", 2), ("y", 1)]
    assert rows(profile.value_counts(cases, "kind", keep_missing=False)) == [("x", 2), ("y", 1)]
    shares = {r.kind: r.share for r in profile.value_shares(cases, "kind").collect()}
    assert shares == {"x": pytest.approx(2 / 3), "y": pytest.approx(1 / 3)}
    assert {r.kind: (r.n, r.pct) for r in profile.value_percentages(cases, "kind").collect()} == {
        None: (2, 40.0), "x": (2, 40.0), "y": (1, 20.0)}


def test_value_percentages_of_many_columns(cases):
    out = profile.value_percentages_of(cases, {"Kind": "kind", "Note": "note"})
    got = {(r.name, r.value): (r.n, r.pct) for r in out.collect()}
    assert got[("Kind", None)] == (2, 40.0) and got[("Note", "n")] == (1, 20.0)
    assert len(got) == 3 + 5 and sum(n for n, _ in got.values()) == 10


def test_cooccurrence_and_prevalence(cases):
    out = rows(profile.cooccurrence(cases, {"both": ["liver", "pancreas"], "none": ["liver", "kidney"]}))
    assert out == [("both", "liver", 2, 5, 40.0, 3.0), ("both", "pancreas", 2, 5, 40.0, 1.5),
                   ("none", "liver", 2, 5, 40.0, 3.5), ("none", "kidney", 2, 5, 40.0, 1.5)]
    nothing = rows(profile.cooccurrence(cases.filter("liver = 0"), {"both": ["liver", "pancreas"]}))
    assert nothing[0] == ("both", "liver", 0, 1, 0.0, None)
    assert rows(profile.prevalence(cases, ["liver"])) == [("liver", 3, 5, 60.0, pytest.approx(8 / 3))]
    assert rows(profile.any_prevalence(cases, ["liver", "pancreas"])) == [(5, 5, 100.0)]
    assert rows(profile.any_prevalence(cases.limit(0), ["liver"])) == [(0, 0, 0.0)]


AGES = ["45", "17", "18", "80", "119", "120", "-1", "045Y", "", None, "30.5", "12d"]


@pytest.mark.parametrize("few", [True, False])
def test_summary_and_describe(spark, monkeypatch, few):
    monkeypatch.setattr(profile, "probe", lambda *a: order_stats.Probe(8, few))
    df = spark.createDataFrame([(a,) for a in AGES], "age string")
    valid = [45, 17, 18, 80, 119, 120, -1, 30.5]
    r = profile.numeric_summary(df, "age").first()
    assert (r.total, r.valid, r.missing, r.min, r.max) == (12, 8, 4, -1, 120)
    assert r["mean"] == pytest.approx(np.mean(valid)) and r["median"] == pytest.approx(np.median(valid))
    assert r["std"] == pytest.approx(statistics.stdev(valid))
    got = dict(rows(profile.describe(df, "age")))
    assert got["count"] == 8 and got["min"] == -1 and got["max"] == 120
    for name, p in (("25%", 0.25), ("50%", 0.5), ("75%", 0.75)):
        assert got[name] == pytest.approx(np.quantile(valid, p))


def test_nan_is_missing_in_summaries(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    r = profile.numeric_summary(df, "x").first()
    assert (r.valid, r.missing, r.max, r["mean"]) == (2, 1, 3.0, 2.0)


def test_binned_distribution(spark):
    df = spark.createDataFrame([(a,) for a in AGES], "age string")
    out = profile.binned_distribution(df, "age").collect()
    assert [(r.label, r.n) for r in out] == [
        ("<18", 1), ("18-29", 1), ("30-39", 1), ("40-49", 1), ("50-59", 0), ("60-69", 0), ("70-79", 0), ("80+", 2)]
    assert out[0].pct == 12.5 and out[7].pct == 25.0 and out[7].bar == "█" * 12 and out[4].bar == ""
    empty = profile.binned_distribution(df.filter("age = 'none'"), "age").collect()
    assert [r.n for r in empty] == [0] * 8 and {r.pct for r in empty} == {0.0}


@pytest.mark.parametrize("values", [
    [i / 10 for i in range(0, 31)], [0.1 * i for i in range(1000)], [3.0, 3.0, 3.0], [1e9, -1e9, 5.0],
    [float(i) for i in range(61)],
])
def test_histogram_matches_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    out = profile.histogram(df, "x").collect()
    counts, edges = np.histogram(values, bins=30)
    assert [r.n for r in out] == counts.tolist()
    assert [r.lower for r in out] == pytest.approx(edges[:-1].tolist()) and out[-1].upper == edges[-1]


def test_label_coverage_and_counts(spark):
    df = spark.createDataFrame([(0, 1), (1, -1), (-1, None), (None, None)], "a int, b int")
    assert rows(profile.label_coverage(df, ["a", "b"])) == [("a", 1, 1, 1, 2, 4), ("b", 0, 1, 1, 1, 4)]
    assert sorted(rows(profile.label_counts(df, ["a", "b"]))) == [
        ("a", -1, 1), ("a", 0, 1), ("a", 1, 1), ("b", -1, 1), ("b", 1, 1)]


def test_crosstab(spark):
    df = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", None), ("d", "v")], "id string, phase string")
    splits = spark.createDataFrame(
        [("train_pos", "a"), ("train_pos", "a"), ("train_neg", "b"), ("test_pos", "c"), ("test_neg", "d")],
        "split string, id string")
    names = ["train_pos", "train_neg", "test_pos", "test_neg"]
    out = {r.phase: tuple(r)[1:] for r in profile.split_crosstab(df, splits, "id", "phase", names).collect()}
    assert out == {"p": (1, 1, 0, 0), "v": (0, 0, 0, 1)}


def test_reports_scan_once(spark, tmp_path):
    path = str(tmp_path / "cases")
    spark.range(10).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"), F.lit("x").alias("wide")).write.parquet(path)
    df = spark.read.parquet(path)
    for report in (profile.prevalence(df, ["a", "b"]), profile.label_coverage(df, ["a", "b"])):
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "wide" not in plan
