import random

import numpy as np
import pytest

from cohortlab import staging
from cohortlab.operators import order_stats, profile
from cohortlab.operators.order_stats import exact_quantiles


@pytest.fixture(scope="module")
def measured():
    rng = random.Random(5)
    rows = []
    for i in range(4000):
        group = None if i % 11 == 0 else ("hot" if i % 3 else f"g{i % 5}")
        # A third of the values are one and the same.
        x = None if i % 7 == 0 else (1.25 if i % 3 == 0 else rng.gauss(0, 1) * 10 ** rng.randint(0, 6))
        rows.append((group, x, float(rng.randint(0, 5))))
    rows.append(("empty", None, None))
    return rows


def by_hand(rows, column, probs):
    groups = {}
    for r in rows:
        if r[column] is not None:
            groups.setdefault(r[0], []).append(r[column])
    return {(g, p): float(np.quantile(v, p)) for g, v in groups.items() for p in probs}


@pytest.mark.parametrize("builtin, rows_per_bucket", [(True, 1), (False, 1_000_000), (False, 100), (False, 7)])
def test_quantiles_match_numpy(spark, measured, builtin, rows_per_bucket):
    df = spark.createDataFrame(measured, "g string, x double, y double").repartition(5)
    probs = [0.0, 0.1, 0.5, 0.99, 1.0]
    out = exact_quantiles(df, ["x", "y"], probs, ["g"], rows_per_bucket, builtin).collect()
    for column, measure in ((1, "x"), (2, "y")):
        got = {(r.g, r.p): r.value for r in out if r.measure == measure}
        want = by_hand(measured, column, probs)
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9)


def test_quantiles_without_small_tables(spark, measured, monkeypatch):
    monkeypatch.setattr(order_stats, "small_table", lambda t: staging.small_table(t, 0))
    df = spark.createDataFrame(measured, "g string, x double, y double")
    out = exact_quantiles(df, ["x"], [0.5], ["g"], 50, False).collect()
    want = by_hand(measured, 1, [0.5])
    assert {(r.g, r.p): pytest.approx(r.value) for r in out} == want


def test_buckets_keep_equal_values_together(spark, measured):
    df = spark.createDataFrame(measured, "g string, x double, y double").filter("x IS NOT NULL")
    edges = order_stats.value_edges(df, "x", 100)
    assert len(edges) > 10 and edges == sorted(set(edges))
    bucketed = order_stats.with_bucket(df, "x", edges).groupBy("x").agg({"bucket": "min"}).count()
    assert bucketed == df.select("x").distinct().count()


def test_grouped_median_by_both_ways(spark, measured, monkeypatch):
    df = spark.createDataFrame(measured, "g string, x double, y double")
    short = {r.g: r for r in profile.grouped_mean_median(df, "g", ["x", "y"]).collect()}
    monkeypatch.setattr(profile, "probe", lambda *a: order_stats.Probe(4000, False))
    long = {r.g: r for r in profile.grouped_mean_median(df, "g", ["x", "y"]).collect()}
    assert short.keys() == long.keys() and None in short and "empty" in short
    assert short["empty"].x_median is None and long["empty"].x_median is None
    for g in short:
        assert tuple(short[g])[1:] == pytest.approx(tuple(long[g])[1:], nan_ok=True) or g == "empty"


def test_probe_bounds_the_maps(spark):
    df = spark.range(1000).selectExpr("id % 10 AS g", "id AS x", "IF(id % 2 = 0, id % 3, NULL) AS y")
    assert order_stats.probe(df, ["x", "y"], ["g"]) == order_stats.Probe(1500, True)
    assert not order_stats.probe(df, ["x"], ["g"], limit=900).few
    assert order_stats.probe(df, ["y"], ["g"], limit=60).few
    assert order_stats.probe(df.limit(0), ["x"]) == order_stats.Probe(0, True)


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 40])
def test_infinities_and_nan_have_one_answer(spark, rows_per_bucket):
    values = [float("inf")] * 120 + [float("-inf")] * 60 + [float(i) for i in range(300)] + [float("nan")] * 50
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    for builtin in (True, False):
        out = exact_quantiles(df, ["x"], [0.3, 0.5], None, rows_per_bucket, builtin).collect()
        ranked = sorted(values[:480]) + values[480:]
        want = {p: ranked[int(p * 529)] + (ranked[int(p * 529) + 1] - ranked[int(p * 529)]) * (p * 529 % 1) for p in (0.3, 0.5)}
        assert {r.p: pytest.approx(r.value) for r in out} == want


def test_edges_balance_rows_of_any_spread(spark):
    rng = random.Random(8)
    values = [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(3000)] + [rng.uniform(5, 5.5) for _ in range(3000)] + [0.0] * 500
    df = spark.createDataFrame([(v,) for v in values], "x double")
    edges = order_stats.value_edges(df, "x", 300)
    sizes = np.histogram(values, [-np.inf, *edges, np.inf])[0]
    assert len(edges) >= 15 and max(sizes) <= 700
