"""Draws in one scan: the same rows as draws by cut keys."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import least_rows, sampling


@pytest.fixture(scope="module")
def pool(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", "c", None, ""]), f"x{i}", [float(i)], rng.choice(["pos", "neg", "neg"])) for i in range(6_000)]
    return spark.createDataFrame(rows, "id long, s string, _key string, v array<double>, label string").repartition(7)


def allocation_of(spark, sizes):
    return spark.createDataFrame(list(sizes.items()), "s string, k bigint")


@pytest.mark.parametrize("sizes", [{"hot": 400, "b": 3, "c": 0}, {"hot": 1, "": 20, "nowhere": 5}, {"b": 10_000}, {"c": -2}, {}])
def test_same_rows_as_by_cuts(spark, pool, sizes):
    allocation = allocation_of(spark, sizes) if sizes else spark.createDataFrame([], "s string, k bigint")
    want = sampling.draw(pool, allocation, ["s"], "id", seed=5)
    got = sampling.draw_at_once(pool, allocation, ["s"], "id", seed=5)
    assert got.columns == pool.columns and got.schema == pool.schema
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_larger_draws_go_by_cuts(spark, pool, monkeypatch):
    monkeypatch.setattr(sampling, "least_rows", None)
    got = sampling.draw_at_once(pool, allocation_of(spark, {"hot": 30}), ["s"], "id", at_once_rows=29)
    assert got.count() == 30


def test_what_a_draw_raises_for(spark, pool):
    with pytest.raises(ValueError, match="too small"):
        sampling.draw_at_once(pool, allocation_of(spark, {"b": 5_000}), ["s"], "id", strict=True)
    with pytest.raises(ValueError, match="too small"):
        sampling.draw_at_once(pool, allocation_of(spark, {"nowhere": 1}), ["s"], "id", strict=True)
    copies = spark.createDataFrame([(1, "x")] * 40, "id long, s string").repartition(3)
    with pytest.raises(ValueError, match="copies"):
        sampling.draw_at_once(copies, allocation_of(spark, {"x": 7}), ["s"], "id")
    assert sampling.draw_at_once(copies, allocation_of(spark, {"x": 40}), ["s"], "id").count() == 40


def test_least_rows_of_several_orders(spark, pool, monkeypatch):
    """Against plain sorting, with so little room that rows are thrown out many times."""
    keys = [sampling.draw_key(["id"], seed) for seed in (1, 2)]
    candidates, counts = least_rows.least_rows(pool.select("id", "s"), ["s"], ["id"], keys, [5, 0])
    plain = {}
    for r in pool.select("id", "s", keys[0].alias("k")).collect():
        plain.setdefault(r.s, []).append((r.k, r.id))
    want = sorted((s or "", s is None, i, rank) for s, rows in plain.items() for rank, (_, i) in enumerate(sorted(rows)[:5], 1))
    assert sorted((r.s or "", r.s is None, r.id, r[least_rows.RANK]) for r in candidates.collect()) == want
    assert {r.s: r[least_rows.COUNT] for r in counts.collect()} == {s: len(rows) for s, rows in plain.items()}


@pytest.mark.parametrize("specs", [[("a", 60, 42)], [("a", 60, 42), ("b", 20, 42), ("c", 20, 43), ("all", 50_000, 1)]])
def test_subsamples_from_one_scan(spark, pool, specs):
    by_cuts = sampling.ratio_subsamples(pool, specs, "label", "s", "id", at_once_rows=0)
    at_once = sampling.ratio_subsamples(pool, specs, "label", "s", "id", at_once_rows=10**6)
    want = sorted(map(tuple, by_cuts.collect()))
    assert want and sorted(map(tuple, at_once.collect())) == want


def test_the_pool_is_read_once(spark, pool, tmp_path):
    """Every row goes through the keys of the samples a single time."""
    path = str(tmp_path / "pool")
    pool.write.parquet(path)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    df = spark.read.parquet(path).withColumn("id", counted("id"))
    assert sampling.ratio_subsamples(df, [("a", 60, 42), ("b", 20, 43)], "label", "s", "id").count() == 80
    assert seen.value == 6_000


def test_empty_pool(spark, pool):
    assert sampling.draw_at_once(pool.limit(0), allocation_of(spark, {"hot": 3}), ["s"], "id").collect() == []
    assert sampling.ratio_subsamples(pool.limit(0), [("a", 5, 1)], "label", "s", "id").collect() == []
