import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cohortlab import staging
from cohortlab.operators import sampling


def key(seed, *ids):
    return hashlib.md5(":".join(map(str, (seed, *ids))).encode()).hexdigest()


def drawn_by_hand(rows, allocation, seed):
    """rows: (id, stratum)."""
    groups = defaultdict(list)
    for i, s in rows:
        groups[s].append(i)
    return sorted(i for s, k in allocation.items() for i in sorted(groups[s], key=lambda i: (key(seed, i), i))[:max(k, 0)])


@pytest.fixture(scope="module")
def pool(spark):
    # Stratum "a" holds most rows; ids without a stratum are never drawn.
    rows = [(i, "a" if i % 10 < 7 else ("b" if i % 10 < 9 else None)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id int, s string").repartition(7)


def allocation_of(spark, allocation):
    return spark.createDataFrame(list(allocation.items()), "s string, k bigint")


@pytest.mark.parametrize("allocation", [
    {"a": 100, "b": 7}, {"a": 2100, "b": 600}, {"a": 1, "b": 0}, {"a": 5000, "b": -3}, {"a": 2099, "zzz": 4},
])
@pytest.mark.parametrize("rank_rows", [1_000_000, 5, 1])
def test_draw_matches_plain_ranking(spark, pool, allocation, rank_rows):
    rows, df = pool
    out = sampling.draw(df, allocation_of(spark, allocation), ["s"], "id", seed=3, rank_rows=rank_rows)
    assert out.columns == df.columns
    assert sorted(r.id for r in out.collect()) == drawn_by_hand(rows, allocation, 3)


def test_draw_without_small_tables(spark, pool, monkeypatch):
    """Beyond the size check nothing is broadcast and results stay the same."""
    rows, df = pool
    monkeypatch.setattr(staging, "SMALL_ROWS", 0)
    monkeypatch.setattr(sampling, "small_table", lambda t, bounded=False: staging.small_table(t, 0, bounded))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rank_rows in (1_000_000, 3):
            out = sampling.draw(df, allocation_of(spark, {"a": 321, "b": 50}), ["s"], "id", seed=3, rank_rows=rank_rows)
            assert sorted(r.id for r in out.collect()) == drawn_by_hand(rows, {"a": 321, "b": 50}, 3)
            assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_draw_plan_moves_no_rows(spark, pool):
    _, df = pool
    path = staging.new_folder(spark, "pool")
    df.write.parquet(path)
    out = sampling.draw(spark.read.parquet(path), allocation_of(spark, {"a": 321, "b": 50}), ["s"], "id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan and "BroadcastHashJoin" in plan


def test_draw_is_the_same_for_any_partitioning(spark, pool):
    _, df = pool
    allocation = allocation_of(spark, {"a": 40, "b": 40})
    once = {r.id for r in sampling.draw(df.repartition(1), allocation, ["s"], "id").collect()}
    again = {r.id for r in sampling.draw(df.repartition(13), allocation, ["s"], "id").collect()}
    assert once == again and len(once) == 80


def test_nesting_and_salt(spark, pool):
    _, df = pool

    def ids(k, seed, salt=None):
        return {r.id for r in sampling.draw(df, allocation_of(spark, {"a": k}), ["s"], "id", seed, salt).collect()}

    assert ids(50, 42) <= ids(350, 42)
    assert not ids(50, 43) <= ids(350, 42)
    assert not ids(50, 42, "other") <= ids(350, 42)


def test_strict_draw_reports_shortfall(spark, pool):
    _, df = pool
    with pytest.raises(ValueError, match="too small"):
        sampling.draw(df, allocation_of(spark, {"a": 10, "b": 601}), ["s"], "id", strict=True)
    with pytest.raises(ValueError, match="too small"):
        sampling.draw(df, allocation_of(spark, {"nowhere": 1}), ["s"], "id", strict=True)
    report = sampling.capacity_report(
        allocation_of(spark, {"a": 10, "b": 601, "nowhere": 1}), sampling.stratum_counts(df, "s"), ["s"])
    assert sorted(map(tuple, report.collect())) == [("b", 601, 600, 1), ("nowhere", 1, 0, 1)]


@pytest.mark.parametrize("rank_rows", [1_000_000, 10])
def test_copies_of_an_id(spark, rank_rows):
    """A third of the rows share one id: whole copies are fine, a cut among them raises."""
    df = spark.createDataFrame([(7, "x")] * 500 + [(i, "x") for i in range(1000, 2000)], "id int, s string")
    before = sum(key(42, i) < key(42, 7) for i in range(1000, 2000))
    for k in (before, before + 500, before + 501):
        out = sampling.draw(df, allocation_of(spark, {"x": k}), ["s"], "id", rank_rows=rank_rows)
        assert out.count() == k
    with pytest.raises(ValueError, match="copies of one id"):
        sampling.draw(df, allocation_of(spark, {"x": before + 250}), ["s"], "id", rank_rows=rank_rows)


def test_several_id_columns(spark):
    df = spark.createDataFrame([(i // 4, i % 4, "x") for i in range(400)], "a int, b int, s string")
    out = sampling.draw(df, allocation_of(spark, {"x": 90}), ["s"], ["a", "b"], seed=1)
    want = sorted(((i // 4, i % 4) for i in range(400)), key=lambda p: key(1, *p))[:90]
    assert sorted((r.a, r.b) for r in out.collect()) == sorted(want)


def allocate(fn, counts, n, spark):
    df = spark.createDataFrame(list(counts.items()), "s string, n bigint")
    return {r.s: r.k for r in fn(df, n, "s").collect()}


def test_rounded_allocation(spark):
    # 2.5 and 2.5 both round to 2; the drift of one goes to the first of the equals.
    assert allocate(sampling.rounded_allocation, {"a": 5, "b": 5}, 5, spark) == {"a": 3, "b": 2}
    # Many halves round up: the drift is negative and may pass zero.
    many = {f"s{i}": 3 for i in range(20)}
    got = allocate(sampling.rounded_allocation, many, 11, spark)
    assert sum(got.values()) == 11 and got["s0"] == 1 - 9
    # Larger count wins the drift over the name.
    assert allocate(sampling.rounded_allocation, {"a": 33, "b": 34, "c": 33}, 10, spark) == {"a": 3, "b": 4, "c": 3}


def test_largest_remainder_allocation(spark):
    assert allocate(sampling.largest_remainder_allocation, {"t": 354, "f": 757}, 1000, spark) == {"t": 319, "f": 681}
    assert allocate(sampling.largest_remainder_allocation, {"t": 319, "f": 681}, 350, spark) == {"t": 112, "f": 238}
    assert allocate(sampling.largest_remainder_allocation, {"t": 319, "f": 681}, 50, spark) == {"t": 16, "f": 34}
    many = {f"s{i:02d}": 3 for i in range(20)}
    got = allocate(sampling.largest_remainder_allocation, many, 11, spark)
    assert sum(got.values()) == 11 and set(got.values()) == {0, 1} and got["s00"] == 1


def test_two_way_split(spark):
    rows = [(i, i < 354) for i in range(1111)]
    df = spark.createDataFrame(rows, "id int, m boolean").repartition(5)
    parts = sampling.two_way_split(df, 1000, "m", "id").collect()
    assert Counter((r.split, r.m) for r in parts) == {
        ("train", True): 319, ("train", False): 681, ("test", True): 35, ("test", False): 76}
    assert sorted(r.id for r in parts) == list(range(1111))


@pytest.mark.parametrize("rows, size, message", [
    ([(1, True), (2, True), (3, False), (4, False)], 4, "leave some"),
    ([(1, True), (2, True), (3, False), (4, False)], 0, "leave some"),
    ([(1, True), (2, True), (3, False)], 2, "only one row"),
    ([(1, True), (2, True), (3, False), (4, False)], 1, "at least one row per stratum"),
])
def test_impossible_splits_raise(spark, rows, size, message):
    df = spark.createDataFrame(rows, "id int, m boolean")
    with pytest.raises(ValueError, match=message):
        sampling.two_way_split(df, size, "m", "id")


def test_simple_sample(spark):
    df = spark.range(500)
    want = sorted(range(500), key=lambda i: key(42, i))[:20]
    assert sorted(r.id for r in sampling.simple_sample(df, 20, "id").collect()) == sorted(want)
    assert sampling.simple_sample(df, 1000, "id").count() == 500
    plan = sampling.simple_sample(df, 20, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError, match="copies"):
        sampling.simple_sample(spark.createDataFrame([(1,)] * 50, "id int"), 20, "id").collect()


def scan_rows():
    """Ids 1..1200; 1..1000 are train. Some scans lack a phase."""
    out = []
    for i in range(1, 1201):
        phase = [None, "portal", "portal", "arterial", "portal", "venous"][i % 6]
        out.append((i, "train" if i <= 1000 else "test", "pos" if i % 5 == 0 else "neg", phase))
    return out


@pytest.fixture(scope="module")
def scans(spark):
    return spark.createDataFrame(scan_rows(), "id int, split string, label string, phase string")


def rounded(counts, n):
    total = sum(counts.values())
    k = {s: round(c / total * n) for s, c in counts.items()}
    top = min(k, key=lambda s: (-k[s], -counts[s], s))
    k[top] += n - sum(k.values())
    return k


def test_matched_negatives(spark, scans):
    out = sampling.matched_negatives(scans, {"train": 101, "test": 13}, "split", "label", "phase", "id").collect()
    got = defaultdict(set)
    for r in out:
        got[r.split].add(r.id)
    for split, n in (("train", 101), ("test", 13)):
        rows = [r for r in scan_rows() if r[1] == split]
        assert got[f"{split}_pos"] == {r[0] for r in rows if r[2] == "pos"}
        mix = Counter(r[3] for r in rows if r[2] == "pos" and r[3])
        pool = [(r[0], r[3]) for r in rows if r[2] == "neg" and r[3]]
        assert sorted(got[f"{split}_neg"]) == drawn_by_hand(pool, rounded(mix, n), 42)
        assert len(got[f"{split}_neg"]) == n
    assert len(out) == sum(map(len, got.values()))


def test_ratio_subsamples(spark, scans):
    train = scans.filter("split = 'train'")
    specs = [("big", 350, 42), ("small_seed42", 50, 42), ("small_seed43", 50, 43)]
    got = defaultdict(set)
    for r in sampling.ratio_subsamples(train, specs, "label", "phase", "id").collect():
        got[r.split].add(r.id)
    rows = [r for r in scan_rows() if r[1] == "train"]
    positives = sum(r[2] == "pos" for r in rows)
    for name, n, seed in specs:
        part = {"pos": round(n * positives / len(rows))}
        part["neg"] = n - part["pos"]
        for label in ("pos", "neg"):
            side = [(r[0], r[3]) for r in rows if r[2] == label and r[3]]
            k = rounded(Counter(s for _, s in side), part[label])
            assert sorted(got[f"{name}_{label}"]) == drawn_by_hand(side, k, seed)
    assert got["small_seed42_pos"] <= got["big_pos"] and got["small_seed42_neg"] <= got["big_neg"]


def test_draw_counts_of_one_class_only(spark):
    df = spark.createDataFrame([(i, "pos", "p") for i in range(30)], "id int, label string, phase string")
    out = sampling.ratio_subsamples(df, [("s", 10, 1)], "label", "phase", "id").collect()
    assert len(out) == 10 and {r.split for r in out} == {"s_pos"}
    assert math.isclose(len({r.id for r in out}), 10)


def test_sizes_of_the_usual_subsamples(spark):
    """926 positives and 309 negatives: 262 + 88 of 350, 37 + 13 of 50."""
    rows = [(i, "pos" if i < 926 else "neg", ["portal", "arterial", "venous"][i * 7 % 3]) for i in range(1235)]
    df = spark.createDataFrame(rows, "id int, label string, phase string")
    out = sampling.ratio_subsamples(df, [("a", 350, 42), ("b", 50, 43)], "label", "phase", "id").collect()
    assert Counter(r.split for r in out) == {"a_pos": 262, "a_neg": 88, "b_pos": 37, "b_neg": 13}


def test_columns_may_have_common_names(spark):
    names = ["cut", "size", "need", "prefix", "rest", "short", "upto", "left"]
    df = spark.createDataFrame([(i, "x", *range(6)) for i in range(50)], ["cut", "size", *names[2:]])
    out = sampling.draw(df, spark.createDataFrame([("x", 7)], "size string, k bigint"), ["size"], "cut")
    assert out.columns == names and out.count() == 7
    assert sampling.two_way_split(df.withColumn("size", df.cut % 2), 20, "size", "cut", name="part").filter("part = 'train'").count() == 20
    with pytest.raises(ValueError, match="rename"):
        sampling.draw(df.withColumnRenamed("cut", "n"), spark.createDataFrame([("x", 7)], "size string, k bigint"), ["size"], "n")
