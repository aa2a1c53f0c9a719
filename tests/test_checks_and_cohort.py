import pytest
from pyspark.sql import functions as F

from cohortlab.operators import checks, cohort
from cohortlab.plans import matched_splits, stratified_split


@pytest.fixture(scope="module")
def scans(spark):
    rows = [(f"S_{i:05d}", i, 2 if i % 4 == 0 else 0, ["portal", "arterial", None][i % 3]) for i in range(1, 401)]
    return spark.createDataFrame(rows, "`scan id` string, num int, `tumor?` int, `ct phase` string")


COLUMNS = matched_splits.ScanColumns(id="scan id", id_num="num")
RANGES = {"train": (1, 300), "test": (301, 390)}


def test_build_subsample_and_check(spark, scans, tmp_path):
    out = str(tmp_path / "splits")
    splits = matched_splits.build_splits(scans, COLUMNS, RANGES, {"train": 40, "test": 11}, output=out)
    counts = {r.split: r["count"] for r in splits.groupBy("split").count().collect()}
    assert counts == {"train_pos": 75, "train_neg": 40, "test_pos": 22, "test_neg": 11}
    assert matched_splits.check_splits(scans, splits, COLUMNS, RANGES).count() == 0
    assert checks.overlapping_ids(splits).count() == 0

    small = matched_splits.build_train_subsamples(scans, splits, COLUMNS, [(46, 42), (23, 42), (23, 43)], output=out)
    counts = {r.split: r["count"] for r in small.groupBy("split").count().collect()}
    assert counts == {
        "train_sample_46_pos": 30, "train_sample_46_neg": 16, "train_sample_23_seed42_pos": 15,
        "train_sample_23_seed42_neg": 8, "train_sample_23_seed43_pos": 15, "train_sample_23_seed43_neg": 8}
    assert matched_splits.check_splits(scans, small, COLUMNS, RANGES).count() == 0
    # The second write added its splits and left the first ones in place.
    from cohortlab.sources.id_lists import read_splits
    assert read_splits(spark, out).select("split").distinct().count() == 10
    table = matched_splits.crosstab(scans, splits, ["train_pos", "train_neg"], COLUMNS)
    assert {r["ct phase"] for r in table.collect()} == {"portal", "arterial"}


def test_verify_reports_every_rule(spark, scans):
    splits = spark.createDataFrame([
        ("train_pos", "S_00001"), ("train_pos", "S_00004"), ("train_neg", "S_00004"), ("train_sample_5_neg", "S_00395"),
        ("test_pos", "S_00004"), ("test_neg", "S_00301"),
    ], "split string, id string")
    report = {(r.split, r.rule): (r.n_bad, r.message)
              for r in matched_splits.check_splits(scans, splits, COLUMNS, RANGES).collect()}
    assert report == {
        ("train_pos", "positive_flag"): (1, "train_pos: contains a row with tumor? < 1"),
        ("train_neg", "negative_flag"): (1, "train_neg: contains a row with tumor? != 0"),
        ("train_sample_5_neg", "train_range"): (1, "train_sample_5_neg: contains an id outside TRAIN_ID_RANGE"),
        ("test_pos", "test_range"): (1, "test_pos: contains an id outside TEST_ID_RANGE"),
    }


def test_build_reports_while_it_writes(spark, scans, tmp_path):
    """Missing flags, short negatives, and nothing else; the splits are those of the plain build."""
    holes = scans.withColumn("tumor?", F.when(F.col("num") % 10 != 3, F.col("tumor?")))
    want = matched_splits.build_splits(holes, COLUMNS, RANGES, {"train": 40, "test": 500}, strict=False)
    splits, report = matched_splits.build_checked_splits(holes, COLUMNS, RANGES, {"train": 40, "test": 500}, output=str(tmp_path), flat=True)
    assert sorted(map(tuple, splits.collect())) == sorted(map(tuple, want.collect()))
    drawn = want.filter("split = 'test_neg'").count()
    assert sorted((r.split, r.rule, r.n_bad) for r in report.collect()) == [
        ("test", "missing_flag", 9), ("test_neg", "shortfall", 500 - drawn), ("train", "missing_flag", 30)]
    assert len(list(tmp_path.iterdir())) == 4
    clean = matched_splits.build_checked_splits(scans, COLUMNS, RANGES, {"train": 40, "test": 11})[1]
    assert clean.collect() == [] and clean.columns == ["split", "rule", "n_bad", "message"]


def test_watched_rules_equal_the_check(spark, scans):
    """Counts taken while rows are written are those of the check that reads them again."""
    from cohortlab.staging import stage

    rows = spark.createDataFrame([("train_pos", 1), ("train_pos", 4), ("train_neg", 4), ("test_pos", 4), ("test_neg", 301), ("train_neg", 395)],
                                 "split string, num int")
    joined = rows.join(scans, "num").select("split", F.col("scan id").alias("id"), F.col("tumor?").alias("_flag"), F.col("num").alias("_num"))
    watched = checks.WatchedSplits(["train_pos", "train_neg", "test_pos", "test_neg", "none_pos"], "tumor?", RANGES)
    written = stage(watched.watch(joined))
    want = matched_splits.check_splits(scans, written.select("split", "id"), COLUMNS, RANGES).collect()
    assert sorted(watched.broken()) == sorted(map(tuple, want)) and len(want) == 4
    assert watched.rows() == {"train_pos": 2, "train_neg": 2, "test_pos": 1, "test_neg": 1, "none_pos": 0}


def test_verify_unknown_id(spark, scans):
    splits = spark.createDataFrame([("train_pos", "S_99999")], "split string, id string")
    loose = matched_splits.check_splits(scans, splits, COLUMNS, RANGES, strict=False).collect()
    assert [(r.rule, r.n_bad) for r in loose] == [("unknown_id", 1)]
    with pytest.raises(Exception, match="unknown id"):
        matched_splits.check_splits(scans, splits, COLUMNS, RANGES).collect()


def test_strict_build_raises_on_missing_flag(spark, scans):
    holes = scans.withColumn("tumor?", F.when(F.col("num") != 17, F.col("`tumor?`")))
    assert matched_splits.build_splits(holes, COLUMNS, RANGES, {"train": 4, "test": 1}, strict=False).count() == 102
    with pytest.raises(Exception, match="missing value in tumor"):
        matched_splits.build_splits(holes, COLUMNS, RANGES, {"train": 4, "test": 1}, strict=True)


def test_membership_joins(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(6)], "id int, v string")
    ids = spark.createDataFrame([(1,), (1,), (4,), (9,)], "id int")
    assert sorted(r.id for r in cohort.members(df, ids, "id").collect()) == [1, 4]
    assert sorted(r.id for r in cohort.non_members(df, ids, "id").collect()) == [0, 2, 3, 5]
    assert {r.id: r.is_member for r in cohort.flag_members(df, ids, "id").collect()} == {
        0: False, 1: True, 2: False, 3: False, 4: True, 5: False}
    loose = cohort.lookup(ids, df, "id", strict=False).collect()
    assert sorted((r.id, r.v, r.missing) for r in loose if not r.missing) == [(1, "v1", False), (1, "v1", False), (4, "v4", False)]
    assert [r.id for r in loose if r.missing] == [9]
    with pytest.raises(Exception, match="unknown id: 9"):
        cohort.lookup(ids, df, "id").collect()


def test_classes_in_one_pass(spark):
    df = spark.createDataFrame([(0.0,), (0.9,), (1.0,), (3.0,), (None,), (-1.0,)], "flag double")
    assert sorted((r.flag, r.label) for r in cohort.with_class(df, "flag").collect()) == [
        (0.0, "neg"), (0.9, "neg"), (1.0, "pos"), (3.0, "pos")]


def test_filters_reach_the_scan(spark, scans, tmp_path):
    path = str(tmp_path / "scans")
    scans.withColumnRenamed("tumor?", "flag").withColumn("other", F.lit(1)).write.parquet(path)
    df = spark.read.parquet(path)
    for kept in (cohort.lesion_cohort(df, "flag"), cohort.compound_cohort(df, "flag", ["other", "num"])):
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(flag,1)" in plan.split("PushedFilters")[1]


def test_split_by_membership(spark, tmp_path):
    from cohortlab.sources.id_lists import write_ids
    ids = spark.createDataFrame([(f"B_{i:04d}",) for i in range(1111)], "id string")
    write_ids(ids, str(tmp_path / "all"))
    write_ids(ids.limit(354), str(tmp_path / "marked"))
    parts = stratified_split.split_lists(spark, str(tmp_path / "all"), str(tmp_path / "marked"))
    counts = {(r.split, r.is_member): r["count"] for r in parts.groupBy("split", "is_member").count().collect()}
    assert counts == {("train", True): 319, ("train", False): 681, ("test", True): 35, ("test", False): 76}
    marked = parts.filter("is_member").select("id")
    train = parts.filter("split = 'train'").select("id")
    sample = stratified_split.sample_by_membership(train, marked, 50, 42)
    assert sample.filter("is_member").count() == 16 and sample.count() == 50
