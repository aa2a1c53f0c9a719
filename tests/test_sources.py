import json
import os

import pytest
from pyspark.sql import functions as F

from cohortlab import session
from cohortlab.sources import id_lists, metadata, results, volumes


def test_read_metadata(spark, tmp_path):
    path = tmp_path / "scans.csv"
    path.write_text(
        'scan id,tumor?,ct phase,age,radiologist note\n'
        'SCAN_00000001,1,portal,45,"two\nlines, ""quoted"""\n'
        'SCAN_00000002,,NA,045Y,\n'
        'SCAN_00000003,0,None,NaN,n/a\n', encoding="utf-8")
    df = metadata.read_metadata(spark, str(path), {"tumor?": "int", "age": "double"}, id_col="scan id", multi_line=True)
    assert [tuple(r) for r in df.orderBy("id_num").collect()] == [
        ("SCAN_00000001", 1, "portal", 45.0, 'two\nlines, "quoted"', 1),
        ("SCAN_00000002", None, None, None, None, 2),
        ("SCAN_00000003", 0, None, None, None, 3)]
    assert dict(df.dtypes)["id_num"] == "bigint"
    inferred = metadata.read_metadata(spark, str(path), infer=True, multi_line=True)
    assert dict(inferred.dtypes)["tumor?"] == "bigint" and dict(inferred.dtypes)["ct phase"] == "string"


def test_inference_looks_past_missing_tokens(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("a,b,c\n1,NA,x\nNA,2.5,3\n")
    df = metadata.read_metadata(spark, str(path), infer=True)
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string"}
    assert sorted(map(tuple, df.collect()), key=str) == [(1, None, "x"), (None, 2.5, "3")]


def test_long_whole_numbers_keep_their_digits(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("n\n9007199254740993\n 12 \n12d\n")
    df = metadata.read_metadata(spark, str(path), {"n": "bigint"})
    assert sorted((r.n for r in df.collect()), key=str) == [12, 9007199254740993, None]


def test_id_lists(spark, tmp_path):
    path = tmp_path / "ids.txt"
    path.write_text("a\n\n  b \n\t\nc\na\n")
    assert [r.id for r in id_lists.read_ids(spark, str(path)).collect()] == ["a", "b", "c", "a"]
    out = str(tmp_path / "out")
    for _ in range(2):
        id_lists.write_ids(spark.createDataFrame([("x",), ("y",)], "id string"), out)
    assert sorted(r.id for r in id_lists.read_ids(spark, out).collect()) == ["x", "y"]


def test_split_files(spark, tmp_path):
    (tmp_path / "train_pos.txt").write_text("a\nb\n")
    (tmp_path / "test_neg.txt").write_text("c\n")
    (tmp_path / "notes.md").write_text("no\n")
    got = sorted(map(tuple, id_lists.read_split_files(spark, str(tmp_path)).collect()))
    assert got == [("test_neg", "c"), ("train_pos", "a"), ("train_pos", "b")]


def test_splits_are_replaced_one_by_one(spark, tmp_path):
    out = str(tmp_path / "splits")
    id_lists.write_splits(spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "split string, id string"), out)
    id_lists.write_splits(spark.createDataFrame([("b", "4")], "split string, id string"), out)
    df = id_lists.read_splits(spark, out)
    assert sorted(map(tuple, df.collect())) == [("a", "1"), ("a", "2"), ("b", "4")]
    plan = df.filter("split = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


@pytest.mark.parametrize("rows_per_entry", [100_000, 7])
def test_results_roundtrip(spark, tmp_path, rows_per_entry):
    rows = [(f"f{i % 3}", f"s{i:03d}", i % 2, i / 7) for i in range(100)] + [("f1", "copy", 1, 0.5)] * 50
    df = spark.createDataFrame(rows, "finding string, study_id string, y_true int, y_score double")
    path = str(tmp_path / "results")
    results.write_results(df, path, rows_per_entry=rows_per_entry)
    assert sorted(map(tuple, results.read_results(spark, path).collect())) == sorted(rows)
    parts = [(f, v["part"]) for r in spark.read.text(path).collect() for f, v in json.loads(r.value).items()]
    assert len(set(parts)) == len(parts)
    sizes = [len(v["y_true"]) for r in spark.read.text(path).collect() for v in json.loads(r.value).values()]
    assert len(sizes) == 3 if rows_per_entry > 100 else len(sizes) > 20 and max(sizes) <= 3 * rows_per_entry


@pytest.mark.parametrize("line", ['{"cyst": {"part": 0, "study_id": ["a"', '{"cyst": {"study_id": ["a"], "y_true": [], "y_score": [0.5]}}'])
def test_broken_results_raise(spark, tmp_path, line):
    path = tmp_path / "broken.json"
    path.write_text(line + "\n")
    with pytest.raises(Exception, match="MALFORMED|unequal"):
        results.read_results(spark, str(path)).collect()


def test_document_is_written_whole_or_not_at_all(spark, tmp_path):
    rows = [(f"f{i % 3}", f"s{i:03d}", i % 2, i / 7) for i in range(30)]
    df = spark.createDataFrame(rows, "finding string, study_id string, y_true int, y_score double")
    path = str(tmp_path / "document")
    results.write_document(df, path)
    assert sorted(map(tuple, results.read_results(spark, path, one_document=True).collect())) == sorted(rows)
    with pytest.raises(ValueError, match="29 rows"):
        results.write_document(df, path, max_rows=29)


def test_one_document_results(spark, tmp_path):
    path = tmp_path / "results.json"
    path.write_text('{\n "cyst": {"study_id": ["a", "b"], "y_true": [1, 0],\n "y_score": [0.5, 0.25]},\n'
                    ' "edema": {"study_id": [], "y_true": [], "y_score": []}\n}\n')
    got = sorted(map(tuple, results.read_results(spark, str(path), one_document=True).collect()))
    assert got == [("cyst", "a", 1, 0.5), ("cyst", "b", 0, 0.25)]


def test_volumes(spark, tmp_path):
    for name in ("b.nii.gz", "a.1.nii.gz", "c.txt"):
        (tmp_path / name).write_bytes(b"12345")
    files = volumes.file_inventory(spark, str(tmp_path))
    assert [(r.id, r.length, os.path.basename(r.path)) for r in volumes.sorted_paths(files).collect()] == [
        ("a.1", 5, "a.1.nii.gz"), ("b", 5, "b.nii.gz")]
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    asked = spark.createDataFrame([("b",), ("z",), ("b",)], "id string")
    manifest = volumes.fetch_manifest(asked, files, "id", "out/")
    assert sorted(map(tuple, manifest.collect())) == [
        ("b", "out/b.nii.gz", "present"), ("b", "out/b.nii.gz", "present"), ("z", "out/z.nii.gz", "fetch")]
    assert [tuple(r) for r in volumes.still_to_fetch(asked, files, "id", "out").collect()] == [("z", "out/z.nii.gz")]


def test_shared_folder_is_the_configured_one(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_partition_column_of_text(spark, tmp_path):
    """Split names that look like numbers stay text."""
    out = str(tmp_path / "s")
    id_lists.write_splits(spark.range(3).select(F.lit("350").alias("split"), F.col("id")), out)
    assert dict(id_lists.read_splits(spark, out).dtypes)["split"] == "string"


def test_staged_folders_can_be_cleared(spark, monkeypatch):
    from cohortlab import staging

    monkeypatch.setattr(staging, "_made", [])
    kept = staging.stage(spark.range(5))
    assert kept.count() == 5 and staging.clear_folders(spark) == 1 and staging.clear_folders(spark) == 0


def test_wide_values_are_not_broadcast(spark, monkeypatch):
    from cohortlab import staging

    monkeypatch.setattr(staging, "SMALL_BYTES", 10_000)
    wide = spark.range(20).select("id", F.array_repeat(F.lit(1.5), 1_000).alias("v"))
    assert staging.small_table(wide)[1] is None
    assert staging.small_table(spark.range(20))[1].num_rows == 20


def test_inventory_of_many_folders(spark, tmp_path, monkeypatch):
    """Folders are listed level by level; hidden ones, other suffixes and empty folders do not appear."""
    monkeypatch.setattr(volumes, "FOLDERS_TOGETHER", 2)
    want = []
    for folder in ("", "a", "a/b c", "a/b c/é", "z", "z/deep/er", "_hidden", "a/.hidden"):
        os.makedirs(tmp_path / folder, exist_ok=True)
        for name in ("one.nii.gz", "t%o.nii.gz", "no.txt", "_x.nii.gz", ".y.nii.gz"):
            (tmp_path / folder / name).write_bytes(b"x" * (len(folder) + len(name)))
            if "hidden" not in folder and name[0] not in "_.n":
                want.append((name[:3], str(tmp_path / folder / name), len(folder) + len(name)))
    os.makedirs(tmp_path / "empty")
    got = volumes.file_inventory(spark, str(tmp_path), recursive=True)
    assert sorted((r.id, r.path, r.length) for r in got.collect()) == sorted(want)
    assert {r.path: r.place for r in volumes.numbered_paths(got).collect()} == {p: i for i, p in enumerate(sorted(p for _, p, _ in want), 1)}
    assert volumes.file_inventory(spark, f"file://{tmp_path}").count() == 2
    assert volumes.file_inventory(spark, str(tmp_path / "empty"), recursive=True).collect() == []
    with pytest.raises(FileNotFoundError):
        volumes.file_inventory(spark, str(tmp_path / "missing"))


def test_manifest_against_a_folder(spark, tmp_path):
    """What is there comes from the inventory of the folder itself."""
    for name in ("b", "c"):
        (tmp_path / f"{name}.nii.gz").write_bytes(b"1")
    asked = spark.createDataFrame([("a",), ("b",)], "id string")
    there = volumes.file_inventory(spark, str(tmp_path))
    assert sorted((r.id, r.status) for r in volumes.fetch_manifest(asked, there, "id", str(tmp_path)).collect()) == [("a", "fetch"), ("b", "present")]
