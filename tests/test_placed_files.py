"""Files that many tasks write and read at once: split files, one JSON document."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cohortlab.operators.running import numbered, running_sums
from cohortlab.plans import matched_splits as ms
from cohortlab.sources import id_lists, json_ranges, placed, results


def files(folder):
    return {f: (folder / f).read_text(encoding="utf-8") for f in os.listdir(folder)}


@pytest.mark.parametrize("range_rows", [7, 1_000_000])
def test_split_files_have_their_names_and_all_ids(spark, tmp_path, range_rows):
    """A split that holds nearly all ids, small ones, repeated and odd ids, and an empty one."""
    rows = [("train_pos", f"s{i:04d}") for i in range(900)] + [("test neg é", "ü1"), ("test neg é", "a b"), ("test neg é", None)] + [("x", "same")] * 5
    df = spark.createDataFrame(rows, "split string, id string").repartition(5)
    (tmp_path / "kept.txt").write_text("k\n")
    (tmp_path / "x.txt").write_text("a longer text that is replaced\n" * 9)
    id_lists.write_split_files(df, f"file://{tmp_path}", ["train_neg"], range_rows)
    want = {"train_pos.txt": "".join(f"s{i:04d}\n" for i in range(900)), "test neg é.txt": "\na b\nü1\n", "x.txt": "same\n" * 5,
            "train_neg.txt": "", "kept.txt": "k\n"}
    assert files(tmp_path) == want
    got = id_lists.read_split_files(spark, str(tmp_path)).groupBy("split").count()
    assert {(r["split"], r["count"]) for r in got.collect()} == {("train_pos", 900), ("test neg é", 2), ("x", 5), ("kept", 1)}


def test_a_large_split_is_written_by_many_tasks(spark, tmp_path):
    ids = spark.range(1_000).select(F.lit("one").alias("file"), F.concat(F.col("id").cast("string"), F.lit("\n")).alias("value"))
    rows, totals = running_sums(ids, ["file"], ["value"], {"at": F.octet_length("value").cast("bigint")}, 50)
    assert rows.groupBy("_part" if "_part" in rows.columns else F.spark_partition_id()).count().count() > 1
    assert [r["at"] for r in totals.collect()] == [sum(len(str(i)) + 1 for i in range(1_000))]


@pytest.mark.parametrize("name", ["", "a/b", ".hidden", None])
def test_names_that_are_no_files_raise(spark, tmp_path, name):
    df = spark.createDataFrame([(1, "x")], "at long, value string").withColumn("file", F.lit(name).cast("string"))
    with pytest.raises(ValueError, match="not a file name"):
        placed.write_placed(df, {name: 1}, str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    """Neither a task that fails nor bytes that are missing change the folder."""
    (tmp_path / "f").write_text("old")
    good = spark.createDataFrame([("f", 0, "ab"), ("f", 2, "cd")], "file string, at long, value string").repartition(2)
    broken = good.withColumn("value", F.when(F.col("at") == 2, F.raise_error(F.lit("broken row")).cast("string")).otherwise(F.col("value")))
    for rows, sizes, message in ((broken, {"f": 4}, "broken row"), (good, {"f": 5}, "4 of 5 bytes")):
        with pytest.raises(Exception, match=message):
            placed.write_placed(rows, sizes, str(tmp_path))
        assert files(tmp_path) == {"f": "old"}
    placed.write_placed(good, {"f": 4}, str(tmp_path))
    assert files(tmp_path) == {"f": "abcd"}


def test_stores_without_places_get_streams(tmp_path):
    """The writer for such stores, on rows as one task gets them."""
    import pyarrow as pa

    writer = placed.PlacedWriter({"path": str(tmp_path), "token": "t", "size": "8"})
    writer.seek = False
    os.mkdir(tmp_path / ".placed-t")
    batches = [pa.record_batch({"file": f, "at": pa.array(a, pa.int64()), "value": v}) for f, a, v in (
        (["a", "a"], [0, 2], ["xy", "é"]), (["a", "b"], [4, 0], ["z", "123"]))]
    message = writer.write(iter(batches))
    writer.commit([message, None])
    assert files(tmp_path) == {"a": "xyéz", "b": "123"}
    os.mkdir(tmp_path / ".placed-t")
    with pytest.raises(ValueError, match="missing"):
        writer.write(iter([batches[1]]))


def test_splits_of_a_job_as_flat_files(spark, tmp_path):
    scans = spark.createDataFrame([(f"S{i}", i, int(i % 3 == 0), "ab"[i % 2]) for i in range(1, 200)], "id string, n int, flag int, phase string")
    columns = ms.ScanColumns(id="id", id_num="n", flag="flag", stratum="phase")
    splits = ms.build_splits(scans, columns, {"train": (1, 150), "test": (151, 199)}, {"train": 20, "test": 0}, output=str(tmp_path), flat=True)
    ms.build_train_subsamples(scans, splits, columns, [(12, 42)], output=str(tmp_path), flat=True)
    assert sorted(files(tmp_path)) == ["test_neg.txt", "test_pos.txt", "train_neg.txt", "train_pos.txt", "train_sample_12_neg.txt", "train_sample_12_pos.txt"]
    want = sorted((r.split, r.id) for r in splits.collect())
    got = id_lists.read_split_files(spark, str(tmp_path)).filter("split NOT LIKE '%sample%'").collect()
    assert sorted((r.split, r.id) for r in got) == want and files(tmp_path)["test_neg.txt"] == ""


ODD = 'a "quoted" \\ back\\\\slash\nline, {brace} [é日\U0001F600]'


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(f"f{i % 3}", f"s{i:03d}", i % 2, i / 7) for i in range(200)] + [("only one", "x", 1, 0.5), (ODD, ODD, None, 0.25), (ODD, None, 0, None)]
    rows += [("f1", "copy", 1, 0.5)] * 20
    return rows, spark.createDataFrame(rows, "finding string, study_id string, y_true int, y_score double").repartition(3)


@pytest.mark.parametrize("range_rows, chunk_bytes", [(1_000_000, 32_000_000), (9, 61)])
def test_document_of_many_tasks(spark, tmp_path, scored, range_rows, chunk_bytes):
    """The document is what a plain writer gives, and comes back whole from chunks that cut strings and escapes."""
    rows, df = scored
    path = str(tmp_path / "results.json")
    results.write_document(df, path, range_rows=range_rows)
    want = {}
    for finding, *row in sorted(rows, key=lambda r: (r[0], r[1] or "", r[2] or 0)):
        for name, value in zip(("study_id", "y_true", "y_score"), row):
            want.setdefault(finding, {"study_id": [], "y_true": [], "y_score": []})[name].append(value)
    with open(path, encoding="utf-8") as f:
        assert json.load(f) == want
    assert list(want) == sorted(want) and os.listdir(tmp_path) == ["results.json"]
    got = results.read_results(spark, path, one_document=True, chunk_bytes=chunk_bytes)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)


def test_document_without_rows(spark, tmp_path, scored):
    path = str(tmp_path / "none.json")
    results.write_document(scored[1].limit(0), path)
    assert json.load(open(path)) == {} and results.read_results(spark, path, one_document=True).collect() == []


ENTRY = '{"study_id": ["a\\\\"], "y_true": [1], "y_score": [0.5]}'


@pytest.mark.parametrize("text", ['{"a": ' + ENTRY, '{"a": ' + ENTRY + "}}", "[1]", '{"a": ' + ENTRY + ',}', '{"a": ' + ENTRY + '} x', '{"a": "x}', "17",
                                  '{"a": ' + ENTRY + '} {"b": ' + ENTRY + "}", '{"a": ' + ENTRY + ' "b": ' + ENTRY + "}"])
def test_files_that_are_no_object_raise(spark, tmp_path, text):
    path = tmp_path / "broken.json"
    path.write_text(text)
    for chunk in (5, 1_000):
        with pytest.raises(Exception, match="MALFORMED"):
            results.read_results(spark, str(path), one_document=True, chunk_bytes=chunk).collect()


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1_000])
def test_entries_at_any_cut(spark, tmp_path, chunk):
    path = tmp_path / "x.json"
    path.write_text(' {"k\\\\": ' + ENTRY + ',\n "\\"q,{": ' + ENTRY + ' }\n ', encoding="utf-8")
    got = sorted(r.value for r in json_ranges.object_entries(spark, str(path), chunk).collect())
    assert sorted(k for x in got for k in json.loads(x)) == ['"q,{', "k\\"]


@pytest.mark.parametrize("chunk_bytes, block_bytes", [(61, 7), (1_000, 100), (32_000_000, 1_000_000)])
def test_long_entries_come_in_pieces(spark, tmp_path, scored, monkeypatch, chunk_bytes, block_bytes):
    """No text of a long entry is more than a piece, whatever its strings hold, and together they are the whole document."""
    monkeypatch.setattr(json_ranges, "PIECE_ROWS", 10)
    monkeypatch.setattr(json_ranges, "BLOCK_BYTES", block_bytes)
    rows, df = scored
    path = str(tmp_path / "results.json")
    results.write_document(df, path)
    got = results.read_results(spark, path, one_document=True, chunk_bytes=chunk_bytes, long_bytes=100)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)
    texts = [r.value for r in json_ranges.object_entries(spark, path, chunk_bytes, 100).collect()]
    assert len(texts) >= 20 and max(len(a) for x in texts for d in json.loads(x).values() for a in d.values()) == 10


@pytest.mark.parametrize("arrays, error", [
    ('"study_id": ["a", "b", "c"], "y_true": [1, 0], "y_score": [1, 2, 3]', "unequal"), ('"study_id": ["a", "b"], "y_true": [1, 0]', "unequal"),
    ('"study_id": ["a", "b"], "y_true": null, "y_score": [1, 2]', "unequal"), ('"study_id": ["a", "b",], "y_true": [1, 0], "y_score": [1, 2]', "MALFORMED"),
    ('"study_id": ["a", "b"], "y_true": [1, 0] "y_score": [1, 2]', "MALFORMED"), ('"study_id": ["a", "b"], "y_true": [1, x], "y_score": [1, 2]', "MALFORMED")])
def test_broken_long_entries_raise(spark, tmp_path, monkeypatch, arrays, error):
    monkeypatch.setattr(json_ranges, "PIECE_ROWS", 2)
    (tmp_path / "broken.json").write_text('{"f": {' + arrays + "}}")
    with pytest.raises(Exception, match=error):
        results.read_results(spark, str(tmp_path / "broken.json"), one_document=True, chunk_bytes=9, long_bytes=5).collect()


def test_long_entries_of_other_forms(spark, tmp_path, monkeypatch):
    """Fields in any order, objects beside them, and empty arrays."""
    monkeypatch.setattr(json_ranges, "PIECE_ROWS", 2)
    (tmp_path / "x.json").write_text('{"\\"f,": {"more": {"a": [1, 2], "b": {"c": 1}}, "y_score": [1,\n2, 3 ], "study_id": ["a", "]", "\\"c,"], "y_true": [1, 0, null]},'
                                     ' "g": {"study_id": [ ], "y_true": [], "y_score": []}, "h": {"study_id": ["x"], "y_true": [1], "y_score": [0.5]}}')
    for long_bytes in (5, 60, 1_000):
        got = results.read_results(spark, str(tmp_path / "x.json"), one_document=True, chunk_bytes=13, long_bytes=long_bytes)
        assert sorted(map(tuple, got.collect())) == [('"f,', '"c,', None, 3.0), ('"f,', "]", 0, 2.0), ('"f,', "a", 1, 1.0), ("h", "x", 1, 0.5)]


def test_folder_of_documents(spark, tmp_path, scored):
    for name in ("a.json", "b.json", "_SUCCESS"):
        (tmp_path / name).write_text("" if name[0] == "_" else '{"f": ' + ENTRY + "}")
    assert results.read_results(spark, str(tmp_path), one_document=True).count() == 2


@pytest.mark.parametrize("range_rows", [3, 1_000])
def test_running_sums_equal_plain_ones(spark, range_rows):
    rows = [("g" if i % 5 else None, i * 37 % 101, i) for i in range(60)] + [("h", 1, 9)] * 8
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(4)
    out, totals = running_sums(df, ["g"], ["o"], {"s": F.col("v"), "n": F.lit(1)}, range_rows)
    seen = {}
    for g, o, v, s, n in sorted(map(tuple, out.collect()), key=lambda r: (r[0] or "", r[1], r[4])):
        assert (s, n) == seen.get(g, (0, 0))
        seen[g] = (s + v, n + 1)
    assert {r["g"]: (r["s"], r["n"]) for r in totals.collect()} == seen
    assert sorted(r.place for r in numbered(df, ["o"]).collect()) == list(range(1, len(rows) + 1))


def test_stores_that_only_spark_opens(spark, tmp_path, scored, monkeypatch):
    """Documents and inventories then come through Spark's own readers."""
    from cohortlab.sources import volumes

    assert placed.openable(str(tmp_path)) and placed.openable(f"file://{tmp_path}") and not placed.openable("viewfs://cluster/x")
    (tmp_path / "a.json").write_text('{"f": ' + ENTRY + "}")
    for module in (results, volumes):
        monkeypatch.setattr(module, "openable", lambda path: False)
    assert [r.finding for r in results.read_results(spark, str(tmp_path / "a.json"), one_document=True).collect()] == ["f"]
    assert [r.id for r in volumes.file_inventory(spark, str(tmp_path), ".json").collect()] == ["a"]
