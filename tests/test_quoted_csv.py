"""CSV records over many blocks, against the csv module and Spark's own reader in one task."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from cohortlab.sources import metadata, quoted_csv


@pytest.fixture
def small_blocks(spark):
    """Files are cut into blocks of so many bytes."""
    names = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": None}
    for name in names:
        names[name] = spark.conf.get(name)

    def cut(size: int):
        for name in names:
            spark.conf.set(name, str(size))

    yield cut
    for name, value in names.items():
        spark.conf.set(name, value)


def write(path, rows, end="\n"):
    with open(path, "w", encoding="utf-8", newline="") as f:
        csv.writer(f, lineterminator=end).writerows(rows)


def some_rows(seed, n):
    rng = random.Random(seed)
    notes = ["plain", 'a "quoted" word', "two\nlines", "many\n\n\nlines, with \"commas\",\n\"and\" quotes", '"', '""', ",", "\n", "é日\n\U0001F600", "x" * 300,
             "\n".join(["long"] * 60), '",\n"', "5\" disc", "tab\there"]
    return [[f"S{i:04d}", rng.choice(notes), str(i % 7), rng.choice(notes)] for i in range(n)]


@pytest.mark.parametrize("size", [37, 400, 5_000, 10_000_000])
def test_blocks_of_any_size(spark, tmp_path, small_blocks, size):
    head, rows = ["scan id", "a\nnote", "n", "b,note"], some_rows(1, 150 if size > 100 else 12)
    write(tmp_path / "x.csv", [head, *rows])
    small_blocks(size)
    df = metadata.read_metadata(spark, str(tmp_path / "x.csv"), multi_line=True)
    assert df.columns == head
    if size < 10_000:
        assert spark.read.text(str(tmp_path / "x.csv")).rdd.getNumPartitions() > 1
    assert sorted(map(list, df.collect())) == sorted(rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_several_files_and_line_ends(spark, tmp_path, small_blocks, end):
    want = []
    for i in range(4):
        rows = some_rows(10 + i, 30 * i)
        write(tmp_path / f"part-{i}.csv", [["id", "a", "n", "b"], *rows], end)
        want += rows
    small_blocks(700)
    got = metadata.read_metadata(spark, str(tmp_path), multi_line=True).collect()
    assert sorted(map(list, got)) == sorted(want)


def test_blocks_that_are_joined_by_shuffle(spark, tmp_path, small_blocks, monkeypatch):
    from cohortlab import staging

    rows = some_rows(3, 120)
    write(tmp_path / "x.csv", [["id", "a", "n", "b"], *rows])
    small_blocks(300)
    monkeypatch.setattr(quoted_csv, "small_table", lambda df: (staging.stage(df), None))
    got = metadata.read_metadata(spark, str(tmp_path / "x.csv"), multi_line=True).collect()
    assert sorted(map(list, got)) == sorted(rows)


def test_equals_the_reader_of_whole_files(spark, tmp_path, small_blocks):
    """Also where quotes stand inside plain fields, rows are short or long, and lines are blank."""
    text = 'id,note,n\n1,5" disc,2\n\n2,"a ""b""\nc",3\n3,a"b"c,4\n4\n5,"x",6,7\n6,"",\n"7","""quoted""\n",1\n8,ab"\n9,last,0'
    path = tmp_path / "x.csv"
    path.write_text(text)
    want = spark.read.options(header=True, multiLine=True, escape='"').csv(str(path)).collect()
    for size in (11, 60, 1_000):
        small_blocks(size)
        got = quoted_csv.read_quoted(spark, str(path), ["id", "note", "n"], {"escape": '"'}).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def test_a_quote_that_is_never_closed(spark, tmp_path, small_blocks):
    path = tmp_path / "x.csv"
    path.write_text('id,note\n1,a\n2,"open\n' + "more\n" * 50)
    small_blocks(40)
    got = metadata.read_metadata(spark, str(path), multi_line=True).collect()
    assert [r.id for r in got] == ["1", "2"] and got[1].note.startswith("open\nmore")
    with pytest.raises(Exception, match="not closed"):
        quoted_csv.records(spark, str(path), max_record=20).collect()


def test_header_alone_and_nothing(spark, tmp_path):
    (tmp_path / "h.csv").write_text("id,note\n")
    assert metadata.read_metadata(spark, str(tmp_path / "h.csv"), multi_line=True).collect() == []
    (tmp_path / "e.csv").write_text("")
    assert metadata.read_metadata(spark, str(tmp_path / "e.csv"), multi_line=True).collect() == []


@pytest.mark.parametrize("line, inside, want", [
    ("", False, False), ("", True, True), ('a,"b', False, True), ('a,"b"', False, False), ('a"b', False, False), ('b",c', True, False),
    ('b"",c', True, True), ('b""",c', True, False), ('"', False, True), ('""', False, False), ('"""', False, True), ('x"y","z', True, True), ('a, "b', False, False)])
def test_open_after(line, inside, want):
    assert quoted_csv.open_after(line, inside) is want
