import math
import warnings

import pytest
from pyspark.sql import functions as F

from cohortlab.functions import numeric, predicates, text, vectors
from cohortlab.functions.missing import normalise_missing
from cohortlab.functions.resolve import ColumnIndex, present_columns


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("given, want", [
    ("12", 12.0), (" 12 ", 12.0), ("-1.5e2", -150.0), (".5", 0.5), ("5.", 5.0), ("+3", 3.0),
    ("12d", None), ("045Y", None), ("", None), ("nan", None), ("1 2", None), ("abc", None), (None, None),
    ("inf", math.inf), ("-Infinity", -math.inf),
])
def test_to_number(spark, given, want):
    assert one(spark, numeric.to_number(F.lit(given).cast("string"))) == want


@pytest.mark.parametrize("given, want", [(0.5, 0.0), (1.5, 2.0), (2.5, 2.0), (-0.5, 0.0), (2.4, 2.0)])
def test_half_even(spark, given, want):
    assert one(spark, numeric.half_even(F.lit(given))) == want


def test_half_even_digits_and_percentages(spark):
    assert one(spark, numeric.half_even(F.lit(0.125), 2)) == 0.12
    assert one(spark, numeric.percentage(F.lit(1), F.lit(4))) == 25.0
    assert one(spark, numeric.percentage(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, numeric.at_least(F.lit(0.5))) == 1
    assert one(spark, text.percent_bar(F.lit(7.9))) == "███"
    assert one(spark, text.percent_bar(F.lit(1.9))) == ""


@pytest.mark.parametrize("given, want", [
    ("  a b\t\n", "a b"), (" x ", "x"), ("\x1cy\x1f", "y"), ("", ""), (" \t ", ""), ("z", "z"),
])
def test_strip_and_blank(spark, given, want):
    assert one(spark, text.strip(F.lit(given))) == want
    assert one(spark, text.non_blank(F.lit(given))) == (want != "")


def test_id_number(spark):
    assert one(spark, text.id_number(F.lit("SCAN_00000123_4"))) == 123
    with pytest.raises(Exception, match="id without digits"):
        one(spark, text.id_number(F.lit("none")))
    with pytest.raises(Exception, match="id without digits"):
        one(spark, text.id_number(F.lit(None).cast("string")))


def test_split_names(spark):
    name = F.lit("train_sample_350_pos")
    assert one(spark, text.split_kind(name)) == "train"
    assert one(spark, text.split_label(name)) == "pos"
    assert one(spark, text.split_stem(name)) == "train_sample_350"


def test_missing_operands_are_false_in_filters(spark):
    df = spark.createDataFrame([(1, 1, None), (1, None, 2), (1, None, None), (None, 1, 1), (2, 0, 0)], "a int, b int, c int")
    kept = df.filter(predicates.with_any_other("a", ["b", "c"]))
    assert sorted(kept.collect(), key=str) == sorted([(1, 1, None), (1, None, 2)], key=str)
    flags = [r[0] for r in df.select(predicates.definite(predicates.with_any_other("a", ["b", "c"]))).collect()]
    assert flags == [True, True, False, False, False]
    assert [r[0] for r in df.select(predicates.definite(predicates.all_above_zero(["a", "b"]))).collect()] == \
        [True, False, False, False, False]


def test_names_with_odd_characters(spark):
    df = spark.createDataFrame([(1, 0.5), (0, -2.0), (None, None)], ["tumor?", "ct `phase`"])
    assert df.filter(predicates.positive_count("tumor?")).count() == 1
    assert df.filter(predicates.nonzero("ct `phase`")).count() == 2


def test_strict_flag_raises(spark):
    df = spark.createDataFrame([(1,), (None,)], "flag int")
    assert df.filter(predicates.flag_value("flag") >= 1).count() == 1
    with pytest.raises(Exception, match="missing value in flag"):
        df.filter(predicates.flag_value("flag", strict=True) >= 1).collect()


def test_normalise_missing(spark):
    df = spark.createDataFrame([("NA", float("nan")), ("x", 1.0), ("null", 2.0), ("", None)], "s string, d double")
    assert [tuple(r) for r in normalise_missing(df).collect()] == [(None, None), ("x", 1.0), (None, 2.0), (None, None)]


def test_range_name(spark):
    df = spark.createDataFrame([(0,), (1,), (9000,), (9001,), (9901,), (9902,)], "n int")
    ranges = {"train": (1, 9000), "test": (9001, 9901)}
    names = [r[0] for r in df.select(predicates.range_name(F.col("n"), ranges)).collect()]
    assert names == [None, "train", "train", "test", "test", None]


def test_resolve_columns():
    columns = ["id", "Largest LIVER lesion attenuation", "liver attenuation (old)", "kidney exact"]
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        got = ColumnIndex(columns).resolve(
            {"Liver": "no such", "Kidney": "kidney exact", "Pancreas": "nope", "largest": "-"}, "attenuation")
        present, absent = present_columns(columns, ["id", "gone"])
    assert got.found == {"Kidney": "kidney exact", "largest": "Largest LIVER lesion attenuation"}
    assert got.ambiguous == {"Liver": ["Largest LIVER lesion attenuation", "liver attenuation (old)"]} and got.missing == ["Pancreas"]
    assert present == ["id"] and absent == ["gone"] and len(caught) == 1


def test_first_of_several_columns_with_one_warning():
    columns = ["id", "Largest LIVER lesion attenuation", "liver attenuation (old)", "kidney attenuation", "kidney attenuation 2"]
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        got = ColumnIndex(columns).resolve({"Liver": "no such", "Kidney": "-", "Pancreas": "nope"}, "attenuation", first=True)
    assert got.found == {"Liver": "Largest LIVER lesion attenuation", "Kidney": "kidney attenuation"}
    assert got.missing == ["Pancreas"] and not got.ambiguous
    assert len(caught) == 1 and "Liver: took Largest LIVER lesion attenuation of" in str(caught[0].message)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 2.0])], "a array<float>, b array<float>")
    values = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert values[0] == pytest.approx(1 / math.sqrt(2)) and values[1] == 0.0
    assert one(spark, vectors.two_way_softmax(F.lit(1.0), F.lit(-1.0))) == pytest.approx(math.e / (math.e + 1 / math.e))
