import random

import pytest

from cohortlab.operators import metrics


def scored_rows(kind):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        finding = "hot" if i % 3 else f"f{i % 4}"
        score = rng.choice([0.1, 0.5, 0.7]) if kind == "tied" else rng.random()
        rows.append((finding, int(rng.random() < 0.3 + 0.3 * score), score))
    # A third of all rows share one score; one group has a single class.
    rows += [("hot", i % 2, 0.42) for i in range(700)] + [("single", 1, 0.9), ("single", 1, 0.1)]
    return rows


def area(rows):
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def groups_of(rows):
    groups = {}
    for f, y, s in rows:
        groups.setdefault(f, []).append((y, s))
    return groups


@pytest.mark.parametrize("kind", ["tied", "free"])
@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 200, 11])
def test_report_matches_pair_counting(spark, kind, rows_per_bucket):
    rows = scored_rows(kind)
    df = spark.createDataFrame(rows, "finding string, y_true int, y_score double").repartition(6)
    report = {r.finding: r for r in metrics.evaluation_report(df, "finding", rows_per_bucket=rows_per_bucket).collect()}
    confusion = {r.finding: r for r in metrics.confusion_metrics(df, "finding").collect()}
    groups = groups_of(rows)
    assert report.keys() == groups.keys() == confusion.keys()
    for f, pairs in groups.items():
        tp = sum(y == 1 and s >= 0.5 for y, s in pairs)
        fp = sum(y == 0 and s >= 0.5 for y, s in pairs)
        fn = sum(y == 1 and s < 0.5 for y, s in pairs)
        precision, recall = tp / (tp + fp) if tp + fp else 0, tp / (tp + fn) if tp + fn else 0
        f1 = 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0
        r, want = report[f], area(pairs)
        assert (r.n, r.n_positive) == (len(pairs), tp + fn)
        assert r.auroc is None if want is None else r.auroc == pytest.approx(want)
        assert (r.precision, r.recall, r.f1) == pytest.approx((precision, recall, f1))
        c = confusion[f]
        assert (c.tp, c.fp, c.fn, c.tn) == (tp, fp, fn, len(pairs) - tp - fp - fn)
        assert (c.precision, c.recall, c.f1) == pytest.approx((precision, recall, f1))


def test_macro_average_leaves_out_single_class_groups(spark):
    df = spark.createDataFrame(
        [("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.2), ("b", 0, 0.8), ("c", 1, 0.9)],
        "finding string, y_true int, y_score double")
    r = metrics.macro_average(metrics.evaluation_report(df, "finding")).first()
    assert tuple(r) == (2, 0.5, 0.5, 0.5, 0.5)


def test_zero_division_is_zero(spark):
    df = spark.createDataFrame([("a", 0, 0.1), ("a", 0, 0.2)], "finding string, y_true int, y_score double")
    r = metrics.confusion_metrics(df, "finding").first()
    assert (r.precision, r.recall, r.f1, r.tn) == (0.0, 0.0, 0.0, 2)
