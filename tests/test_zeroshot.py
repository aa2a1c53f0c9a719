import math
import random

import numpy as np
import pytest

from cohortlab.operators import zeroshot
from cohortlab.plans import zero_shot as plan
from cohortlab.staging import new_folder

FINDINGS = ["cyst", "edema", "ascites"]
WIDTH = 16


@pytest.fixture(scope="module")
def data():
    rng = random.Random(9)
    vector = lambda: [float(np.float32(rng.gauss(0, 1))) for _ in range(WIDTH)]
    images = [(f"s{i:03d}", vector()) for i in range(60)] + [("zero", [0.0] * WIDTH)]
    labels = [(s, *[rng.choice([0, 1, 1, -1, None]) for _ in FINDINGS]) for s, _ in images] + [("nobody", 1, 1, 1)]
    prompts = [(f, vector(), vector()) for f in FINDINGS]
    return images, labels, prompts


@pytest.fixture(scope="module")
def frames(spark, data):
    images, labels, prompts = data
    return (
        spark.createDataFrame(images + [("blind", None)], "study_id string, embedding array<float>").repartition(4),
        spark.createDataFrame(labels, "study_id string, " + ", ".join(f"{f} int" for f in FINDINGS)),
        spark.createDataFrame(prompts, "finding string, present array<float>, absent array<float>"),
    )


def by_hand(data):
    images, labels, prompts = data
    vectors = {s: np.array(v) for s, v in images}

    def similarity(a, b):
        return float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-8))

    out = {}
    for s, *states in labels:
        for f, y in zip(FINDINGS, states):
            if y in (0, 1) and s in vectors:
                present, absent = next((np.array(p), np.array(a)) for g, p, a in prompts if g == f)
                gap = similarity(vectors[s], absent) - similarity(vectors[s], present)
                out[f, s] = (y, 1 / (1 + math.exp(gap)))
    return out


@pytest.mark.parametrize("matrix", [True, False])
def test_scores_match_by_hand(data, frames, monkeypatch, matrix):
    if not matrix:
        monkeypatch.setattr(zeroshot, "MATRIX_FINDINGS", 1)
    out = zeroshot.zero_shot_scores(*frames, FINDINGS + FINDINGS[:1], "study_id", strict=False).collect()
    got = {(r.finding, r.study_id): (r.y_true, r.y_score) for r in out}
    want = by_hand(data)
    assert got.keys() == want.keys() and len(out) == len(got)
    for k, (y, score) in want.items():
        assert got[k][0] == y and got[k][1] == pytest.approx(score, abs=1e-12)
    assert {v[1] for k, v in got.items() if k[1] == "zero"} <= {0.5}


def test_finding_without_prompts_raises(frames):
    with pytest.raises(ValueError, match="without prompts"):
        zeroshot.zero_shot_scores(frames[0], frames[1], frames[2].filter("finding <> 'cyst'"), FINDINGS, "study_id")


def test_images_that_cannot_be_scored_raise_or_are_listed(spark):
    images = spark.createDataFrame([("a", [1.0]), ("b", None), ("c", [2.0]), ("d", [3.0])], "study_id string, embedding array<float>")
    labels = spark.createDataFrame([("a", 1), ("b", 0), ("d", None)], "study_id string, cyst int")
    prompts = spark.createDataFrame([("cyst", [1.0], [2.0])], "finding string, present array<float>, absent array<float>")
    gaps = zeroshot.scoring_gaps(images, labels, ["cyst"], "study_id").collect()
    assert sorted(map(tuple, gaps)) == [("b", None, "no vector"), ("c", None, "no label row"), ("d", "cyst", "no label")]
    assert [r.study_id for r in zeroshot.zero_shot_scores(images, labels, prompts, ["cyst"], "study_id", strict=False).collect()] == ["a"]
    with pytest.raises(Exception, match="no label row for c|no vector for b|no label for d"):
        zeroshot.zero_shot_scores(images, labels, prompts, ["cyst"], "study_id").collect()


def test_prompt_tables(spark):
    flat = zeroshot.flatten_prompts(spark, {"cyst": ("a cyst is present", "no cyst"), "air": ("air", "no air")})
    assert sorted(map(tuple, flat.collect())) == [
        ("air", "absent", "no air"), ("air", "present", "air"),
        ("cyst", "absent", "no cyst"), ("cyst", "present", "a cyst is present")]
    rows = spark.createDataFrame(
        [("cyst", "present", [1.0]), ("cyst", "absent", [2.0])], "finding string, polarity string, embedding array<float>")
    assert [tuple(r) for r in zeroshot.pair_prompts(rows).collect()] == [("cyst", [1.0], [2.0])]


def test_latest_embedding(spark):
    df = spark.createDataFrame([("a", [1.0], 1), ("a", [2.0], 3), ("a", [3.0], 2), ("b", [4.0], 1)],
                               "k string, e array<float>, t int")
    assert sorted((r.k, r.e) for r in zeroshot.latest_embedding(df, "k", "e", "t").collect()) == [("a", [2.0]), ("b", [4.0])]


def test_results_file_and_report(spark, frames):
    path = new_folder(spark, "results")
    plan.score_to_results(*frames, FINDINGS, "study_id", path, strict=False)
    report, macro = plan.report_results(spark, path)
    direct = {r.finding: tuple(r)[1:] for r in plan.evaluate(*frames, FINDINGS, "study_id", strict=False).collect()}
    assert {r.finding: pytest.approx(tuple(r)[1:]) for r in report.collect()} == direct
    assert macro.first().n_groups == 3


def test_images_are_read_once_for_all_blocks(spark, data, frames, monkeypatch):
    """Blocks of one finding, few images at a time, and a single scan of the images."""
    monkeypatch.setattr(zeroshot, "ROWS_TOGETHER", 7)
    images, labels, prompts = frames
    out = zeroshot.zero_shot_scores(images.repartition(2), labels, prompts, FINDINGS, "study_id", strict=False, matrix_findings=1)
    assert out._jdf.queryExecution().analyzed().toString().count("embedding#") <= 4
    got = {(r.finding, r.study_id): (r.y_true, round(r.y_score, 9)) for r in out.collect()}
    assert got == {k: (y, round(s, 9)) for k, (y, s) in by_hand(data).items()}
