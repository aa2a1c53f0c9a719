"""Mixing, encoding, LM scores and the pipeline."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlab.llm import lm_scores, mixing, pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def test_mix_meets_targets(docs, texts):
    rows = mixing.plan_mix(docs).collect()
    assert len(rows) == len(texts)
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size and 0 <= r.position <= 1
    assert list(by) and sum(r[0].target for r in by.values()) == pytest.approx(sum(r.size for r in rows))
    for own in by.values():
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
    assert sorted(map(tuple, mixing.plan_mix(docs.repartition(7)).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    assert [r.position for r in rows] == sorted(r.position for r in rows)


def test_targets_are_shared_again():
    assert mixing.targets([10, 100, 1000], [3.0, 2.0, 1.0]) == [30.0, 300.0, 780.0]
    assert mixing.targets([0, 5], [1.0, 1.0]) == [0.0, 5.0]
    assert mixing.targets([], []) == []


def test_positions_invert_demand(spark):
    frame = spark.createDataFrame([(i, "w " * 10, s) for i, s in enumerate(["a", "b"] * 200)], "doc_id long, text string, source string")
    knots = {0: [(0.0, 2.0), (0.5, 1.0), (1.0, 0.0)], 1: [(0.0, 0.0), (1.0, 2.0)]}
    rows = mixing.plan_mix(frame, lambda i: knots[i]).collect()
    for source, k in (("a", 0), ("b", 1)):
        own = sorted(r.position for r in rows if r.source == source)
        area = mixing.integral(knots[k])[-1]
        for i, t in enumerate(own):
            # Demand up to t, by the trapezium rule on a fine grid, is what stands before the document.
            grid = [t * j / 400 for j in range(401)]
            w = [next(w0 + (w1 - w0) * (x - t0) / (t1 - t0) for (t0, w0), (t1, w1) in zip(knots[k], knots[k][1:]) if x <= t1) for x in grid]
            done = sum((a + b) / 2 * t / 400 for a, b in zip(w, w[1:])) / area
            assert done == pytest.approx(min(1.0, i * 10 / rows[0].target if source == rows[0].source else i * 10 / next(r.target for r in rows if r.source == source)), abs=2e-3)


def test_mixed_documents(docs, nothing):
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and max(Counter(r.doc_id for r in out.collect() if r.doc_id not in (None, 18)).values()) <= 3
    assert mixing.plan_mix(nothing).count() == 0 and mixing.mix_documents(nothing).count() == 0


def test_copies_out_equal_copies_planned(spark):
    """300 equal rows, of which the mix cuts the second pass somewhere in the middle."""
    rows = [(7, "three words each", "a")] * 300 + [(8, "one", "b")] * 5 + [(i, f"w{i} " * (i % 9), "b" if i % 4 else "c") for i in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    plan = mixing.plan_mix(docs)
    per_copy = {(r.copies, r.doc_id == 7) for r in plan.collect()}
    assert len({c for c, alike in per_copy if alike}) == 2
    planned = {r.source: r.n for r in plan.groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    out = Counter(r.source for r in mixing.mix_documents(docs).collect())
    assert out == {k: v for k, v in planned.items() if v}


def test_encoding_matches_the_reference_library(docs, texts, nothing):
    other = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    out = pieces.encode(docs)
    want = sorted(((-1 if d is None else d), other.encode(t or "")) for d, t in texts)
    assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in out.collect()) == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in out.collect())
    back = {r.doc_id: r.text for r in pieces.decode(out).collect() if r.doc_id is not None and r.doc_id != 18}
    assert all(back[d] == (t or "") for d, t in texts if d in back)
    assert pieces.encode(nothing).count() == 0


def test_encoding_keeps_columns_and_replaces_its_own(docs):
    out = pieces.encode_documents(docs.withColumn("ids", docs.doc_id))
    assert out.columns == [*docs.columns, "n_tokens", "ids"] and out.count() == docs.count()


def test_differences_from_the_reference_library_raise():
    codec = pieces.Codec(open(pieces.MODEL, "rb").read())
    codec.piece = None
    codec.encode = lambda texts: [[0]] * len(texts)
    with pytest.raises(ValueError):
        codec.check(["abc"])


def test_unigram_models_are_rebuilt():
    model = pieces.Model([("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -2.0, 1), ("▁ab", -2.5, 1), ("▁", -4.0, 1), ("a", -3.0, 1)],
                         pieces.UNIGRAM, trim=True)
    assert pieces.tokenizer(model).encode(" ab  b ").tokens == ["▁ab", "▁", "b"]


def test_lm_base_scores(docs, texts, nothing):
    tokens = [(d, WORD.findall((t or "").translate(LOWER)) + [None]) for d, t in texts]

    def held(d):
        return d is not None and zlib.crc32(str(d).encode()) % 7 == 2

    count = Counter(x for d, w in tokens if not held(d) for x in w)
    n, v = sum(count.values()), len(count)
    want = sorted(((-1 if d is None else d), held(d), len(w), sum(count[x] > 0 for x in w), n,
                   round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 5)) for d, w in tokens)
    rows = lm_scores.score(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == want
    assert all(r.score < 0 for r in rows)
    # Texts that were trained on are likelier than others of their length.
    mean = {k: [r.score / r.n_tokens for r in rows if r.held_out == k and r.n_tokens > 30] for k in (True, False)}
    assert sum(mean[False]) / len(mean[False]) > sum(mean[True]) / len(mean[True])
    assert lm_scores.score(nothing).count() == 0


def test_filter_counts_are_quantised_and_rarely_wrong(docs, texts):
    from pyspark.sql import functions as F

    from cohortlab.llm.common import keyed
    from cohortlab.llm.textscan import Block
    import numpy as np
    import pyarrow as pa

    rows = keyed(docs, "doc_id", "text").withColumn("train", F.lit(True))
    model = lm_scores.learn(rows, 64)
    count = Counter(x for _, t in texts for x in WORD.findall((t or "").translate(LOWER)))
    words = list(count)
    h = Block(pa.array([" ".join(words)])).words(lower=True).hash
    got = model.count(h)
    true = np.array([count[w] for w in words])
    assert (got >= true / 2).all() and (got <= true * 2).mean() > 0.9
    strange = Block(pa.array([" ".join(f"zz{i}zz" for i in range(2000))])).words(lower=True).hash
    assert (model.count(strange) > 0).mean() < 0.1


def test_filter_grows_with_the_ngrams_counted(spark):
    """Different pairs by the hundred thousand, one in three bytes: unseen pairs stay as rare as in a small corpus."""
    import numpy as np
    from pyspark.sql import functions as F

    from cohortlab.llm.common import keyed

    rng = np.random.default_rng(4)
    signs = [a + b for a in "abcdefghijklmnopqrstuvwxyz0123456789" for b in "abcdefghijklmnopqrstuvwxyz0123456789"]
    rates = []
    for n in (20, 400):
        frame = spark.createDataFrame([(i, " ".join(signs[j] for j in rng.integers(0, len(signs), 1_000))) for i in range(n)], "doc_id long, text string")
        model = lm_scores.learn(keyed(frame, "doc_id", "text").withColumn("train", F.lit(True)), 64)
        strange = lm_scores.mix(rng.integers(0, 2**63, 20_000).astype(np.uint64))
        rates.append((model.count(strange) > 0).mean())
    assert max(rates) < 0.06


def test_pipeline_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        step(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns and 0 < docs.count() <= 3 * before
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert out.columns == [*columns, "n_tokens", "ids"] and out.count() == docs.count()
    assert "password=" not in " ".join(r.text for r in docs.select("text").collect())


def test_pipeline_on_odd_rows(spark, docs, nothing, tmp_path):
    """NULLs in any column, blanks, ties, repeated rows, a long text and clashing columns; and an empty table."""
    columns = docs.columns
    secret = spark.createDataFrame([(900, "our password = hunter22222 here", None, "a", 1, *["x"] * 5)], docs.schema)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for name, table in (("odd", docs.unionByName(secret)), ("none", nothing)):
        folder = tmp_path / name
        table.write.parquet(str(folder / "documents.parquet"))
        labels.write.parquet(str(folder / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(folder))
        assert out.columns == [*columns, "n_tokens", "ids"]
        rows = out.collect()
        if name == "none":
            assert rows == []
            continue
        known = {(r.doc_id, r.lang, r.source) for r in table.collect()}
        assert rows and {(r.doc_id, r.lang, r.source) for r in rows} <= known
        # One of each group of near copies: 0 to 4 are one, 14 and 15 as well; equal rows are one.
        taken = {r.doc_id for r in rows}
        assert not taken & {1, 2, 3, 4, 15} and all(r.n_tokens == len(r.ids) for r in rows)
        assert "hunter22222" not in " ".join(r.text or "" for r in rows)
