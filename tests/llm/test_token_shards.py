"""Token shards: the wavelet matrix against plain arrays, files against the tokenizers library."""

import zlib

import numpy as np
import pytest

from cohortlab.llm import token_shards as ts

tokenizers = pytest.importorskip("tokenizers")


@pytest.mark.parametrize("n, top, block", [(0, 1, 64), (1, 1, 64), (1_000, 1, 64), (5_000, 300, 64), (20_000, 70_000, 1_024), (3_000, 5, 2**16)])
def test_shard_answers_like_an_array(n, top, block):
    rng = np.random.default_rng(n + top)
    ids = (rng.zipf(1.3, n) % top).astype(np.uint32) * 7
    ends = np.unique(np.append(rng.integers(0, n + 1, 5), n))
    shard = ts.Shard(ts.build(ids, ends, np.arange(len(ends)), block), held=3)
    assert np.array_equal(shard.decode(), ids) and np.array_equal(shard.ends, ends) and shard.n_tokens == n
    for i in rng.integers(0, n, 30 if n else 0).tolist():
        assert shard.access(i) == ids[i]
    for token in {*ids[:20].tolist(), 0, 7, 3}:
        assert shard.count(token) == (ids == token).sum()
        assert np.array_equal(shard.occurrences(token), np.flatnonzero(ids == token))
        lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
        assert shard.count(token, lo, hi) == (ids[lo:hi] == token).sum()
        assert np.array_equal(shard.occurrences(token, lo, hi), lo + np.flatnonzero(ids[lo:hi] == token))
    with pytest.raises(IndexError):
        shard.access(n)


def test_planes_are_compressed():
    ids = (np.random.default_rng(1).zipf(1.5, 200_000) % 40_000).astype(np.uint32)
    assert len(ts.build(ids, np.array([len(ids)]), np.array([1]))) < len(ids) * 1.3


@pytest.fixture(scope="module")
def plain(texts):
    """Per document in order: id, ids of the whole text by the library, and the end id."""
    core = tokenizers.Tokenizer.from_file(ts.MODEL)
    rows = sorted(((ts.NO_ID if d is None else d), t or "") for d, t in texts)
    return [(d, core.encode(t, add_special_tokens=False).ids + [2]) for d, t in rows]


@pytest.fixture(scope="module")
def shards(docs):
    return ts.write_shards(docs, shard_tokens=500)


def test_files_hold_the_whole_texts(shards, plain):
    assert shards.count() > 5
    got = sorted(((ts.NO_ID if r.doc_id is None else r.doc_id), r.ids, r.start, r.n_tokens) for r in ts.read_documents(shards).collect())
    assert [(d, ids) for d, ids, *_ in got] == sorted(plain)
    at = 0
    for d, ids, start, n in sorted(got, key=lambda r: r[2]):
        assert (start, n) == (at, len(ids))
        at += n
    starts = [r[2] for r in got]
    assert [d for d, *_ in sorted(got, key=lambda r: r[2])] == [d for d, *_ in got] and len(set(starts)) == len(starts)


def test_checksums(shards, plain):
    got = sorted(((ts.NO_ID if r.doc_id is None else r.doc_id), r.n_tokens, r.ids_crc32) for r in ts.checksums(shards).collect())
    assert got == sorted((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in plain)


def test_counts_and_places_over_shards(shards, plain):
    everything = np.concatenate([i for _, i in sorted(plain)])
    assert dict(map(tuple, ts.count_tokens(shards, [2, 49405]).collect())) == {2: len(plain), 49405: (everything == 49405).sum()}
    token = int(np.bincount(everything[everything != 2]).argmax())
    got = ts.find_token(shards, token).collect()
    assert len(got) == (everything == token).sum()
    ids = {r.start: (r.doc_id, r.ids) for r in ts.read_documents(shards).collect()}
    for r in got[:200]:
        doc, tokens = ids[r["at"] - r.place]
        assert doc == r.doc_id and tokens[r.place] == token


def test_starts_do_not_depend_on_groups(spark, monkeypatch):
    monkeypatch.setattr(ts, "RANGES_TOGETHER", 3)
    rows = [(part, seq, "x", 1, part + seq + 1) for part in range(10) if part != 4 for seq in range(3)]
    got = {(r.part, r.seq): r.start for r in ts._starts(spark.createDataFrame(rows, ts.MANIFEST)).collect()}
    at = 0
    for part, seq, *_, n in sorted(rows):
        assert got[part, seq] == at
        at += n


def test_words_give_the_ids_of_whole_texts(texts):
    encoder = ts.Encoder(open(ts.MODEL, "rb").read(), 2)
    assert encoder.by_word
    odd = [t or "" for _, t in texts] + ["ÀÉ́각 ́a\ẗ", "x y z ​'S 'RE", "<|startoftext|>a <|end\noftext|>", "ſ İstanbul ﬀ"]
    assert encoder.agrees(odd)


def test_tokenizers_that_see_white_space_get_whole_texts(spark):
    """A byte-level model marks spaces: words alone would differ."""
    path = ts.MODEL.replace("word_bpe_49k", "byte_bpe_50k")
    core = tokenizers.Tokenizer.from_file(path)
    rows = [(1, "two  words and\nmore"), (2, None), (3, "")]
    got = ts.read_documents(ts.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), path=path)).collect()
    assert {r.doc_id: r.ids for r in got} == {d: core.encode(t or "", add_special_tokens=False).ids + [2] for d, t in rows}


def test_empty_table(nothing):
    shards = ts.write_shards(nothing)
    assert shards.count() == 0 and ts.checksums(shards).collect() == []
