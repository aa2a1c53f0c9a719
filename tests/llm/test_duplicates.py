"""Near-duplicate and substring operators against plain versions."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from cohortlab.llm import embeddings, exchange, graph, near_duplicates, substrings, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 2**63 - 1
LOWER = {i: i + 32 for i in range(65, 91)}


def number(d):
    return LAST if d is None else d


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def shingle_set(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*[words[i:] for i in range(k)])) if len(words) >= k else frozenset([tuple(words)] if words else [])


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, texts, k):
    sets = [(number(d), shingle_set(t, k)) for d, t in texts]
    place = list(range(len(sets)))
    pairs = [(i, j) for i in place for j in place[:i] if sets[i][1] and
             100 * len(sets[i][1] & sets[j][1]) >= 80 * len(sets[i][1] | sets[j][1])]
    root = roots(pairs, place)
    least = {}
    for i in place:
        least[root[i]] = min(least.get(root[i], LAST), sets[i][0])
    want = sorted((d, len(s), least[root[i]] if s else d, d == (least[root[i]] if s else d)) for i, (d, s) in enumerate(sets))
    got = sorted((number(r.doc_id), r.n_shingles, number(r.component_id), r.kept) for r in near_duplicates.report(docs, k).collect())
    assert got == want


def family(n: int) -> list[str]:
    """Variants of one text that few others resemble enough, so that groups hang on single links."""
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(100)]
    out = []
    for _ in range(n):
        words = list(base)
        for at in rng.integers(0, 100, rng.integers(2, 10)):
            words[at] = f"v{rng.integers(0, 60)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("partitions", [2, 50])
def test_dense_family_loses_no_link(spark, partitions):
    members = family(3_000)
    sets = [shingle_set(t, 2) for t in members]
    number_of = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(sets), len(number_of)), np.float32)
    for i, s in enumerate(sets):
        has[i, [number_of[x] for x in s]] = 1
    both, size = has @ has.T, has.sum(1)
    near = 100 * both >= 80 * (size[:, None] + size[None] - both)
    root = roots([(int(i), int(j)) for i, j in zip(*np.nonzero(near)) if i < j], range(len(sets)))
    assert 100 < len(set(root.values())) < 2_900
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {r.doc_id: r.component_id for r in near_duplicates.report(
            spark.createDataFrame(list(enumerate(members)), "doc_id long, text string"), 2).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == root


def test_a_large_region_in_few_trees_opens_no_class(spark):
    """What one or two trees leave unseen at two values is made up by the others; more, or neighbours left out, open a class."""
    near = near_duplicates
    rng = np.random.default_rng(3)
    n = 3 * near.REACH
    sig = rng.integers(0, 2**32, (n, near.TREES, near.DEPTH), dtype=np.uint64).astype(">u4")
    sketch = [x.tobytes() for x in rng.integers(0, 256, (n, near.SKETCH)).astype(np.uint8)]
    for crowded, all_open in ((1, False), (2, False), (3, True)):
        sig[:, :crowded, :2] = 5
        labels = [sorted((sig[i, t].tobytes(), i) for i in range(n)) for t in range(near.TREES)]
        batches = [pa.RecordBatch.from_arrays(
            [pa.array([t] * n, pa.int32()), pa.array([x for x, _ in rows], pa.binary()), pa.array([i for _, i in rows]),
             pa.array([i for _, i in rows]), pa.array([sketch[i] for _, i in rows], pa.binary())],
            names=["tree", "label", "cls", "doc", "sketch"]) for t, rows in enumerate(labels)]
        found = pa.Table.from_batches(near._candidates(0.6)(iter(batches))).to_pandas().groupby(["a", "b", "tree"], as_index=False).max()
        opened = {r.cls for r in near._open(spark.createDataFrame(found), 0.8).collect()}
        # Some classes lie at the ends of the sorted rows or within reach of all of a region.
        assert len(opened) > n / 3 if all_open else len(opened) <= 2


def test_bound_on_shared_shingles_spares_no_link():
    rng = np.random.default_rng(4)
    sets = []
    for size in (1, 3, 40, 400, 90_000):
        base = rng.integers(0, 2**64, size, dtype=np.uint64)
        for change in (0, 0.05, 0.1, 0.15, 0.5, 1):
            sets.append(np.unique(np.where(rng.random(size) < change, rng.integers(0, 2**64, size, dtype=np.uint64), base)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "full"])
    cls, n, bins = next(near_duplicates._binned([batch])).columns
    assert not bins[len(sets) - 1].as_py() and bins[0].as_py()
    a, b = (np.array(x) for x in zip(*[(i, j) for i in range(len(sets)) for j in range(i)]))
    pairs = pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array(b), pa.array(a), pa.array(b), n.take(pa.array(a)), n.take(pa.array(b)), bins.take(pa.array(a)), bins.take(pa.array(b))],
        names=["a", "b", "ra", "rb", "n", "m", "x", "y"])
    kept = next(near_duplicates._bounded(80)([pairs]))
    kept = set(zip(kept.column("a").to_pylist(), kept.column("b").to_pylist()))
    links = {(i, j) for i, j in zip(a.tolist(), b.tolist())
             if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert links <= kept and len(links) < len(kept) < len(a) / 2


def test_keep_one_keeps_rows_and_columns(docs, texts):
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {0, 5, 6, 7, 8, 11, 12, 14, 17} <= set(ids) and not {1, 2, 3, 4, 9} & set(ids)
    assert ids.count(18) == 2


def cut_words(texts, n):
    first = {}
    rows = [(number(d), WORD.findall(t or "")) for d, t in texts]
    for d, w in rows:
        for i in range(len(w) - n + 1):
            first[tuple(w[i:i + n])] = min(d, first.get(tuple(w[i:i + n]), LAST))
    for d, w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i:i + n])] < d:
                gone[i:i + n] = [True] * n
        yield d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()


@pytest.mark.parametrize("window", [13, 9])
def test_substrings(docs, texts, window):
    got = sorted((number(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substrings.report(docs, window).collect())
    assert got == sorted(cut_words(texts, window))


def test_substrings_return_texts(docs):
    rows = {r.doc_id: r for r in substrings.remove(docs).collect()}
    assert rows[1].text == "" and rows[1].n_removed == 200 and rows[0].n_removed == 0


def cut_bytes(texts, n):
    first = {}
    rows = [(number(d), (t or "").encode()) for d, t in texts]
    for d, b in rows:
        for i in range(len(b) - n + 1):
            first[b[i:i + n]] = min(d, first.get(b[i:i + n], LAST))
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if first[b[i:i + n]] < d:
                gone[i:i + n] = b"\1" * n
        yield (d, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]),
               hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())


@pytest.mark.parametrize("common", [0, 10**9])
def test_suffixes_by_runs_and_by_common_grams(docs, texts, common, monkeypatch):
    monkeypatch.setattr(suffixes, "COMMON_BLOCKS", common)
    got = sorted((number(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.report(docs).collect())
    assert got == sorted(cut_bytes(texts, 50))


def test_merge_never_compares_known_prefixes(monkeypatch):
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 100, rng.integers(1, 30)).astype(np.uint8)) for _ in range(2_000)]
    runs = []
    for i in range(7):
        run, before = [], b""
        for w in sorted(words[i::7]):
            run.append((w, suffixes.common_prefix(before, w, 0)))
            before = w
        runs.append(run)
    asked = []
    plain = suffixes.common_prefix
    monkeypatch.setattr(suffixes, "common_prefix", lambda a, b, known: (asked.append(known), plain(a, b, known))[1])
    out = [(runs[r][i][0], n) for r, i, n in suffixes.merge([*runs, []])]
    assert [w for w, _ in out] == sorted(words)
    assert all(n == plain(a, b, 0) for (a, _), (b, n) in zip(out, out[1:]))
    assert sum(k > 0 for k in asked) > len(words) // 2


def test_asks_and_answers_agree_with_counts():
    docs, rks = np.array([1, 2, 3]), np.array([10, 20, 30])
    h = np.array([5, 5, 7, 9], np.uint64) << np.uint64(40)
    batch = exchange.asks(4, docs, rks, np.array([0, 2, 1, 1]), h, 8, smaller=True)
    told = [r for r in batch.to_pylist() if r["tell"]]
    assert len(told) == 1 and np.frombuffer(told[0]["rks"], np.int64).tolist() == [30]
    assert exchange.unpack(exchange.pack(h, 6), 6).tolist() == h.tolist()


def test_rows_of_one_id_in_a_block_all_ask(spark):
    """Two texts without an id in one block, a third copy of one of them, and the smaller document in another block."""
    h = np.full(3, 5, np.uint64) << np.uint64(40)
    blocks = [exchange.asks(4, np.array([LAST] * 3), np.array([10, 20, 20]), np.arange(3), h, 8, smaller=True),
              exchange.asks(4, np.array([5]), np.array([30]), np.arange(1), h[:1], 8, smaller=True)]
    rows = spark.createDataFrame([tuple(r.values()) for b in blocks for r in b.to_pylist()], exchange.ASKS)
    got = {r.rk: r.hashes for r in exchange.answer(rows, 8, smaller=True).collect()}
    assert {k: np.frombuffer(v, "<u8").tolist() for k, v in got.items()} == {10: [5 << 40], 20: [5 << 40]}


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 50)]
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == roots([p for p in pairs if p[0] != p[1]], nodes)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.12, np.repeat(base[:1], 30, 0), base[1] * rng.uniform(0.5, 2, (8, 1)),
                        rng.normal(size=(900, 16))])
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [None] + [1.0] * 15), (5004, [1.0, 2.0]), (5005, []),
           (None, rows[0][1]), (3, rows[3][1])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, cls int, vec string")
    every = [(number(i), v) for i, v in rows] + [(LAST, rows[0][1]), (3, rows[3][1])]
    unit = np.array([v for _, v in every])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    pairs = [(int(i), int(j)) for i, j in zip(*np.nonzero(near)) if i < j]
    root = roots(pairs, range(len(every)))
    least = {}
    for i, r in root.items():
        least[r] = min(least.get(r, LAST), every[i][0])
    want = sorted([(every[i][0], int(near[i].sum()) - 1, least[root[i]]) for i in root] + [(i, 0, i) for i in range(5000, 5006)])
    got = sorted((number(r.vec_id), r.n_links, number(r.component_id)) for r in embeddings.links(frame, margin=1.0).collect())
    assert got == want
    found = sum(r.n_links for r in embeddings.links(frame).collect())
    assert found >= 0.9 * sum(n for _, n, _ in want)


@pytest.mark.parametrize("width", [2, 3])
def test_embeddings_across_list_borders(spark, width):
    """Different vectors of low intrinsic dimension, where links cross borders of lists along the line between centroids."""
    rng = np.random.default_rng(11)
    x = np.zeros((700, 16))
    x[:, :width] = rng.normal(size=(700, width))
    x = x @ np.linalg.qr(rng.normal(size=(16, 16)))[0]
    frame = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = unit @ unit.T
    assert ((cosine >= 0.9) & (cosine < 0.93)).sum() > 5_000
    got = {r.vec_id: r.n_links for r in embeddings.links(frame).collect()}
    assert [got[i] for i in range(len(x))] == ((cosine >= 0.9).sum(1) - 1).tolist()


def test_embeddings_blocks_of_any_size(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(1, 8)), 120, 0) + rng.normal(size=(120, 8)) * 0.05
    frame = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, embeddings.links(frame, margin=1.0).collect()))
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 7)
    monkeypatch.setattr(embeddings, "QUERY_ROWS", 11)
    assert sorted(map(tuple, embeddings.links(frame, margin=1.0).collect())) == whole


def test_empty_tables(spark, nothing):
    for out in (near_duplicates.report(nothing), near_duplicates.keep_one(nothing), substrings.report(nothing), suffixes.report(nothing),
                embeddings.links(spark.createDataFrame([], "vec_id long, embedding array<float>"))):
        assert out.count() == 0
