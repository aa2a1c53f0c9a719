"""Prefix tries against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cohortlab.llm import prefix_tries as pt

SCHEMA = "conv_id long, turn long, role string, text string, c string, pos string, shard string, depth string"


def plain(rows, shared=True):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [x[1:] for x in sorted(t)] for c, t in turns.items()}
    if shared:
        whole = dict(convs)
        for c, own in whole.items():
            h = zlib.crc32(str(c).encode()) % 6
            convs[c] = whole.get(c - int(np.fmod(c, 100)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, who in members.items():
        ends = sorted(c for c in who if len(convs[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), kids[node], leaves[node], saved[node],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def got(df):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda r: r[:2])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for c in [*range(0, 230), 500, 1_000_007, -3, -250, -200]:
        for turn in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
            out.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "hello there", "é日", ""])))
    for c in (301, 302, 303):  # one after another, 40 turns deep
        out += [(c, t, "user", f"turn {t}" if t < c - 270 else f"own {c} {t}") for t in range(40)]
    out += [(400 + c, 0, "user", "all alike") for c in range(60)] + [(400, 1, "user", "and on")]
    odd = [(7, None, None, None), (7, None, "user", "before all"), (8, 3, "user", None), (8, 3, "user", None), (None, 1, "user", "nobody's"),
           (9, 2**40, "system", "x" * 300_000), (9, -5, "", "first")]
    out += odd
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("options", [{}, {"segment": 3}, {"segment": 1, "shard_turns": 60, "range_turns": 50}])
def test_equals_plain_prefixes(spark, rows, options):
    """Also with conversations cut into segments, and prefixes shared by many shards."""
    assert got(pt.report(frame(spark, rows).repartition(3), **options)) == plain(rows)


def test_conversations_as_they_are(spark, rows):
    assert got(pt.report(frame(spark, rows), rebuild=pt.as_they_are, segment=4, shard_turns=100)) == plain(rows, shared=False)


def test_one_very_long_conversation(spark):
    rows = [(5, t, "user", f"t{t % 7}") for t in range(160)] + [(6, t, "user", f"t{t % 7}") for t in range(155)] + [(100, 0, "user", "t0")]
    assert got(pt.report(frame(spark, rows), range_turns=40, shard_turns=40, segment=16)) == plain(rows)


def test_ids_of_one_end_come_in_pieces(spark):
    rows = [(c, 0, "user", "same") for c in range(0, 4_000, 100)]
    rows_, pieces = pt.numbered(frame(spark, rows))
    assert got(pt.node_report(pt.build(pt.as_they_are(rows_, pieces), 8), digest_ids=3)) == plain(rows, shared=False)


def test_empty_table(spark):
    assert pt.report(frame(spark, [])).collect() == []
    assert pt.report(frame(spark, [(None, 1, "user", "x")])).collect() == []


@pytest.mark.parametrize("n, labels", [(1, 1), (2, 1), (400, 3), (2_000, 50), (3_000, 3_000)])
def test_double_array(n, labels):
    """Every child is found by its label, and no other label leads anywhere."""
    rng = np.random.default_rng(n)
    parent, label, known = [-1], [0], set()
    for _ in range(n - 1):
        edge = (int(rng.integers(0, len(parent)) ** rng.random()), int(rng.integers(1, labels + 1)))
        if edge not in known:
            known.add(edge)
            parent.append(edge[0])
            label.append(edge[1])
    parent, label = np.array(parent), np.array(label)
    base, check, state = pt.pack(parent, label)
    assert len(set(state.tolist())) == len(state)
    if len(parent) > 1:
        assert np.array_equal(pt.step(base, check, state[parent[1:]], label[1:]), state[1:])
    for node in range(0, len(parent), 7):
        reached = np.flatnonzero(pt.step(base, check, np.full(labels, state[node]), np.arange(1, labels + 1))) + 1
        assert reached.tolist() == sorted(x for p, x in known if p == node)
    assert len(check) < 4 * (n + labels) + 8


def test_arrays_answer_lookups(spark):
    """The stored arrays of a shard find the prefix of a conversation by the hashes of its turns."""
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "a"), (2, 1, "user", "c")]
    numbered, pieces = pt.numbered(frame(spark, rows))
    tries = pt.build(pt.as_they_are(numbered, pieces), 1, shard_turns=100)
    assert tries.arrays.count() == tries.arrays.select("shard").distinct().count()
    states = {(r.shard, r.state) for r in tries.nodes.collect()}
    found = 0
    for r in tries.arrays.collect():
        base, check = np.frombuffer(r["base"], np.int64), np.frombuffer(r["check"], np.int64)
        turns = np.frombuffer(r["turns"], np.int64).reshape(2, -1)
        top = np.flatnonzero(check == 1)
        for x in range(1, turns.shape[1] + 1):
            to = pt.step(base, check, top, np.full(len(top), x))
            found += sum((r.shard, int(t)) in states for t in to if t)
    assert found >= 1
