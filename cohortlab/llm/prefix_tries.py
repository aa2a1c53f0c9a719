"""Prefix tries over conversations: double arrays per shard, shared upper nodes added up across shards.

Each turn (role, text) has a 128-bit hash. Turns are numbered inside their conversation by range-sorted pieces, so a very long
conversation is no single task's load, and cut into segments of SEGMENT turns. The prefix of d turns is named by d and the exclusive or
of hashes of (place, turn), so a segment needs to know only what comes before it. Segments are range-sorted by their first turns and then
by conversation, so that a shard holds a stretch of like prefixes, and a prefix that very many share falls into several shards.

A shard gives its turns dense ids, packs its trie into BASE and CHECK, and walks every segment through the arrays. What a node needs to
know is a sum over its conversations, so shards add up along CHECK, and sums of one prefix from several shards are added by a global
aggregation. Two rounds do: the first gives each node's smallest conversation and count. A conversation stands for a stretch of its own
path, from where no smaller one shares it; the second adds up, over the others of a node, the text before that point (which is what
sharing saves), and which conversations end in a leaf.

Defined cases: rows without a conversation id belong to no conversation; a missing turn number comes first, a missing role or text is
empty; rows of equal turn number follow by role and a hash of the text; repeated rows are turns of their own; an empty table gives an
empty result; other columns are ignored. Texts enter by hash and length only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cohortlab.staging import stage

# Turns of a segment, of a shard, and of a range in which turns are numbered; ids in one piece of a list to digest.
SEGMENT = 256
SHARD_TURNS = 200_000
RANGE_TURNS = 500_000
DIGEST_IDS = 50_000
LEAST = 8

_FOUND = ("kind int, shard long, state int, parent int, depth long, k1 long, k2 long, p long, n long, cnt long, conv long, inner boolean, "
          "start boolean, last boolean, total long, base binary, check binary, turns binary")
NODE, END, TRIE = 0, 1, 2


# --- Turns in order

def numbered(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    range_turns: int = RANGE_TURNS,
) -> tuple[DataFrame, DataFrame]:
    """Turns (part, c, i, t1, t2, n) numbered from 1, and (part, c, off, len): where each part of a conversation starts, and its length."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role_col, text_col))
    turns = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("c"), F.col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(7), text, role).alias("t2"), F.length(text).cast("bigint").alias("n"))
    parts = max(LEAST, -(-conversations.count() // range_turns))
    ranged = stage(turns.repartitionByRange(parts, "c", "turn", "role", "t1", "t2").select(F.spark_partition_id().alias("part"), "*"))
    sizes = ranged.groupBy("part", "c").agg(F.count("*").alias("m"))
    whole = Window.partitionBy("c")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = sizes.select("part", "c", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("off"), F.sum("m").over(whole).alias("len"))
    place = F.row_number().over(Window.partitionBy("part", "c").orderBy("turn", "role", "t1", "t2"))
    rows = ranged.select("part", "c", place.alias("i"), "t1", "t2", "n")
    return rows, stage(pieces)


def with_shared_heads(rows: DataFrame, pieces: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Turns (c, pos, t1, t2, n) of conversations whose first turns are replaced by those of another.

    Conversation c gets the first h turns of conversation c - c % every, all if that has fewer and none if there is no such, and
    keeps its own after its first h; h is the crc32 of c as text, modulo `most`. A conversation without a turn has one row with pos 0.
    """
    h = (F.crc32(F.col("c").cast("string")) % most).alias("h")
    base = F.col("c") - F.col("c") % every
    heads = rows.where((F.col("c") == base) & (F.col("i") < most)).join(
        pieces.where((F.col("c") == base) & (F.col("off") < most)), ["part", "c"]).select(
        F.col("c").alias("base"), F.struct((F.col("i") + F.col("off")).alias("pos"), "t1", "t2", "n").alias("x")).where(F.col("x.pos") < most)
    heads = heads.groupBy("base").agg(F.collect_list("x").alias("x"))
    convs = pieces.groupBy("c").agg(F.max("len").alias("len")).select("c", "len", h, base.alias("base")).join(heads, "base", "left")
    own = F.filter(F.coalesce("x", F.array().cast("array<struct<pos:bigint,t1:bigint,t2:bigint,n:bigint>>")), lambda x: x["pos"] <= F.col("h"))
    convs = stage(convs.select("c", "len", "h", own.alias("x")).withColumn("b", F.size("x")))
    given = convs.where("b > 0").select("c", F.inline("x"))
    at = pieces.join(convs.select("c", "h", "b"), "c")
    kept = rows.join(at, ["part", "c"]).withColumn("i", F.col("i") + F.col("off")).where("i > h").select(
        "c", (F.col("b") + F.col("i") - F.col("h")).alias("pos"), "t1", "t2", "n")
    bare = convs.where("b = 0 AND len <= h").select("c", *[F.lit(0).cast("bigint").alias(x) for x in ("pos", "t1", "t2", "n")])
    return given.unionByName(kept).unionByName(bare)


def as_they_are(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """Turns (c, pos, t1, t2, n) of conversations as given."""
    return rows.join(pieces, ["part", "c"]).select("c", (F.col("i") + F.col("off")).alias("pos"), "t1", "t2", "n")


# --- Double arrays

def pack(parent: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BASE, CHECK, and the state of each node; node 0 is the root, in state 1. Labels are 1 or more.

    The child of state s by label x is state t = BASE[s] + x, if CHECK[t] is s. Families are placed from the largest down: each at the
    first free place that suits it among those tried, or behind all others; only children fill what is left free.
    """
    nodes = len(parent)
    order = np.lexsort((label, parent))[1:]  # the root, whose parent is -1, comes first
    owner = parent[order]
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if nodes > 1 else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((first, [nodes - 1])))
    used = np.zeros(int(label.max(initial=0)) + nodes + 4, bool)
    used[:2] = True
    state = np.ones(nodes, np.int64)
    base = np.zeros(nodes, np.int64)
    low, top = 2, 2
    for f in np.argsort(-size, kind="stable")[: int((size > 1).sum())]:
        family = order[first[f]: first[f] + size[f]]
        span = label[family] - label[family[0]]
        if top + span[-1] + 1 > len(used):
            used = np.concatenate((used, np.zeros(max(len(used), int(span[-1]) + 2), bool)))
        free = np.flatnonzero(~used[low:top])[: max(1, 2**18 // len(family))] + low
        at = top
        if len(free):
            fits = np.flatnonzero(~used[free[:, None] + span].any(axis=1)) if free[-1] + span[-1] < len(used) else np.zeros(0, np.int64)
            if len(fits):
                at = int(free[fits[0]])
            elif len(free) > 1_000:
                low = int(free[len(free) // 2])  # a crowded stretch is left to only children
        used[at + span] = True
        state[family] = at + span
        base[owner[first[f]]] = at - label[family[0]]
        top = max(top, int(at + span[-1]) + 1)
    lone = first[size == 1]
    if len(lone):
        free = np.flatnonzero(~used)[: len(lone)]
        free = np.concatenate((free, len(used) + np.arange(len(lone) - len(free))))
        state[order[lone]] = free
        base[owner[lone]] = free - label[order[lone]]
    out = np.zeros((2, int(state.max()) + 1), np.int64)
    out[0][state] = base
    out[1][state[1:]] = state[parent[1:]]
    return out[0], out[1], state


def step(base: np.ndarray, check: np.ndarray, state: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The states reached by labels; 0 where there is no such child."""
    to = base[state] + label
    inside = (to > 1) & (to < len(check))
    to = np.where(inside, to, 0)
    return np.where(check[to] == state, to, 0)


def _dense(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 1 of different rows, and where each number is first met."""
    order = np.lexsort(columns)
    lead = np.ones(len(order), bool)
    if len(order):
        lead[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(lead)
    return out, order[lead]


class Trie:
    """The trie of a shard's segments, built level by level and packed into a double array."""

    def __init__(self, begins: np.ndarray, sizes: np.ndarray, labels: np.ndarray, starts: np.ndarray):
        width = int(max(labels.max(initial=0), starts.max(initial=0))) + 1
        parent, label, seen = [np.array([-1])], [np.array([0])], [np.array([-1])]
        now, count = np.zeros(len(sizes), np.int64), 1
        live, self.levels = np.arange(len(sizes)), [np.array([0])]
        for j in range(int(sizes.max(initial=0)) + 1):
            live = live[sizes[live] >= j]
            x = starts[live] if j == 0 else labels[begins[live] + j - 1]
            key, first, where = np.unique(now[live] * width + x, return_index=True, return_inverse=True)
            parent.append(key // width)
            label.append(key % width)
            seen.append(begins[live][first] + j - 1 if j else live[first])
            self.levels.append(count + np.arange(len(key)))
            now[live] = count + where
            count += len(key)
        parent, label, self.seen = (np.concatenate(x) for x in (parent, label, seen))
        self.base, self.check, state = pack(parent, label)
        self.levels = [state[x] for x in self.levels]
        self.at = np.zeros(len(self.check), np.int64)  # what of the input stands for a state
        self.at[state] = self.seen
        # Walk the arrays: where does each segment end?
        self.ends = step(self.base, self.check, np.ones(len(sizes), np.int64), starts)
        for j in range(1, int(sizes.max(initial=0)) + 1):
            live = np.flatnonzero(sizes >= j)
            self.ends[live] = step(self.base, self.check, self.ends[live], labels[begins[live] + j - 1])
        if (self.ends == 0).any():
            raise AssertionError("a segment left the trie")


def upward(levels: list[np.ndarray], check: np.ndarray, values: np.ndarray, add=np.add) -> np.ndarray:
    """Values of states, combined with those of all states below, along CHECK from the deepest level up."""
    for states in reversed(levels[1:]):
        add.at(values, check[states], values[states])
    return values


def _shard_rows(shard: int, table: pa.Table, segment: int) -> pa.RecordBatch:
    """Nodes, ends of segments and the arrays of one shard."""
    col = {c: table.column(c).combine_chunks() for c in table.column_names}
    c, seg, s1, s2, before, total = (col[x].to_numpy(zero_copy_only=False) for x in ("c", "seg", "s1", "s2", "before", "total"))
    last = col["last"].to_numpy(zero_copy_only=False)
    turns = col["turns"]
    turns = turns.chunk(0) if isinstance(turns, pa.ChunkedArray) else turns
    offsets = turns.offsets.to_numpy().astype(np.int64)
    begins, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    flat = turns.flatten()
    t1, t2, k1, k2, n = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("t1", "t2", "k1", "k2", "n"))
    labels, firsts = _dense(t1, t2)
    starts, _ = _dense(s1, s2, seg)
    trie = Trie(begins, sizes, labels, starts)
    check, levels = trie.check, trie.levels
    key1, key2, through, size, depth = (np.zeros(len(check), np.int64) for _ in range(5))
    top = levels[1]
    who = trie.at[top]
    key1[top], key2[top], through[top], depth[top] = s1[who], s2[who], before[who], seg[who] * segment
    for states in levels[2:]:
        up, who = check[states], trie.at[states]
        key1[states], key2[states] = key1[up] ^ k1[who], key2[up] ^ k2[who]
        size[states] = n[who]
        through[states], depth[states] = through[up] + n[who], depth[up] + 1
    count = np.bincount(trie.ends, minlength=len(check)).astype(np.int64)
    least = np.full(len(check), 2**63 - 1)
    np.minimum.at(least, trie.ends, c)
    upward(levels, check, count)
    upward(levels, check, least, np.minimum)
    inner = np.zeros(len(check), bool)
    for states in levels[2:]:
        inner[check[states]] = True
    start = np.zeros(len(check), bool)
    start[top] = depth[top] > 0  # such a node is counted where it ends a segment
    count[start] = 0
    nodes, ends = np.concatenate(levels[1:]), trie.ends

    def ints(node, end):
        return pa.array(np.concatenate((node, end)).tolist() + [None], pa.int64())

    m, e = len(nodes), len(ends)
    none, zeros = [None] * (m + e), np.zeros(e, np.int64)
    turn_keys = np.stack((t1[firsts], t2[firsts])) if len(firsts) else np.zeros((2, 0), np.int64)
    arrays = [
        pa.array([NODE] * m + [END] * e + [TRIE], pa.int32()), pa.array([shard] * (m + e + 1), pa.int64()),
        ints(nodes, ends).cast(pa.int32()), ints(np.where(np.isin(nodes, top), 0, check[nodes]), zeros).cast(pa.int32()),
        *[ints(x[nodes], x[ends]) for x in (depth, key1, key2, through, size)], ints(count[nodes], zeros), ints(least[nodes], c),
        pa.array(inner[nodes].tolist() + [None] * (e + 1), pa.bool_()), pa.array(start[nodes].tolist() + [None] * (e + 1), pa.bool_()),
        pa.array([None] * m + last.tolist() + [None], pa.bool_()), ints(np.zeros(m, np.int64), total),
        *[pa.array(none + [x.tobytes()], pa.binary()) for x in (trie.base, check, turn_keys)],
    ]
    return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _FOUND.split(", ")])


def _shards(segment: int, shard_turns: int):
    def build(batches):
        held, turns, seq, part = [], 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            held.append(batch)
            turns += len(batch.column("turns").flatten()) + batch.num_rows
            if turns >= 2 * shard_turns:
                yield _shard_rows(part << 24 | seq, pa.Table.from_batches(held), segment)
                held, turns, seq = [], 0, seq + 1
        if held:
            yield _shard_rows(part << 24 | seq, pa.Table.from_batches(held), segment)

    return build


# --- Nodes of all shards

@dataclass
class Tries:
    """`found`: staged rows of all shards. `arrays` has BASE, CHECK and the hashes of turns by dense id, for lookups."""

    found: DataFrame

    @property
    def nodes(self) -> DataFrame:
        return self.found.where(F.col("kind") == NODE).select("shard", "state", "parent", "depth", "k1", "k2", "p", "n", "cnt", "conv", "inner", "start")

    @property
    def ends(self) -> DataFrame:
        return self.found.where(F.col("kind") == END).select(
            *[F.col(x).alias(x) for x in ("shard", "state", "depth", "k1", "k2")], F.col("conv").alias("c"), "last", "total")

    @property
    def arrays(self) -> DataFrame:
        return self.found.where(F.col("kind") == TRIE).select("shard", "base", "check", "turns")


def build(turns: DataFrame, shards: int, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS) -> Tries:
    """Tries of turns (c, pos, t1, t2, n), in about so many shards."""
    cell = F.struct("pos", "t1", "t2", "n", F.xxhash64("t1", "pos").alias("k1"), F.xxhash64("t2", "pos").alias("k2"))
    at = F.when(F.col("pos") > 0, cell)
    segments = turns.withColumn("x", at).groupBy("c", F.expr(f"greatest(pos - 1, 0) div {segment}").alias("seg")).agg(
        F.array_sort(F.collect_list("x")).alias("turns"), F.coalesce(F.bit_xor("x.k1"), F.lit(0)).alias("x1"),
        F.coalesce(F.bit_xor("x.k2"), F.lit(0)).alias("x2"), F.sum("n").alias("chars"))
    whole = Window.partitionBy("c")
    before = whole.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)

    def earlier(combine, name):
        return F.coalesce(combine(name).over(before), F.lit(0))

    placed = segments.select(
        "c", "seg", "turns", earlier(F.bit_xor, "x1").alias("s1"), earlier(F.bit_xor, "x2").alias("s2"), earlier(F.sum, "chars").alias("before"),
        F.sum("chars").over(whole).alias("total"), (F.col("seg") == F.max("seg").over(whole)).alias("last"))
    first = [F.get("turns", F.lit(i))["k1"] for i in range(3)]
    ranged = placed.repartitionByRange(shards, "seg", "s1", *first, "c").select(F.spark_partition_id().alias("part"), "*")
    return Tries(stage(ranged.mapInArrow(_shards(segment, shard_turns), _FOUND)))


def _second_round(nodes: pa.Table, ends: pa.Table) -> pa.Table:
    """Sums of one shard over the conversations of each node."""
    state, parent, local, rep = (nodes.column(x).to_numpy() for x in ("state", "parent", "conv", "rep"))
    depth, start = nodes.column("depth").to_numpy(), nodes.column("start").to_numpy(zero_copy_only=False)
    at, c, pf, leaf = (ends.column(x).to_numpy() for x in ("state", "c", "pf", "leaf"))
    room = int(state.max(initial=0)) + 1
    saved, leaves, kids, own = (np.zeros(room, np.int64) for _ in range(4))
    np.add.at(saved, at, pf)
    np.add.at(leaves, at, leaf)
    up = np.zeros(room, np.int64)
    up[state] = parent
    # Deepest nodes first; a node's parent stands one level above it.
    order = np.argsort(depth, kind="stable")
    edges = np.flatnonzero(np.diff(depth[order])) + 1
    for group in reversed(np.split(state[order], edges)):
        group = group[up[group] > 0]
        np.add.at(saved, up[group], saved[group])
        np.add.at(leaves, up[group], leaves[group])
    mine = local == rep
    np.add.at(kids, parent[mine & (parent > 0)], 1)
    name = np.zeros(room, np.int64)
    name[state] = rep
    order = np.argsort(c)
    at_rep = np.minimum(np.searchsorted(c[order], rep), len(c) - 1)
    own[state] = np.where(mine, pf[order][at_rep], 0)
    some = ~start
    return pa.table({
        "depth": depth, "k1": nodes.column("k1"), "k2": nodes.column("k2"),
        "saved": np.where(some, saved[state] - own[state], 0), "leaves": np.where(some, leaves[state], 0), "kids": kids[state],
        "up": pa.array(name[parent], pa.int64(), mask=parent == 0)})


def _id_pieces(limit: int):
    def run(batches):
        for batch in batches:
            k1, k2, depth, c = (batch.column(x).to_numpy() for x in ("k1", "k2", "depth", "c"))
            new = np.ones(len(c), bool)
            new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (depth[1:] != depth[:-1])
            first = np.flatnonzero(new)
            cuts = [a for x, y in zip(first, [*first[1:], len(c)]) for a in range(x, y, limit)]
            texts = [",".join(map(str, c[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(c)])]
            yield pa.RecordBatch.from_arrays([pa.array(x[cuts]) for x in (depth, k1, k2, c)] + [pa.array(texts, pa.string())],
                                             names=["depth", "k1", "k2", "first", "ids"])

    return run


def _digests(batches):
    """One digest per prefix from its sorted pieces, which may go over several batches; only the running digest is held."""
    key, state = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in key] + [pa.array([state.hexdigest()])],
                                          names=["depth", "k1", "k2", "ends"])

    for batch in batches:
        out = []
        for depth, k1, k2, ids in zip(*(batch.column(x).to_pylist() for x in ("depth", "k1", "k2", "ids"))):
            if (depth, k1, k2) == key:
                state.update(b",")
            else:
                if key:
                    out.append(done())
                key, state = (depth, k1, k2), hashlib.sha256()
            state.update(ids.encode())
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if key:
        yield done()


def node_report(tries: Tries, digest_ids: int = DIGEST_IDS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of all tries together."""
    key = ["depth", "k1", "k2"]
    merged = stage(tries.nodes.groupBy(*key).agg(
        F.sum("cnt").alias("cnt"), F.min("conv").alias("rep"), F.max("n").alias("n"), F.max("p").alias("p"), F.bool_or("inner").alias("inner")))
    # A conversation stands for its path from the depth where no smaller one shares it.
    paths = merged.groupBy(F.col("rep").alias("c")).agg(F.min(F.col("p") - F.col("n")).alias("pf"), F.max((~F.col("inner")).cast("bigint")).alias("leaf"))
    weights = tries.ends.join(paths, "c", "left").select(
        "shard", "state", "c", F.coalesce("pf", "total").alias("pf"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    local = tries.nodes.join(merged.select(*key, "rep"), key)
    sums = local.groupBy("shard").cogroup(weights.groupBy("shard")).applyInArrow(
        lambda a, b: _second_round(a, b), "depth long, k1 long, k2 long, saved long, leaves long, kids long, up long")
    sums = sums.groupBy(*key).agg(*[F.sum(x).alias(x) for x in ("saved", "leaves", "kids")], F.max("up").alias("up"))
    ends = tries.ends.where("last").select(*key, "c")
    pieces = ends.repartitionByRange("k1", "k2", "depth", "c").sortWithinPartitions("k1", "k2", "depth", "c").mapInArrow(
        _id_pieces(digest_ids), "depth long, k1 long, k2 long, first long, ids string")
    digests = pieces.repartition("k1", "k2", "depth").sortWithinPartitions("k1", "k2", "depth", "first").mapInArrow(
        _digests, "depth long, k1 long, k2 long, ends string")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    shared = F.col("cnt") - 1
    return merged.join(sums, key).join(digests, key, "left").select(
        F.col("rep").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), F.col("cnt").alias("n_convs"),
        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") - shared * (F.col("p") - F.col("n"))).alias("saved_tokens"), F.coalesce("ends", none).alias("ends_sha256"))


def report(conversations: DataFrame, rebuild=with_shared_heads, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS,
           range_turns: int = RANGE_TURNS) -> DataFrame:
    """Every node of the prefix trie of all conversations, as `node_report` lists them; `rebuild` makes the turns to enter."""
    rows, pieces = numbered(conversations, range_turns=range_turns)
    shards = max(LEAST, -(-conversations.count() // shard_turns))
    return node_report(build(rebuild(rows, pieces), shards, segment, shard_turns))
