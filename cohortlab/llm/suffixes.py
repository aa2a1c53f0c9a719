"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

A sparse suffix array is enough: every string of `length` bytes holds one anchor chosen by its content (the least hash of its grams),
so equal strings have equal anchors at the same offset. Suffixes that start at anchors whose gram another document shares are sorted
in each block, front-coded (length of the prefix shared with the one before, and the rest), and sent to ranges of the suffix order.
There the runs are merged by a loser tree that carries common prefix lengths, so known prefixes are never compared again. Stretches
of the merged order with a common gram decide which strings start in a smaller document; each suffix brings the bytes to its left.

Of documents with equal texts only the one with the smallest id takes part; the others are cut as a whole.

Grams in so many blocks that a range would be flooded are listed (their number is bounded by the anchors of a block) and their
strings are compared by hash in even buckets instead; the outcome is the same.

Defined cases: NULL and empty texts have no bytes and the digest of the empty string; texts shorter than `length` lose nothing; a
missing id counts as larger than any id and not as smaller than another missing id; rows with equal ids do not remove from each
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlab.llm.common import keyed, shown_id
from cohortlab.llm.exchange import ASKS, answer, asks, bucket_count, found_items, gathered, replier
from cohortlab.llm.graph import among, bitmap, place
from cohortlab.llm.textscan import Block, blocks, mix
from cohortlab.staging import stage

LENGTH, GRAM = 50, 20
# Text of a block: several arrays of eight bytes for each of its bytes live at once.
BLOCK_BYTES = 1_000_000
# Documents that splitters are taken from (least hashes), more where there are very many ranges; they only balance the ranges.
SPLITTER_DOCS = 1_000
# A gram is common if it is in this share of blocks, and in at least this many.
COMMON_SHARE, COMMON_BLOCKS = 0.2, 16
# Fixed part of a suffix in a run: place of its document in the run's table, place in the text, bytes to the left and first offset.
ITEM = np.dtype([("who", "<u4"), ("at", "<u4"), ("left", "u1"), ("first", "u1"), ("lcp", "u1"), ("size", "u1")])
# Rows to ranges of suffixes (part >= 0) and to buckets of hashes (-1 and below) travel together; so do their results.
RUNS = "part int, tell boolean, docs binary, items binary, tails binary, lefts binary"
MASKS = "rk long, masks binary, hashes binary"
MASK = np.dtype([("at", "<u4"), ("bits", "<u4")])


class Anchors:
    """Anchors of a block: place, gram hash, and the strings (starts `low` to `high`) that each stands for."""

    def __init__(self, block: Block, length: int, gram: int):
        span = length - gram + 1
        self.at = self.low = self.high = self.doc = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        h = block.grams(gram)
        if len(h) < span:
            return
        # Hash above, place below: the least value is the leftmost least hash.
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        reach = 1
        while reach * 2 <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if span > reach:
            least = np.minimum(least[: reach - span], least[span - reach:])
        fits = np.repeat(block.ends - length, block.sizes + 1)[: len(least)] >= np.arange(len(least))
        start = np.flatnonzero(fits)
        if not len(start):
            return
        chosen = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        lead = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        self.at, self.low = chosen[lead], start[lead]
        self.high = start[np.concatenate((lead[1:], [len(start)])) - 1]
        self.hash = h[self.at] & np.uint64(0xFFFFFFFFFFFF0000)
        self.doc = np.searchsorted(block.ends, self.low)


def _ordered(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.take(pa.array(np.argsort(batch.column("doc").to_numpy(), kind="stable")))


def _anchor_asks(n_buckets: int, shared, length: int, gram: int):
    """Anchors of documents that take part. The bitmap passes all of them and few others, which only add work."""
    def run(batches):
        for batch in map(_ordered, blocks(batches, limit=BLOCK_BYTES)):
            batch = batch.filter(pa.array(among(shared.value, batch.column("place").to_numpy())))
            if not batch.num_rows:
                continue
            a = Anchors(Block(batch.column("text")), length, gram)
            yield asks(n_buckets, batch.column("doc").to_numpy(), batch.column("rk").to_numpy(), a.doc, a.hash, 6, smaller=False)
    return run


def _gram_sample(length: int, gram: int):
    def run(batches):
        for batch in blocks(batches, limit=BLOCK_BYTES):
            block = Block(batch.column("text"))
            at = Anchors(block, length, gram).at[::4]
            yield pa.RecordBatch.from_arrays([pa.array([block.raw[p: p + gram] for p in at], pa.binary())], names=["gram"])
    return run


def _among(h: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which hashes are wanted: those that pass a bitmap are looked up. Bits 20 to 39 are filled at every width of hashes."""
    out = np.zeros(len(h), bool)
    if not len(wanted) or not len(h):
        return out
    wanted = np.unique(wanted)
    bits = np.zeros(2**20, bool)
    bits[(wanted >> np.uint64(20)) & np.uint64(2**20 - 1)] = True
    near = np.flatnonzero(bits[(h >> np.uint64(20)) & np.uint64(2**20 - 1)])
    out[near] = wanted[np.minimum(np.searchsorted(wanted, h[near]), len(wanted) - 1)] == h[near]
    return out


def _shared_anchors(batch: pa.RecordBatch, block: Block, length: int, gram: int, common: np.ndarray) -> tuple[Anchors, np.ndarray, np.ndarray]:
    """Anchors, those shared with another document, and those of common grams."""
    a = Anchors(block, length, gram)
    shared, often = _among(a.hash, found_items(batch.column("found"))[1]), _among(a.hash, common)
    return a, np.flatnonzero(shared & ~often), np.flatnonzero(shared & often)


def _runs_and_asks(n_buckets: int, shared, length: int, gram: int):
    """Of each block, the sorted front-coded suffixes by range, and the strings at common grams by hash."""
    def run(batches):
        splitters, common = shared.value
        for batch in map(_ordered, blocks(batches, limit=BLOCK_BYTES)):
            block = Block(batch.column("text"))
            a, some, often = _shared_anchors(batch, block, length, gram, common)
            docs, rks = batch.column("doc").to_numpy(), batch.column("rk").to_numpy()
            if len(some):
                yield _suffix_runs(block, a, some, docs, rks, splitters, length, gram)
            if len(often):
                rows = _string_asks(n_buckets, block, a, often, docs, rks, length)
                part = pa.array(-1 - rows.column("bucket").to_numpy(), pa.int32())
                yield pa.RecordBatch.from_arrays([part, *[rows.column(c) for c in ("tell", "rks", "docs", "counts", "hashes")]],
                                                 names=["part", "tell", "docs", "items", "tails", "lefts"])
    return run


def _suffix_runs(block: Block, a: Anchors, some: np.ndarray, docs: np.ndarray, rks: np.ndarray, splitters: np.ndarray, length: int,
                 gram: int) -> pa.RecordBatch:
    """Sorted front-coded suffixes by range; of equal strings in a block only those of the smallest id go."""
    at, low, high, who = a.at[some], a.low[some], a.high[some], a.doc[some]
    right = [block.raw[p: e] for p, e in zip(at.tolist(), (high + length).tolist())]
    left = [block.raw[s: p] for s, p in zip(low.tolist(), at.tolist())]
    order = sorted(range(len(some)), key=lambda i: (right[i], left[i], who[i]))
    runs: dict[int, list] = {}
    told: dict[int, list] = {}
    part_of = np.searchsorted(splitters, np.array([r[:gram] for r in right], f"S{gram}"), side="right") if len(splitters) else np.zeros(len(some), int)
    last = None
    for i in order:
        if last is not None and right[i] == right[last] and left[i] == left[last]:
            if docs[who[i]] > docs[who[last]]:
                told.setdefault(int(who[i]), []).append((at[i] - block.begins[who[i]], _span(at[i], low[i], high[i])))
                continue
        else:
            last = i
        runs.setdefault(int(part_of[i]), []).append(i)
    rows = []
    for part, items in runs.items():
        index = np.array(items)
        people, place = np.unique(who[index], return_inverse=True)
        fixed = np.zeros(len(items), ITEM)
        fixed["who"], fixed["at"] = place, at[index] - block.begins[who[index]]
        fixed["left"], fixed["first"] = at[index] - low[index], at[index] - high[index]
        tails, shared, before = [], [], b""
        for i in items:
            r = right[i]
            n = common_prefix(before, r, 0)
            shared.append(n)
            tails.append(r[n:])
            before = r
        fixed["lcp"], fixed["size"] = shared, [len(right[i]) for i in items]
        table = np.stack((docs[people], rks[people]), 1)
        rows.append((part, False, table.tobytes(), fixed.tobytes(), b"".join(tails), b"".join([left[i] for i in items])))
    for d, masks in told.items():
        rows.append((int(rks[d] % (len(splitters) + 1)), True, rks[[d]].tobytes(), np.array(masks, MASK).tobytes(), b"", b""))
    return pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.bool_(), *[pa.binary()] * 4))],
        names=["part", "tell", "docs", "items", "tails", "lefts"])


def _string_asks(n_buckets: int, block: Block, a: Anchors, some: np.ndarray, docs: np.ndarray, rks: np.ndarray, length: int) -> pa.RecordBatch:
    """Strings at common grams, by hash."""
    n = (a.high - a.low + 1)[some]
    start = np.repeat(a.low[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return asks(n_buckets, docs, rks, np.repeat(a.doc[some], n), block.grams(length)[start], 8, smaller=True)


def _span(at: int, low: int, high: int) -> int:
    """Bits at - high to at - low."""
    return (1 << int(at - low + 1)) - (1 << int(at - high))


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    step = known
    while a[step: step + 8] == b[step: step + 8]:
        step += 8
    while a[step] == b[step]:
        step += 1
    return step


def merge(runs: list[list[tuple[bytes, int]]]):
    """(run, place in it, common prefix with the one before) of all strings of sorted runs, in order.

    `runs` hold (string, common prefix with its predecessor in the run). A node of the tree keeps the loser of its match and the
    loser's common prefix with the winner; a newcomer's prefix with the last string out is known from its own run. The longer known
    prefix wins outright, and only equal ones compare, from that length on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    place = [0] * k
    current = [r[0][0] if r else None for r in runs] + [None] * (k - len(runs))
    lcp = [0 if s is not None else -1 for s in current]
    loser, loser_lcp = [0] * k, [0] * k

    def play(a: int, ha: int, b: int, hb: int) -> tuple[int, int, int, int]:
        """Winner and loser with their common prefixes: the winner's with the last out, the loser's with the winner."""
        if ha > hb:
            return a, ha, b, hb
        if hb > ha:
            return b, hb, a, ha
        if ha < 0:
            return a, ha, b, hb
        x, y = current[a], current[b]
        n = common_prefix(x, y, ha)
        if n == len(x) or n < len(y) and x[n] < y[n]:
            return a, ha, b, n
        return b, hb, a, n

    def build(node: int) -> tuple[int, int]:
        if node >= k:
            return node - k, lcp[node - k]
        a, ha = build(2 * node)
        b, hb = build(2 * node + 1)
        a, ha, loser[node], loser_lcp[node] = play(a, ha, b, hb)
        return a, ha

    winner, h = build(1)
    while current[winner] is not None:
        yield winner, place[winner], h
        place[winner] += 1
        run = runs[winner]
        if place[winner] < len(run):
            current[winner], h = run[place[winner]]
        else:
            current[winner], h = None, -1
        node = (winner + k) // 2
        while node:
            other, ho = loser[node], loser_lcp[node]
            if h < ho or h == ho:
                winner, h, loser[node], loser_lcp[node] = play(winner, h, other, ho)
            node //= 2


def _merged(length: int, gram: int):
    """Which strings at each suffix start in a smaller document, of one range of suffixes."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        runs, fixed, people, lefts = [], [], [], []
        out_rk, out_mask = [], []
        for row in rows:
            if row["tell"]:
                out_rk.append(np.frombuffer(row["docs"], np.int64)[0])
                out_mask.append(row["items"])
                continue
            items = np.frombuffer(row["items"], ITEM)
            strings, at, before = [], 0, b""
            for n, size in zip(items["lcp"].tolist(), items["size"].tolist()):
                before = before[:n] + row["tails"][at: at + size - n]
                at += size - n
                strings.append((before, n))
            runs.append(strings)
            fixed.append(list(zip(*(items[c].tolist() for c in ("who", "at", "left", "first")))))
            ends = np.cumsum(items["left"].astype(np.int64))
            lefts.append([row["lefts"][e - n: e] for e, n in zip(ends.tolist(), items["left"].tolist())])
            people.append(np.frombuffer(row["docs"], np.int64).reshape(-1, 2).tolist())
        found: list[tuple[int, int, int]] = []
        group: list[tuple[int, int, int]] = []

        def settle() -> None:
            """Strings at the suffixes of one gram: equal stretches go to their smallest document, others string by string.

            What a suffix shares with any other is at most what it shares with its neighbours in the order, so strings that reach
            further to the right are its own and need no look.
            """
            if len(group) < 2:
                return
            owner: dict[tuple[bytes, bytes], int] = {}
            members = []
            for place, (r, i, n) in enumerate(group):
                right = runs[r][i][0]
                key = (lefts[r][i], right)
                item = fixed[r][i]
                doc, rk = people[r][item[0]]
                near = max(n if place else 0, group[place + 1][2] if place + 1 < len(group) else 0)
                far = item[2]
                last = min(far + len(right) - length, far - length + near)
                members.append((key, doc, rk, item[1], far, item[3], last))
                owner[key] = min(owner.get(key, doc), doc)
            least: dict[tuple[int, bytes], int] = {}
            if len(owner) > 1:
                done = set()
                for key, _, _, _, far, _, last in members:
                    if last < 0 or key in done:
                        continue
                    done.add(key)
                    doc, whole = owner[key], key[0] + key[1]
                    for s in range(last + 1):
                        window = (far - s, whole[s: s + length])
                        if least.get(window, doc) >= doc:
                            least[window] = doc
            for key, doc, rk, at, far, first, last in members:
                if doc > owner[key]:
                    found.append((rk, at, _span(far, 0, far - first)))
                elif least and last >= 0:
                    whole, bits = key[0] + key[1], 0
                    for s in range(last + 1):
                        if least[far - s, whole[s: s + length]] < doc:
                            bits |= 1 << (far - s)
                    if bits:
                        found.append((rk, at, bits))

        if runs:
            for r, i, n in merge(runs):
                if n < gram:
                    settle()
                    group.clear()
                group.append((r, i, n))
            settle()
        masks: dict[int, list] = {}
        for rk, at, bits in found:
            masks.setdefault(rk, []).append((at, bits))
        out_rk += list(masks)
        out_mask += [np.array(m, MASK).tobytes() for m in masks.values()]
        return pa.table({"rk": pa.array([int(x) for x in out_rk], pa.int64()), "masks": pa.array(out_mask, pa.binary()),
                         "hashes": pa.array([None] * len(out_rk), pa.binary())})
    return run


def _settled(length: int, gram: int):
    """A range of suffixes is merged; a bucket of hashes answers its asks."""
    merged, reply = _merged(length, gram), replier(8, True)

    def run(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() >= 0:
            return merged(table)
        out = reply(table.rename_columns(["part", "tell", "rks", "docs", "counts", "hashes"]))
        return pa.table({"rk": out.column("rk"), "masks": pa.array([None] * out.num_rows, pa.binary()), "hashes": out.column("hashes")})
    return run


def _cut(length: int, texts: bool):
    def run(batches):
        for batch in blocks(batches, limit=BLOCK_BYTES):
            block, rows = Block(batch.column("text")), batch.num_rows
            copy = batch.column("copy").fill_null(False).to_numpy(zero_copy_only=False) & (block.sizes >= length)
            starts = [block.begins[copy]]
            stops = [block.ends[copy]]
            held = [b"".join(m) if m else b"" for m in batch.column("masks").to_pylist()]
            masks = np.frombuffer(b"".join(held), MASK)
            if len(masks):
                doc = np.repeat(np.arange(rows), [len(m) // MASK.itemsize for m in held])
                bits = np.unpackbits(np.ascontiguousarray(masks["bits"]).view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
                item, bit = np.nonzero(bits)
                starts.append(masks["at"][item].astype(np.int64) - bit + block.begins[doc[item]])
                stops.append(starts[-1] + length)
            which, strings = found_items(batch.column("found"))
            if len(strings):
                # Only texts with such strings are looked at.
                some = np.unique(which)
                n = np.maximum(0, block.sizes[some] - length + 1)
                doc = np.repeat(some, n)
                spot = np.repeat(block.begins[some] - (np.cumsum(n) - n), n) + np.arange(len(doc))
                salt = mix(np.arange(1, rows + 1, dtype=np.uint64))
                hit = spot[_among(block.grams(length)[spot] ^ salt[doc], strings ^ salt[which])]
                starts.append(hit)
                stops.append(hit + length)
            removed, spans = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            kept = [block.raw[a:b] for a, b in zip(block.begins.tolist(), block.ends.tolist())]
            starts, stops = np.concatenate(starts), np.concatenate(stops)
            if len(starts):
                room = len(block.bytes) + 1
                edge = np.bincount(starts, minlength=room) - np.bincount(stops, minlength=room)
                gone = np.cumsum(edge) > 0
                cut = np.flatnonzero(np.diff(gone.view(np.int8), prepend=0) > 0)
                removed = np.add.reduceat(gone, block.begins, dtype=np.int64) - gone[block.ends]
                spans = np.bincount(np.searchsorted(block.ends, cut), minlength=rows)[:rows]
                for d in np.flatnonzero(removed).tolist():
                    a, b = block.begins[d], block.ends[d]
                    kept[d] = block.bytes[a:b][~gone[a:b]].tobytes()
            last = pa.array(kept, pa.binary()) if texts else pa.array([hashlib.sha256(k).hexdigest() for k in kept])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(block.sizes), pa.array(removed), pa.array(spans), last],
                                             names=["doc", "n_bytes", "n_removed", "n_spans", "kept"])
    return run


def _dedup(docs: DataFrame, length: int, gram: int, id_col: str, text_col: str, texts: bool) -> DataFrame:
    if not 1 <= length - gram <= 31:
        raise ValueError("a gram is 1 to 31 bytes shorter than the strings")
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = bucket_count(docs, text_col)
    often = max(COMMON_BLOCKS, int(COMMON_SHARE * size / BLOCK_BYTES))
    texts_of = stage(rows.select("doc", "rk", F.md5("text").alias("text")))
    first = texts_of.groupBy("text").agg(F.min(F.struct("doc", "rk")).alias("first"))
    copies = texts_of.join(first, "text").where("doc > first.doc").select("rk").distinct()
    bits = spark.sparkContext.broadcast(bitmap(first.select("first.rk"), "rk"))
    replies = stage(answer(rows.select("doc", "rk", "text", place("rk").alias("place")).mapInArrow(
        _anchor_asks(n, bits, length, gram), ASKS), 6, smaller=False, often=often))
    common = b"".join(r.hashes for r in replies.where("common").select("hashes").collect())
    sample = rows.select("text", "rk").orderBy("rk").limit(max(SPLITTER_DOCS, n // 8)).select("text").mapInArrow(_gram_sample(length, gram), "gram binary")
    grams = np.sort(np.array([bytes(g) for g in sample.toArrow().column("gram").to_pylist()], f"S{gram}"))
    splitters = np.unique(grams[np.linspace(0, len(grams), n + 1).astype(int)[1:-1]]) if len(grams) else grams
    shared = spark.sparkContext.broadcast((splitters, np.frombuffer(common, "<u8")))
    # The joins deal the texts out by the same key, so one exchange of them serves all.
    near = rows.join(gathered(replies.where("not common")), "rk").select("doc", "rk", "text", "found")
    settled = near.mapInArrow(_runs_and_asks(n, shared, length, gram), RUNS).groupBy("part").applyInArrow(_settled(length, gram), MASKS)
    none = F.lit(None).cast("binary")
    marks = settled.select("*", F.lit(False).alias("copy")).unionByName(
        copies.select("rk", none.alias("masks"), none.alias("hashes"), F.lit(True).alias("copy"))).groupBy("rk").agg(
        F.collect_list("masks").alias("masks"), F.collect_list("hashes").alias("found"), F.max("copy").alias("copy"))
    whole = rows.join(marks, "rk", "left").select("doc", "text", "masks", "found", "copy")
    kind = "binary" if texts else "string"
    return whole.mapInArrow(_cut(length, texts), f"doc long, n_bytes long, n_removed long, n_spans long, kept {kind}")


def report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    return _dedup(docs, length, gram, id_col, text_col, texts=False).select(
        shown_id(F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans); `kept` as bytes, since a cut may fall inside a character."""
    return _dedup(docs, length, gram, id_col, text_col, texts=True).select(
        shown_id(F.col("doc")).alias("doc_id"), "kept", "n_bytes", "n_removed", "n_spans")
