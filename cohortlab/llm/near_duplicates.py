"""MinHash near-dedup by an LSH forest.

Texts become sets of word shingles; equal sets are one class from the start. Each class has one signature, read in several orders:
a tree of the forest is the table of classes sorted by one stretch of the signature. A class's candidates are its neighbours in each
order, those of the longest common prefixes whose signatures agree best, and the first document of the region at several depths.
Where a region is dense the neighbours share long prefixes, where it is sparse short ones, so depth adapts by itself and no region
is paired out. Candidates that the signature makes plausible are confirmed on full sets; components give the groups.

Where a class's region is larger than what is looked at, only a longer prefix is sure to be found in that order. A class for which
this raises the chance of missing a link to more than twice that of full regions, or that had more plausible neighbours than are
taken, is open. Open classes are completed exactly: two sets that are alike enough share one of the rarest shingles of both, so open
classes meet at their rarest shingles, by hash, in chunks, and only where a shingle joins different groups; no partner is capped. A
bound on what two sets can share, from counts of their shingles in bins, spares most of the pairs the comparison of full sets.

Defined cases: NULL, empty and wordless texts have an empty set, link with nothing and are kept; texts with fewer words than a
shingle are one shingle; a missing id counts as the largest and is shown as NULL (such rows lead a group only among themselves);
repeated rows fall into one class; an empty table gives an empty result; other columns are ignored or, in `keep_one`, kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlab.llm.common import keyed, shown_id
from cohortlab.llm.graph import BITMAP_BITS, among, bitmap, components, place
from cohortlab.llm.textscan import CODES, Block, Words, blocks, mix
from cohortlab.staging import stage

SHINGLE, SIMILARITY = 5, 0.8
TREES, DEPTH = 12, 8
# The signature travels with each tree for the estimate, each value cut to a byte. How far below the threshold an estimate may lie:
# five standard errors.
SKETCH, SLACK = TREES * DEPTH, 0.2
# Neighbours looked at on either side, those taken in one tree, and the prefix they must share.
REACH, TAKEN, LEAST_PREFIX = 32, 4, 2
LEADER_DEPTHS = (2, 3, 4, 6, 8)
# How often the chance of missing a link may be that of a forest whose regions are all looked at: below 10^-5 at similarity 0.8.
MISSED = 2.0
# In place of a depth: nothing of a region is sure to be seen; the class is open whatever its other trees say.
UNSEEN, OPEN = DEPTH + 1, DEPTH + 2
# Bins in which the shingles of a set are counted for the bound on what two sets share.
BINS = 256
# Counters that tell rare shingles from common ones: a fixed 4 MB, whatever the input. Any order of shingles is exact; a good one is fast.
COUNTERS = 2**20
# Open classes at one shingle are compared in chunks of about this many.
CHUNK = 256
_A = mix(np.arange(1000, 1000 + TREES * DEPTH, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(5000, 5000 + TREES * DEPTH, dtype=np.uint64))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hash) of the different shingles of each text, by document, then hash."""
    at, h = words.windows(k)
    doc = words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        whole = np.array([mix(np.bitwise_xor.reduce(mix(words.hash[a:b] + CODES[: b - a] * np.uint64(3))) ^ CODES[[b - a]])[0]
                          for a, b in zip(words.first[short], words.first[short + 1])], np.uint64)
        doc, h = np.concatenate((doc, short)), np.concatenate((h, whole))
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint16) if len(words.count) < 65536 else doc[order], kind="stable")]
    doc, h = doc[order], h[order]
    fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, bool)
    return doc[fresh], h[fresh]


def _named(doc: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the sets of a batch, and two hashes of each: what a class is named by."""
    n = np.bincount(doc, minlength=rows)
    full = np.flatnonzero(n)
    one, two = np.zeros((2, rows), np.uint64)
    if len(full):
        start = (np.cumsum(n) - n)[full]
        one[full], two[full] = np.add.reduceat(mix(h), start), np.bitwise_xor.reduceat(h, start)
    return n, one.view(np.int64), two.view(np.int64)


def _signatures(k: int):
    def run(batches):
        for batch in blocks(batches):
            doc, h = shingles(Block(batch.column("text")).words(lower=True), k)
            n, one, two = _named(doc, h, batch.num_rows)
            full = np.flatnonzero(n)
            start = (np.cumsum(n) - n)[full]
            sig = np.zeros((batch.num_rows, TREES * DEPTH), ">u4")
            if len(full):
                for j in range(TREES * DEPTH):
                    sig[full, j] = np.minimum.reduceat((h * _A[j] + _B[j]) >> np.uint64(32), start)
            raw = sig.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("rk"), pa.array(n), pa.array(one), pa.array(two),
                 pa.array([raw[i: i + 4 * TREES * DEPTH] for i in range(0, len(raw), 4 * TREES * DEPTH)], pa.binary())],
                names=["doc", "rk", "n", "one", "two", "sig"])
    return run


def _trees(batches):
    """A row per class and tree: the tree's stretch of the signature, and the sketch."""
    for batch in batches:
        rows = batch.num_rows
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), ">u4").reshape(rows, TREES * DEPTH)
        sketch = (sig[:, :SKETCH] & 255).astype(np.uint8).tobytes()
        sketch = pa.array([sketch[i: i + SKETCH] for i in range(0, len(sketch), SKETCH)], pa.binary())
        for t in range(TREES):
            raw = np.ascontiguousarray(sig[:, t * DEPTH: (t + 1) * DEPTH]).tobytes()
            label = pa.array([raw[i: i + 4 * DEPTH] for i in range(0, len(raw), 4 * DEPTH)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(rows, t, np.int32)), label, batch.column("cls"), batch.column("doc"), sketch],
                names=["tree", "label", "cls", "doc", "sketch"])


def _candidates(least: float):
    """Pairs of a sorted stretch: the most alike among neighbours by prefix, and first documents of regions.

    A class paired with itself tells from what depth on its region in a tree was looked at, where that is not the least.
    """
    def run(batches):
        tail, head, last = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column("cls").to_numpy(), batch.column("doc").to_numpy(),
                   np.concatenate((batch.column("tree").to_numpy().astype(">u4")[:, None],
                                   np.frombuffer(b"".join(batch.column("label").to_pylist()), ">u4").reshape(-1, DEPTH)), 1),
                   np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)]
            if tail is not None:
                now = [np.concatenate(x) for x in zip(tail, now)]
            cls, doc, label, sketch = now
            tail = [x[-2 * REACH:] for x in now]
            n = len(cls)

            def alike(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                share = np.concatenate([(sketch[i[a: a + 65536]] == sketch[j[a: a + 65536]]).mean(1) for a in range(0, len(i), 65536)]
                                       or [np.zeros(0)])
                good = share >= least
                return i[good], j[good], share[good]

            run_of = {d: np.concatenate(([0], np.cumsum((label[1:, : d + 1] != label[:-1, : d + 1]).any(1)))) for d in LEADER_DEPTHS} if n else {}
            # Not seen at a depth: rows with a row of their region out of reach, and those of the regions at either end of this task's rows.
            seen = np.full(n, LEAST_PREFIX, np.int32)
            end = max(0, n - 2 * REACH)
            last = cls[end:], label[end:, 0].astype(np.int32), np.full(n - end, LEAST_PREFIX, np.int32)
            if head is None:
                head = label[0].copy()
            for d, deeper in zip(LEADER_DEPTHS, (*LEADER_DEPTHS[1:], UNSEEN)):
                region = run_of[d]
                far = np.flatnonzero(region[REACH + 1:] == region[:-REACH - 1])
                for at in (far, far + REACH + 1, np.flatnonzero((label[:, : d + 1] == head[: d + 1]).all(1))):
                    seen[at] = deeper
                last[2][region[end:] == region[-1]] = deeper
            near = []
            for step in range(1, min(REACH, n - 1) + 1):
                i = np.flatnonzero(run_of[LEAST_PREFIX][step:] == run_of[LEAST_PREFIX][:-step])
                if not len(i):
                    break
                near.append(alike(i + step, i))
            pairs = [np.zeros((0, 2), np.int64)]
            if near:
                i, j, share = (np.concatenate([x[k] for x in near]) for k in range(3))
                one, other, share = np.concatenate((i, j)), np.concatenate((j, i)), np.concatenate((share, share))
                order = np.lexsort((doc[other], -share, one))
                one, other = one[order], other[order]
                start = np.flatnonzero(np.concatenate(([True], one[1:] != one[:-1]))) if len(one) else one
                place_ = np.arange(len(one)) - np.repeat(start, np.diff(np.concatenate((start, [len(one)]))))
                pairs.append(np.stack((one, other), 1)[place_ < TAKEN])
                seen[one[place_ >= TAKEN]] = OPEN
            for runs in run_of.values():
                order = np.lexsort((doc, runs))
                first = order[np.concatenate(([True], runs[order][1:] != runs[order][:-1]))][runs]
                i = np.flatnonzero(first != np.arange(n))
                pairs.append(np.stack(alike(i, first[i])[:2], 1))
            pairs = cls[np.concatenate(pairs)]
            pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
            yield _found(pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int32), np.zeros(len(pairs), np.int32))
            yield _unseen(cls, label[:, 0].astype(np.int32), seen)
        if last is not None:
            yield _unseen(*last)
    return run


def _found(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "tree", "depth"])


def _unseen(cls: np.ndarray, tree: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(seen > LEAST_PREFIX)
    return _found(cls[at], cls[at], tree[at], seen[at])


def _open(found: DataFrame, similarity: float) -> DataFrame:
    """(cls) of the classes of which more links may be missed than MISSED allows, by the depths seen in each tree."""
    least = 1 - similarity ** LEAST_PREFIX
    missed = F.when(F.col("depth") == UNSEEN, F.lit(1.0)).otherwise(1 - F.pow(F.lit(similarity), F.col("depth"))) / least
    return found.where("a = b").groupBy(F.col("a").alias("cls")).agg(F.max("depth").alias("depth"), F.sum(F.log(missed)).alias("missed")).where(
        (F.col("depth") == OPEN) | (F.col("missed") > float(np.log(MISSED)))).select("cls")


def _elements(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the full sets of a batch, and (row number, shingle) of all of their elements."""
    full = batch.column("full").to_pylist()
    n = np.array([len(x) // 8 for x in full], np.int64)
    return n, np.repeat(np.arange(len(n)), n), np.frombuffer(b"".join(full), "<u8")


def _counted(batches):
    """Counters of the shingles of a task's sets."""
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        np.add.at(counts, (_elements(batch)[2] % np.uint64(COUNTERS)).astype(np.int64), 1)
    at = np.flatnonzero(counts)
    for i in range(0, len(at), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(at[i: i + 65536]), pa.array(counts[at[i: i + 65536]])], names=["at", "n"])


def _rarest(shared, percent: int, bits=None):
    """(shingle, class, group, size, place) of the rarest shingles of a set, so many that any set alike enough has one of them too.

    With `bits` only shingles in the bitmap are given.
    """
    def run(batches):
        for batch in batches:
            n, row, h = _elements(batch)
            order = np.lexsort((h, shared.value[(h % np.uint64(COUNTERS)).astype(np.int64)], row))
            row, h = row[order], h[order]
            at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            first = at <= (n - -(-percent * n // 100))[row]
            if bits is not None:
                first[first] = among(bits.value, (h[first] % np.uint64(BITMAP_BITS)).astype(np.int64))
            row = row[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[first].view(np.int64)), batch.column("cls").take(pa.array(row)), batch.column("root").take(pa.array(row)),
                 pa.array(n[row].astype(np.int32)), pa.array(at[first].astype(np.int32))], names=["h", "cls", "root", "n", "at"])
    return run


def _meet(percent: int):
    """Pairs of different groups among the entries of each (shingle, chunk, chunk), as sizes and places allow; entries come sorted."""
    def pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, lo, hi, own, cls, root, n, at = (batch.column(c).to_numpy() for c in ("h", "lo", "hi", "own", "cls", "root", "n", "at"))
        fresh = (h[1:] != h[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        group = np.concatenate(([0], np.cumsum(fresh)))
        out = []
        for step in range(1, len(h)):
            i = np.flatnonzero(group[step:] == group[:-step])
            if not len(i):
                break
            j = i + step
            i, j = (x[(root[i] != root[j]) & ((lo[i] == hi[i]) | (own[i] != own[j]))] for x in (i, j))
            most = np.minimum(n[i] - at[i], n[j] - at[j])
            good = most * (100 + percent) >= percent * (n[i] + n[j])
            out.append(np.stack((i[good], j[good]), 1))
        both = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        swap = cls[both[:, 0]] > cls[both[:, 1]]
        both[swap] = both[swap][:, ::-1]
        both = np.unique(np.concatenate((cls[both], root[both]), 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, c]) for c in range(4)], names=["a", "b", "ra", "rb"])

    def run(batches):
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if tail is not None:
                batch = pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
            key = [batch.column(c).to_numpy() for c in ("h", "lo", "hi")]
            # The last group may go on in the next batch.
            cut = batch.num_rows - int(np.argmin(np.append(np.all([k[::-1] == k[-1] for k in key], axis=0), False)))
            tail = batch.slice(cut)
            if cut:
                yield pairs(batch.slice(0, cut))
        if tail is not None:
            yield pairs(tail)
    return run


def _sets(paired, opened, k: int):
    """Full shingle sets of the rows whose key is in one of the bitmaps, with what names their class."""
    def run(batches):
        for batch in blocks(batches):
            at = batch.column("place").to_numpy()
            in_pair, in_open = among(paired.value, at), among(opened.value, at)
            kept = in_pair | in_open
            batch = batch.filter(pa.array(kept))
            if batch.num_rows:
                doc, h = shingles(Block(batch.column("text")).words(lower=True), k)
                n, one, two = _named(doc, h, batch.num_rows)
                offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=batch.num_rows)))).astype(np.int32) * 8
                data = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(h.astype("<u8"))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(n), pa.array(one), pa.array(two), pa.array(in_pair[kept]), pa.array(in_open[kept]), data],
                    names=["n", "one", "two", "paired", "opened", "full"])
    return run


def _binned(batches):
    """Sizes of sets, and how many of their shingles fall into each bin; no counts where one does not fit a byte."""
    for batch in batches:
        n, row, h = _elements(batch)
        bins = np.bincount(row * BINS + (h % np.uint64(BINS)).astype(np.int64), minlength=len(n) * BINS).reshape(len(n), BINS)
        fits = bins.max(1, initial=0) < 256
        raw = bins.astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [batch.column("cls"), pa.array(n), pa.array([x.tobytes() if good else b"" for x, good in zip(raw, fits)], pa.binary())],
            names=["cls", "n", "bins"])


def _bounded(percent: int):
    """The pairs that may be alike enough: two sets share at most the lesser count of each bin."""
    def run(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            keep = np.ones(batch.num_rows, bool)
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            known = np.array([i for i in range(len(x)) if x[i] and y[i]], np.int64)
            if len(known):
                x, y = (np.frombuffer(b"".join(z[i] for i in known), np.uint8).reshape(-1, BINS) for z in (x, y))
                most = np.minimum(x, y).sum(1, dtype=np.int64)
                keep[known] = most * (100 + percent) >= percent * (n[known] + m[known])
            yield batch.select(["a", "b", "ra", "rb"]).filter(pa.array(keep))
    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.concatenate((x, y))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * same >= percent * (len(x) + len(y) - same)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    return pairs.join(sets.select(F.col("cls").alias("a"), F.col("full").alias("x")), "a").join(
        sets.select(F.col("cls").alias("b"), F.col("full").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(
        _confirm(percent), "a long, b long")


def _single(sets: DataFrame) -> DataFrame:
    """One set of each class: rows that are repeated have theirs more than once."""
    return sets.groupBy("cls").agg(F.any_value("full").alias("full"))


def _completed(opened: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the groups that further links join: all links between open classes (cls, root, full) of different groups."""
    spark = opened.sparkSession
    opened = stage(opened)
    counts = opened.select("full").mapInArrow(_counted, "at long, n long").groupBy(F.col("at").cast("int").alias("at")).agg(
        F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    table = np.zeros(COUNTERS, np.int32)
    table[counts["at"].to_numpy()] = counts["n"].to_numpy()
    del counts
    shared = spark.sparkContext.broadcast(table)
    kinds = "h long, cls long, root long, n int, at int"
    # Shingles of one group only need no comparison. Those of several are marked in a bitmap of fixed size, so only their entries travel.
    words = opened.mapInArrow(_rarest(shared, percent), kinds).groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(
        "low != high").select(F.pmod("h", F.lit(BITMAP_BITS)).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))).alias("bits")).toArrow()
    bits = np.zeros(BITMAP_BITS // 64, np.int64)
    bits[words["w"].to_numpy()] = words["bits"].to_numpy()
    del words
    entries = stage(opened.mapInArrow(_rarest(shared, percent, spark.sparkContext.broadcast(bits)), kinds))
    # The largest group at a shingle is not compared with itself: chunks of it (from 0 on) meet chunks of the rest, which meet each other too.
    sizes = entries.groupBy("h", "root").agg(F.count("*").alias("rows")).groupBy("h").agg(
        F.max(F.struct("rows", "root")).alias("top"), F.sum("rows").alias("rows"), F.count("*").alias("roots")).where("roots > 1")
    sizes = sizes.select("h", F.col("top.root").alias("top"), F.ceil(F.col("top.rows") / CHUNK).cast("int").alias("main"),
                         F.ceil((F.col("rows") - F.col("top.rows")) / CHUNK).cast("int").alias("rest"))
    at_top = F.col("root") == F.col("top")
    own = entries.join(sizes, "h").withColumn("own", F.when(at_top, F.pmod(F.xxhash64("cls"), "main")).otherwise(
        F.col("main") + F.pmod(F.xxhash64("cls"), "rest")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.when(at_top, F.col("main")).otherwise(F.lit(0)), F.col("main") + F.col("rest") - 1))).select(
        "h", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "cls", "root", "n", "at")
    pairs = stage(met.repartition("h", "lo", "hi").sortWithinPartitions("h", "lo", "hi").mapInArrow(
        _meet(percent), "a long, b long, ra long, rb long").distinct())
    bins = opened.select("cls", "full").mapInArrow(_binned, "cls long, n long, bins binary")
    likely = stage(pairs.join(bins.select(F.col("cls").alias("a"), "n", F.col("bins").alias("x")), "a").join(
        bins.select(F.col("cls").alias("b"), F.col("n").alias("m"), F.col("bins").alias("y")), "b").select(
        "a", "b", "ra", "rb", "n", "m", "x", "y").mapInArrow(_bounded(percent), "a long, b long, ra long, rb long"))
    met = stage(likely.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
    links = _linked(likely.select("a", "b"), opened.join(met, "cls", "left_semi"), percent).join(likely, ["a", "b"])
    return components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")))


def groups(docs: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, rk, n_shingles, component) of every row; ids as in `keyed`."""
    rows = keyed(docs, id_col, text_col)
    percent = round(100 * similarity)
    signed = stage(rows.mapInArrow(_signatures(k), "doc long, rk long, n long, one long, two long, sig binary")
                   .withColumn("cls", F.xxhash64("n", "one", "two")))
    classes = stage(signed.where("n > 0").groupBy("cls").agg(
        F.min(F.struct("doc", "rk")).alias("first"), F.any_value("sig").alias("sig")).select("cls", "first.*", "sig"))
    forest = classes.select("cls", "doc", "sig").mapInArrow(_trees, "tree int, label binary, cls long, doc long, sketch binary")
    found = stage(forest.repartitionByRange("tree", "label", "doc").sortWithinPartitions("tree", "label", "doc").mapInArrow(
        _candidates(similarity - SLACK), "a long, b long, tree int, depth int").groupBy("a", "b", "tree").agg(F.max("depth").alias("depth")))
    pairs, open_ = found.where("a != b").select("a", "b"), stage(_open(found, similarity))
    keys = classes.select("cls", "rk")
    paired = keys.join(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "cls")
    bits = [docs.sparkSession.sparkContext.broadcast(bitmap(x, "rk")) for x in (paired, keys.join(open_, "cls"))]
    # Sets are written where they are made; a key that is not wanted may slip through a bitmap, which does no harm.
    sets = stage(rows.select("rk", "text", place("rk").alias("place")).mapInArrow(
        _sets(*bits, k), "n long, one long, two long, paired boolean, opened boolean, full binary").select(
        F.xxhash64("n", "one", "two").alias("cls"), "paired", "opened", "full"))
    roots = stage(components(_linked(pairs, _single(sets.where("paired")), percent)))
    rest = _completed(_single(sets.where("opened")).join(roots.withColumnRenamed("node", "cls"), "cls", "left").select(
        "cls", F.coalesce("root", "cls").alias("root"), "full"), percent)
    named = classes.select("cls", "doc").join(roots, classes.cls == roots.node, "left").select(
        "cls", "doc", F.coalesce("root", "cls").alias("node"))
    named = named.join(rest, "node", "left").select("cls", "doc", F.coalesce("root", "node").alias("root"))
    smallest = named.groupBy("root").agg(F.min("doc").alias("component"))
    named = named.join(smallest, "root").select("cls", "component")
    return signed.select("doc", "rk", "n", "cls").join(named, "cls", "left").select(
        "doc", "rk", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc")).alias("component"))


def report(docs: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    return groups(docs, k, similarity, id_col, text_col).select(
        shown_id(F.col("doc")).alias("doc_id"), "n_shingles", shown_id(F.col("component")).alias("component_id"),
        (F.col("doc") == F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that lead their group, columns unchanged; of rows equal in id and text one stays."""
    found = groups(docs, k, similarity, id_col, text_col).where("doc = component").select("rk").distinct()
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("bigint"), F.lit(2**63 - 1)), F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(key.alias("rk"), F.struct("*").alias("row")).join(found, "rk").groupBy("rk").agg(
        F.any_value("row").alias("row")).select("row.*")
