"""The entries of one large JSON object, read as byte ranges by many tasks.

A file is cut into chunks anywhere. A task tells for its chunk how many quotes stand in it and how deep brackets go, for both cases of
what came before: inside a string or not. Sums over the chunks of a file settle the case and the depth at each start; a second pass
then finds the commas between top-level entries, and every entry is read by itself. Tasks go through a chunk block by block.

A long entry of arrays can be read in pieces: its chunks are searched for its arrays, commas are counted block by block, sums of the
counts give every element its number, and arrays of an entry are cut at the same numbers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohortlab.sources.placed import store_of
from cohortlab.staging import stage

CHUNK_BYTES = 32_000_000
# What a task holds of a chunk at once.
BLOCK_BYTES = 1_000_000
# Elements of each array in a piece of a long entry.
PIECE_ROWS = 10_000
_QUOTE, _SLASH, _COMMA, _OPEN, _ARRAY = ord('"'), ord("\\"), ord(","), ord("{"), ord("[")
# Inside an entry: an array or another bracket opens, one closes, and commas between elements.
_FIELD, _OTHER, _END, _COMMAS = range(4)
_STEP = np.zeros(256, np.int8)
_STEP[list(b"{[")] = 1
_STEP[list(b"}]")] = -1
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n")] = True


class _Chunk:
    """Bytes of a file with their quotes that are not escaped, and brackets."""

    def __init__(self, path: str, start: int, end: int):
        store, name = store_of(path)
        with store.open_input_file(name) as source:
            source.seek(start)
            raw = source.read(end - start)
            lead = self._slashes(source, start)
        self.bytes = np.frombuffer(raw, np.uint8)
        at = np.arange(len(self.bytes))
        quotes = np.flatnonzero(self.bytes == _QUOTE)
        # Back slashes right before a quote: an odd number escapes it.
        plain = np.maximum.accumulate(np.where(self.bytes != _SLASH, at, -1))
        last = np.where(quotes > 0, plain[quotes - 1], -1) if len(quotes) else quotes
        run = quotes - 1 - last + np.where(last < 0, lead, 0)
        self.quotes = quotes[run % 2 == 0]
        self.brackets = np.flatnonzero(_STEP[self.bytes])

    @staticmethod
    def _slashes(source, start: int) -> int:
        n = 0
        while start:
            size = min(start, 4_096)
            source.seek(start - size)
            piece = source.read(size)
            found = size - len(piece.rstrip(b"\\"))
            n, start = n + found, start - size
            if found < size:
                break
        return n

    def outside(self, places: np.ndarray, inside: int) -> np.ndarray:
        """Are the places outside of strings, if the chunk starts inside one or not?"""
        return (np.searchsorted(self.quotes, places) + inside) % 2 == 0

    def depth(self, inside: int) -> int:
        where = self.brackets[self.outside(self.brackets, inside)]
        return int(_STEP[self.bytes[where]].sum(dtype=np.int64))

    def marks(self, inside: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of brackets and commas outside of strings, their steps, and the depth before each."""
        where = np.flatnonzero((_STEP[self.bytes] != 0) | (self.bytes == _COMMA))
        where = where[self.outside(where, inside)]
        step = _STEP[self.bytes[where]].astype(np.int64)
        return where, step, depth + np.cumsum(step) - step

    def edges(self, inside: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, kind) of the object's opening (0), top-level commas (1), closing (2), and of what does not belong outside (3)."""
        where, step, before = self.marks(inside, depth)
        level = np.zeros(len(self.bytes) + 1, np.int64)
        level[where + 1] = step
        level = depth + np.cumsum(level)[:-1]
        kind = np.where((before == 0) & (self.bytes[where] == _OPEN), 0, np.where((before == 1) & (step == 0), 1, np.where((before == 1) & (step < 0), 2, -1)))
        stray = np.flatnonzero((level == 0) & ~_BLANK[self.bytes])
        stray = np.setdiff1d(stray, where[(kind == 0)])[:1]
        stray = np.setdiff1d(stray, where[(kind == 2)])
        kept = kind >= 0
        return np.concatenate((where[kept], stray)), np.concatenate((kind[kept], np.full(len(stray), 3)))


def _blocks(path: str, start: int, end: int) -> Iterator[tuple[int, _Chunk]]:
    """(start, block) of a range, of which one is held at a time."""
    for a in range(start, end, BLOCK_BYTES):
        yield a, _Chunk(path, a, min(a + BLOCK_BYTES, end))


def _in_state(path: str, start: int, end: int, inside: int, depth: int) -> Iterator[tuple[int, _Chunk, int, int]]:
    """Blocks with their start, whether that is inside of a string, and their depth."""
    for a, block in _blocks(path, start, end):
        yield a, block, inside, depth
        depth += block.depth(inside)
        inside = (inside + len(block.quotes)) % 2


def _range(path: str, start: int, end: int) -> str:
    store, name = store_of(path)
    with store.open_input_file(name) as source:
        source.seek(start)
        return source.read(end - start).decode()


def _files(path: str) -> list[tuple[str, int]]:
    """Files at a path, or in a folder, with their sizes; hidden ones are left out."""
    from pyarrow import fs

    store, name = store_of(path)
    info = store.get_file_info(name)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    listed = store.get_file_info(fs.FileSelector(name))
    return [(f"{path.rstrip('/')}/{x.base_name}", x.size) for x in listed if x.type == fs.FileType.File and x.base_name[0] not in "._"]


def object_entries(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, long_bytes: int | None = None) -> DataFrame:
    """(value): each top-level entry of the JSON objects at `path`, as an object of its own.

    A file that is not one object raises; what an entry holds is not looked at. A single entry is read whole, or, if it holds arrays
    and has more than `long_bytes`, as several objects of the same name, in which its arrays are cut at the same elements.
    """
    cuts = [(f, a, min(a + chunk_bytes, size)) for f, size in _files(path) for a in range(0, size, chunk_bytes)]
    chunks = spark.createDataFrame(cuts, "file string, start long, end long").repartition(max(1, len(cuts)), "file", "start")

    def scan(batches):
        for batch in batches:
            found = np.zeros((batch.num_rows, 3), np.int64)
            for i, x in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file", "start", "end")))):
                for _, block in _blocks(*x):
                    odd = found[i, 0]
                    found[i] = (odd + len(block.quotes)) % 2, found[i, 1] + block.depth(odd), found[i, 2] + block.depth(1 - odd)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(found[:, c]) for c in range(3)]],
                names=["file", "start", "end", "odd", "d0", "d1"])

    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = stage(chunks.mapInArrow(scan, "file string, start long, end long, odd long, d0 long, d1 long"))
    inside = (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).alias("inside")
    known = known.select("*", inside).withColumn("d", F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1")))
    known = stage(known.select("file", "start", "end", "inside", "odd", F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("depth"), "d"))

    def find(batches):
        for batch in batches:
            for f, *x in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "end", "inside", "depth"))):
                for a, block, s, d in _in_state(f, *x):
                    at, kind = block.edges(s, d)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f] * len(at), pa.string()), pa.array(at + a, pa.int64()), pa.array(kind, pa.int32())], names=["file", "at", "kind"])

    tasks = max(1, min(len(cuts), spark.sparkContext.defaultParallelism * 4))
    edges = stage(known.repartition(tasks, "file", "start").mapInArrow(find, "file string, at long, kind int"))
    ends = known.groupBy("file").agg((F.sum("odd") % 2).alias("open"), F.sum("d").alias("deep"))
    kinds = edges.groupBy("file").agg(*[F.count_if(F.col("kind") == k).alias(f"n{k}") for k in (0, 2, 3)])
    wrong = ends.join(kinds, "file", "left").where("open <> 0 OR deep <> 0 OR coalesce(n0, 0) <> 1 OR n2 <> 1 OR n3 <> 0").first()
    if wrong:
        raise ValueError(f"MALFORMED: {wrong.file} is not one JSON object")
    order = Window.partitionBy("file").orderBy("at")
    spans = edges.select("file", "kind", (F.col("at") + 1).alias("start"), F.lead("at").over(order).alias("end"), F.lead("kind").over(order).alias("next"))
    spans = spans.where("kind < 2").withColumn("only", (F.col("kind") == 0) & (F.col("next") == 2))

    def read(batches):
        for batch in batches:
            for f, a, b, only in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "end", "only"))):
                text = _range(f, a, b)
                if text.strip(" \t\r\n"):
                    yield pa.RecordBatch.from_arrays([pa.array(["{" + text + "}"])], names=["value"])
                elif not only:
                    raise ValueError(f"MALFORMED: {f} has an empty entry at byte {a}")

    if long_bytes is None:
        return spans.repartition(tasks, "file", "start").mapInArrow(read, "value string")
    spans = stage(spans)
    long = spans.where(F.col("end") - F.col("start") > long_bytes)
    if long.isEmpty():
        return spans.repartition(tasks, "file", "start").mapInArrow(read, "value string")
    marks = stage(_marked(known, long, chunk_bytes, tasks))
    cut = marks.where(F.col("kind") == _FIELD).select("file", F.col("entry").alias("start")).distinct()
    whole = spans.join(cut, ["file", "start"], "left_anti").select(spans.columns)
    return whole.repartition(tasks, "file", "start").mapInArrow(read, "value string").unionByName(_pieces(marks, long, tasks))


def _marked(known: DataFrame, long: DataFrame, chunk_bytes: int, tasks: int) -> DataFrame:
    """(file, entry, at, kind, n, to, field) of the brackets and commas right inside the arrays of long entries.

    Commas come as one row per block and array, the first of them at `at`, the last before `to`; `field` numbers the arrays of an entry.
    """
    def find(batches):
        for batch in batches:
            for f, entry, *x in zip(*(batch.column(c).to_pylist() for c in ("file", "entry", "start", "end", "inside", "depth"))):
                for a, block, s, d in _in_state(f, *x):
                    where, step, before = block.marks(s, d)
                    opens, ends, commas = where[(before == 2) & (step > 0)], where[(before == 3) & (step < 0)], where[(before == 3) & (step == 0)]
                    _, first, n = np.unique(np.searchsorted(np.sort(np.concatenate((opens, ends))), commas), return_index=True, return_counts=True)
                    at = np.concatenate((opens, ends, commas[first]))
                    kind = np.concatenate((np.where(block.bytes[opens] == _ARRAY, _FIELD, _OTHER), np.full(len(ends), _END), np.full(len(n), _COMMAS)))
                    none = np.zeros(len(opens) + len(ends), np.int64)
                    rows = [at + a, kind.astype(np.int64), np.concatenate((none, n)), np.concatenate((none, commas[first + n - 1] + a + 1))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f] * len(at), pa.string()), pa.array(np.full(len(at), entry, np.int64)), *[pa.array(r) for r in rows]],
                        names=["file", "entry", "at", "kind", "n", "to"])

    chunk = F.explode(F.sequence(F.expr(f"start div {chunk_bytes}"), F.expr(f"(end - 1) div {chunk_bytes}"))).alias("chunk")
    parts = long.select("file", F.col("start").alias("entry"), F.col("end").alias("stop"), chunk).join(
        known.withColumn("chunk", F.expr(f"start div {chunk_bytes}")), ["file", "chunk"])
    # An entry starts outside of strings, in the object.
    here = F.col("entry") >= F.col("start")
    parts = parts.select("file", "entry", F.greatest("entry", "start").alias("start"), F.least("stop", "end").alias("end"),
                         F.when(here, 0).otherwise(F.col("inside")).alias("inside"), F.when(here, 1).otherwise(F.col("depth")).alias("depth"))
    found = parts.repartition(tasks, "file", "entry", "start").mapInArrow(find, "file string, entry long, at long, kind long, n long, to long")
    so_far = Window.partitionBy("file", "entry").orderBy("at")
    opens = F.col("kind") <= _OTHER
    return found.select("*", F.sum(opens.cast("long")).over(so_far).alias("field"), F.last(F.when(opens, F.col("kind")), True).over(so_far).alias("shape")).where(
        F.col("shape") == _FIELD).drop("shape")


def _pieces(marks: DataFrame, long: DataFrame, tasks: int) -> DataFrame:
    """(value): the pieces of long entries, as objects of one entry."""
    step = PIECE_ROWS

    def cut(batches):
        for batch in batches:
            for f, entry, field, a, b, base in zip(*(batch.column(c).to_pylist() for c in ("file", "entry", "field", "at", "to", "base"))):
                for start, block, s, d in _in_state(f, a, b, 0, 3):
                    where, step_, before = block.marks(s, d)
                    commas = where[(before == 3) & (step_ == 0)]
                    number = base + 1 + np.arange(len(commas))
                    base += len(commas)
                    at = np.flatnonzero(number % step == 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f] * len(at), pa.string()), *[pa.array(np.full(len(at), x, np.int64)) for x in (entry, field)],
                         pa.array(number[at] // step), pa.array(commas[at] + start)], names=["file", "entry", "field", "piece", "at"])

    def named(batches):
        """Names of an entry and of its arrays, from its text without their elements: in their place stand their numbers."""
        for batch in batches:
            for f, entry, end, ends in zip(*(batch.column(c).to_pylist() for c in ("file", "entry", "end", "ends"))):
                text, start = [], entry
                for x in ends:
                    if x["kind"] == _FIELD:
                        text += [_range(f, start, x["at"] + 1), str(x["field"])]
                    else:
                        start = x["at"]
                try:
                    (name, arrays), = json.loads("{" + "".join(text) + _range(f, start, end) + "}").items()
                    fields = [(key, x[0]) for key, x in arrays.items() if isinstance(x, list)]
                except (ValueError, AttributeError) as error:
                    raise ValueError(f"MALFORMED: the entry of {f} at byte {entry} is not an object of arrays") from error
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f] * len(fields), pa.string()), pa.array([entry] * len(fields), pa.int64()), pa.array([x for _, x in fields], pa.int64()),
                     pa.array([json.dumps(name)] * len(fields), pa.string()), pa.array([json.dumps(key) for key, _ in fields], pa.string())],
                    names=["file", "entry", "field", "name", "key"])

    def read(batches):
        for batch in batches:
            for f, name, piece, arrays in zip(*(batch.column(c).to_pylist() for c in ("file", "name", "piece", "arrays"))):
                texts = [(x["key"], _range(f, x["start"], x["end"])) for x in arrays]
                if piece and not all(text.strip(" \t\r\n") for _, text in texts):
                    raise ValueError(f"MALFORMED: an array of {f} ends with a comma")
                inner = ",".join(f"{key}:[{text}]" for key, text in texts)
                yield pa.RecordBatch.from_arrays([pa.array([f"{{{name}:{{{inner}}}}}"])], names=["value"])

    at = ["file", "entry", "field"]
    # Sums over blocks of an array: a row for each.
    earlier = Window.partitionBy(*at).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    commas = marks.where(F.col("kind") == _COMMAS).select("*", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    commas = commas.where(f"(base + n) div {step} > base div {step}")
    cuts = commas.repartition(tasks, "file", "at").mapInArrow(cut, "file string, entry long, field long, piece long, at long")
    starts = marks.where(F.col("kind") == _FIELD).select(*at, F.lit(0).cast("long").alias("piece"), "at").unionByName(cuts)
    ends = marks.where(F.col("kind") == _END).select(*at, F.col("at").alias("last"))
    ranges = starts.join(ends, at).select(
        *at, "piece", (F.col("at") + 1).alias("start"), F.coalesce(F.lead("at").over(Window.partitionBy(*at).orderBy("piece")), "last").alias("end"))
    outer = marks.where(F.col("kind") != _COMMAS).groupBy("file", "entry").agg(F.sort_array(F.collect_list(F.struct("at", "kind", "field"))).alias("ends"))
    names = outer.join(long.select("file", F.col("start").alias("entry"), "end"), ["file", "entry"]).repartition(tasks, "file", "entry").mapInArrow(
        named, "file string, entry long, field long, name string, key string")
    whole = ranges.join(names, at).groupBy("file", "entry", "name", "piece").agg(F.collect_list(F.struct("key", "start", "end")).alias("arrays"))
    return whole.repartition(tasks, "file", "entry", "piece").mapInArrow(read, "value string")
