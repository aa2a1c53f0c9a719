"""Token ids in binary shards, each a wavelet matrix in one compressed file.

Documents are range-sorted by id, encoded with the tokenizers library and cut into shards of bounded size. A shard numbers its
different tokens by frequency and keeps one plane of bits per binary digit of these numbers; each plane puts the zeros of the plane
before it first. Planes lie in blocks, compressed one by one, with the ones before each block, so rank and select read a block per
plane: `access` gives a token, `count` counts one in a stretch, `occurrences` finds its places, and `decode` undoes the planes of a whole
shard. Ids, ends of documents and the table of tokens lie in the same file.

Tasks write files under names of their own and hand over a row for each; rows are staged, so what a lost or repeated task leaves
behind is never read. Where a shard starts among all tokens follows from sums per range, not from one ordered pass.

The tokenizer at hand drops white space and case and never joins letters to stops and commas, so words between ASCII white space, cut
there and in lower case, are encoded once and cached, those of ASCII letters by the model alone, as the steps before it leave them as
they are. Whether that holds is tried on odd texts before, and each task compares its first text. Tokenizers for which it does not hold
get whole texts.

Defined cases: NULL and empty texts have the end id alone; a missing id comes last and stays missing; rows of equal ids follow by a
hash of their text; an empty table has no shard; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections import OrderedDict
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cohortlab.llm.common import NO_ID, keyed
from cohortlab.llm.textscan import Block, blocks
from cohortlab.staging import new_folder, stage

MODEL = "/opt/tokenizers/word_bpe_49k.json"
END_ID = 2
# Tokens of a shard, text of a range, bits of a block, and words that one process remembers.
SHARD_TOKENS = 2_000_000
RANGE_BYTES = 32_000_000
LEAST_RANGES = 8
BLOCK_BITS = 2**16
KNOWN_WORDS = 600_000
# Parts of a number of ranges that one window adds up.
RANGES_TOGETHER = 1_000
MAGIC = b"WVM1"
ODD_TEXTS = ["", " \t\n", "Plain words, twice  over. a.b,c;D:e!f?G...h 1.5,x", "end.'s ,'t x.\u0301 a\u0301.B \u212a.K", "it's we've I'LL'd", "Éá ́x 가 ﬁ İ", "a b c\x85d\x1ce\x00f",
             "日本語 12345 ½ <|endoftext|> <|endoftext|>x", "\U0001F600‍\U0001F600 ΑΣ ΑΣ. ς"]
# Kinds of bytes: white space, what parts of words may be cut between (letters, digits; stops and commas), and others.
_KIND = np.ones(256, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 2
_KIND[list(b".,;:!?")] = 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long"


def build(ids: np.ndarray, ends: np.ndarray, docs: np.ndarray, block_bits: int = BLOCK_BITS) -> bytes:
    """The file of a shard: `docs[i]` has the tokens up to `ends[i]`."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    often = np.bincount(ids)
    tokens = np.flatnonzero(often)
    tokens = tokens[np.argsort(-often[tokens], kind="stable")]
    levels = max(1, int(len(tokens) - 1).bit_length()) if len(tokens) else 0
    rank = np.zeros(len(often), np.uint16 if levels <= 16 else np.uint32)
    rank[tokens] = np.arange(len(tokens))
    now = rank[ids]
    body, head = [], {"n_tokens": len(ids), "n_docs": len(docs), "block_bits": block_bits, "planes": []}
    at = 0

    def put(data: bytes) -> tuple[int, int]:
        nonlocal at
        data = pack(data)
        body.append(data)
        at += len(data)
        return at - len(data), len(data)

    for level in reversed(range(levels)):
        one = (now >> np.array(level, now.dtype)) & np.array(1, now.dtype) != 0
        starts = np.arange(0, len(one), block_bits)
        ones = np.cumsum(np.add.reduceat(one, starts, dtype=np.int64)) if len(one) else np.zeros(0, np.int64)
        bits = np.packbits(one)
        spots = [put(bits[s // 8: (s + block_bits) // 8].tobytes()) for s in starts]
        head["planes"].append({"zeros": int(len(one) - ones[-1]), "ones": [0, *ones.tolist()], "blocks": spots})
        now = np.concatenate((now[~one], now[one]))
    head["tokens"] = put(tokens.astype("<u4").tobytes())
    head["ends"] = put(ends.astype("<i8").tobytes())
    head["docs"] = put(docs.astype("<i8").tobytes())
    top = pack(json.dumps(head).encode())
    return MAGIC + struct.pack("<I", len(top)) + top + b"".join(body)


class Shard:
    """A shard's file, opened; blocks of planes are read when they are needed, and at most `held` of them are kept."""

    def __init__(self, source, held: int = 256):
        import zstandard

        self._unpack = zstandard.ZstdDecompressor().decompress
        self._read = (lambda at, n: source[at: at + n]) if isinstance(source, bytes) else self._reader(source)
        if self._read(0, 4) != MAGIC:
            raise ValueError("not a shard of tokens")
        (size,) = struct.unpack("<I", self._read(4, 4))
        head = json.loads(self._unpack(self._read(8, size)))
        self._body = 8 + size
        self.n_tokens, self.n_docs, self._bits = head["n_tokens"], head["n_docs"], head["block_bits"]
        self._planes = head["planes"]
        self._ones = [np.array(p["ones"], np.int64) for p in self._planes]
        self._zeros = [p["zeros"] for p in self._planes]
        self.tokens, self.ends, self.docs = (np.frombuffer(self._part(head[k]), t) for k, t in (("tokens", "<u4"), ("ends", "<i8"), ("docs", "<i8")))
        self._rank: dict[int, int] | None = None
        self._held, self._kept = held, OrderedDict()

    @staticmethod
    def _reader(source):
        def read(at: int, n: int) -> bytes:
            source.seek(at)
            return source.read(n)

        return read

    def _part(self, spot) -> bytes:
        return self._unpack(self._read(self._body + spot[0], spot[1]))

    def _block(self, level: int, number: int) -> np.ndarray:
        """The bits of a block, as bytes of 0 and 1."""
        key = (level, number)
        if key not in self._kept:
            self._kept[key] = np.unpackbits(np.frombuffer(self._part(self._planes[level]["blocks"][number]), np.uint8))
            if len(self._kept) > self._held:
                self._kept.popitem(last=False)
        else:
            self._kept.move_to_end(key)
        return self._kept[key]

    def _ones_before(self, level: int, i: int) -> int:
        number, rest = divmod(i, self._bits)
        return int(self._ones[level][number]) + (int(self._block(level, number)[:rest].sum()) if rest else 0)

    def _code(self, token: int) -> int | None:
        if self._rank is None:
            self._rank = {t: i for i, t in enumerate(self.tokens.tolist())}
        return self._rank.get(token)

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        code = 0
        for level, zeros in enumerate(self._zeros):
            number, rest = divmod(i, self._bits)
            ones = self._ones_before(level, i)
            bit = int(self._block(level, number)[rest])
            i = zeros + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.tokens[code])

    def _stretch(self, code: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the code's occurrences between lo and hi stand below the last plane."""
        depth = len(self._zeros)
        for level, zeros in enumerate(self._zeros):
            a, b = self._ones_before(level, lo), self._ones_before(level, hi)
            lo, hi = (zeros + a, zeros + b) if code >> (depth - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often a token stands at places lo to hi, hi excluded."""
        code = self._code(token)
        lo, hi = max(0, lo), self.n_tokens if hi is None else min(hi, self.n_tokens)
        if code is None or lo >= hi:
            return 0
        a, b = self._stretch(code, lo, hi)
        return b - a

    def _select(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Places of the k-th (from 0, ascending) bits of one kind in a plane."""
        before = self._ones[level] if bit else np.minimum(np.arange(len(self._ones[level])) * self._bits, self.n_tokens) - self._ones[level]
        number = np.searchsorted(before, k, "right") - 1
        out = np.empty(len(k), np.int64)
        edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(k)]
        for a, b in zip(edges, edges[1:]):
            block = int(number[a])
            places = np.flatnonzero(self._block(level, block) == bit)
            out[a:b] = block * self._bits + places[k[a:b] - before[block]]
        return out

    def occurrences(self, token: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """All places of a token between lo and hi, ascending."""
        code = self._code(token)
        lo, hi = max(0, lo), self.n_tokens if hi is None else min(hi, self.n_tokens)
        if code is None or lo >= hi:
            return np.zeros(0, np.int64)
        at = np.arange(*self._stretch(code, lo, hi))
        for level in reversed(range(len(self._zeros))):
            if not len(at):
                break
            bit = code >> (len(self._zeros) - 1 - level) & 1
            at = self._select(level, bit, at - (self._zeros[level] if bit else 0))
        return at

    def decode(self) -> np.ndarray:
        """All tokens in order."""
        depth = len(self._zeros)
        codes = np.zeros(self.n_tokens, np.uint16 if depth <= 16 else np.uint32)
        for level in reversed(range(depth)):
            bits = b"".join(self._part(x) for x in self._planes[level]["blocks"])
            one = np.unpackbits(np.frombuffer(bits, np.uint8), count=self.n_tokens).view(bool)
            zeros = self._zeros[level]
            above = np.empty_like(codes)
            above[~one] = codes[:zeros]
            above[one] = codes[zeros:] | np.array(1 << (depth - 1 - level), codes.dtype)
            codes = above
        return self.tokens[codes]


class Encoder:
    """Ids of texts. Different words are encoded once and remembered, where the tokenizer allows it."""

    def __init__(self, data: bytes, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.core = Tokenizer.from_buffer(data)
        self.model, self.end = self.core.model, end_id
        self.by_word = True
        self._forget()
        self.by_word = self.agrees(ODD_TEXTS)

    def _forget(self):
        """Only the end is known, as a word of its own."""
        self.known: dict[str, int] = {"": 0}
        self.starts, self.lengths = np.zeros(1, np.int32), np.ones(1, np.int32)
        self.pool = np.array([self.end], np.uint32)

    def _flat(self, texts: list[str], words: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids; of `words`, those of small ASCII letters go to the model."""
        ids: list = [None] * len(texts)
        other = range(len(texts))
        if words:
            tokenize = self.model.tokenize
            other = []
            for i, w in enumerate(texts):
                if w.isalpha() and w.isascii() and w.islower():
                    ids[i] = [t.id for t in tokenize(w)]
                else:
                    other.append(i)
        for i, e in zip(other, self.core.encode_batch_fast([texts[i] for i in other], add_special_tokens=False)):
            ids[i] = e.ids
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        return lengths, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))

    def agrees(self, texts: list[str]) -> bool:
        """Do words one by one give the ids of the whole texts?"""
        whole = self._flat(texts)
        return all(np.array_equal(a, b) for a, b in zip(whole, self.encode(pa.array(texts, pa.string()), False)))

    def encode(self, texts: pa.Array, end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids in a row."""
        if not self.by_word:
            counts, flat = self._flat([t or "" for t in texts.to_pylist()])
            return (counts + 1, np.insert(flat, np.cumsum(counts), np.uint32(self.end))) if end else (counts, flat)
        block = Block(texts)
        # Names of special tokens are matched as they are written.
        low = block.bytes if b"<|" in block.raw else _LOWER[block.bytes]
        kind = _KIND[low]
        before = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))
        cut = (kind != before) & ((kind == 0) | (before == 0) | (kind + before == 5))
        edge = np.flatnonzero(cut)
        start = edge[kind[edge] > 0]
        ends = np.append(edge, len(low))
        stop = ends[np.flatnonzero(kind[edge] > 0) + 1]
        offsets = np.concatenate(([0], np.cumsum(stop - start))).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(low[kind > 0])]).dictionary_encode()
        at = self._numbers(words.dictionary.to_pylist())[words.indices.to_numpy(zero_copy_only=False)]
        held = np.searchsorted(start, np.append(block.begins, len(low)))
        if end:
            with_end = np.zeros(len(at) + len(texts), np.int32)  # zeros stand for the end
            inside = np.ones(len(with_end), bool)
            inside[held[1:] + np.arange(len(texts))] = False
            with_end[inside] = at
            at, held = with_end, held + np.arange(len(held))
        n = self.lengths[at]
        stops = np.cumsum(n)
        place = np.repeat((self.starts[at] - (stops - n)).astype(np.int32), n)
        place += np.arange(len(place), dtype=np.int32)
        return np.diff(np.concatenate(([0], stops))[held]), self.pool[place]

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Where the words' ids are in the pool; unknown words are encoded in one batch."""
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            lengths, flat = self._flat(new, words=True)
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.starts = np.concatenate((self.starts, (len(self.pool) + np.cumsum(lengths) - lengths).astype(np.int32)))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.pool = np.concatenate((self.pool, flat))
        return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


@lru_cache(maxsize=1)
def _encoder(data: bytes, end_id: int) -> Encoder:
    """One encoder for a process, whatever number of tasks it runs."""
    return Encoder(data, end_id)


def _store(folder: str):
    """The file system of a folder, and its path there."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _writer(shared, end_id: int, folder: str, shard_tokens: int):
    def write(batches):
        encoder = _encoder(shared.value, end_id)
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        held: list[tuple] = []
        total, seq, part, tried = 0, 0, None, False

        def close() -> pa.RecordBatch:
            nonlocal total, seq
            docs, counts, ids = (np.concatenate(x) for x in zip(*held))
            name = f"tokens-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.wvm"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(build(ids, np.cumsum(counts), docs))
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([name]), pa.array([len(docs)], pa.int64()),
                 pa.array([len(ids)], pa.int64())], names=["part", "seq", "path", "n_docs", "n_tokens"])
            held.clear()
            total, seq = 0, seq + 1
            return row

        for batch in blocks(batches):
            part = batch.column("part")[0].as_py()
            if not tried and encoder.by_word:
                tried = True
                if not encoder.agrees([batch.column("text")[0].as_py()]):
                    raise ValueError("words one by one give other ids than whole texts")
            counts, ids = encoder.encode(batch.column("text"))
            held.append((batch.column("doc").to_numpy(zero_copy_only=False), counts, ids))
            total += len(ids)
            if total >= shard_tokens:
                yield close()
        if held:
            yield close()

    return write


def write_shards(
    docs: DataFrame, folder: str | None = None, path: str = MODEL, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Write the ids of all texts in order of document ids; returns the staged (part, seq, path, n_docs, n_tokens, start) of each shard.

    `folder` must be one that all tasks reach; left out, it is a new one in the shared folder.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    data = bytes(spark.read.format("binaryFile").load(f"file://{path}" if path.startswith("/") else path).first().content)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    ranges = max(LEAST_RANGES, -(-size // RANGE_BYTES))
    rows = keyed(docs, id_col, text_col)
    ordered = rows.repartitionByRange(ranges, "doc", "rk").sortWithinPartitions("doc", "rk").select(
        F.spark_partition_id().alias("part"), "doc", "text")
    shards = stage(ordered.mapInArrow(_writer(spark.sparkContext.broadcast(data), end_id, folder, shard_tokens), MANIFEST))
    return stage(_starts(shards).withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), "path")))


def _starts(shards: DataFrame) -> DataFrame:
    """Where each shard starts: sums of groups of ranges, of ranges in a group, of shards in a range."""
    def before(df: DataFrame, within: list, by: str, value: str, name: str) -> DataFrame:
        window = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0)))

    together = (F.col("part") / RANGES_TOGETHER).cast("int").alias("group")
    ranges = shards.groupBy(together, "part").agg(F.sum("n_tokens").alias("n"))
    groups = before(ranges.groupBy("group").agg(F.sum("n").alias("n")), [], "group", "n", "_g").drop("n")
    ranges = before(ranges, ["group"], "part", "n", "_p").join(groups, "group").select("part", (F.col("_g") + F.col("_p")).alias("_b"))
    inside = before(shards, ["part"], "seq", "n_tokens", "_s")
    return inside.join(ranges, "part").select("part", "seq", "path", "n_docs", "n_tokens", (F.col("_b") + F.col("_s")).alias("start"))


def open_shard(path: str) -> Shard:
    store, name = _store(path)
    return Shard(store.open_input_file(name))


def _over_shards(shards: DataFrame, found, schema: str, extra: list[str]) -> DataFrame:
    """`found(shard, row)` gives a batch for each shard, in parallel over shards."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield found(open_shard(row["path"]), row)

    tasks = max(1, shards.sparkSession.sparkContext.defaultParallelism * 4)
    return shards.select("path", *extra).repartition(tasks, "path").mapInArrow(run, schema)


def _shown(docs: np.ndarray) -> pa.Array:
    return pa.array(docs, pa.int64(), mask=docs == NO_ID)


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, read back from the files."""
    def read(shard: Shard, row: dict) -> pa.RecordBatch:
        ends = shard.ends
        begins = np.concatenate(([0], ends[:-1]))
        ids = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], ends))), pa.array(shard.decode().astype(np.int32)))
        return pa.RecordBatch.from_arrays(
            [_shown(shard.docs), pa.array(row["start"] + begins), pa.array(ends - begins), ids.cast(pa.list_(pa.int32()))],
            names=["doc_id", "start", "n_tokens", "ids"])

    return _over_shards(shards, read, "doc_id long, start long, n_tokens long, ids array<int>", ["start"])


def checksums(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files."""
    def read(shard: Shard, row: dict) -> pa.RecordBatch:
        ends = shard.ends
        begins = np.concatenate(([0], ends[:-1]))
        data = memoryview(shard.decode().astype("<u4").tobytes())
        crc = [zlib.crc32(data[4 * a: 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
        return pa.RecordBatch.from_arrays(
            [_shown(shard.docs), pa.array(row["start"] + begins), pa.array(ends - begins), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _over_shards(shards, read, "doc_id long, start long, n_tokens long, ids_crc32 long", ["start"])


def count_tokens(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): how often each token occurs in all shards, without decoding them."""
    def read(shard: Shard, row: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([shard.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    return _over_shards(shards, read, "token long, n long", []).groupBy("token").agg(F.sum("n").alias("n"))


def find_token(shards: DataFrame, token: int) -> DataFrame:
    """(doc_id, place, at): every occurrence of a token, `place` inside its document and `at` among all tokens."""
    def read(shard: Shard, row: dict) -> pa.RecordBatch:
        at = shard.occurrences(token)
        doc = np.searchsorted(shard.ends, at, "right")
        begins = np.concatenate(([0], shard.ends[:-1]))
        return pa.RecordBatch.from_arrays([_shown(shard.docs[doc]), pa.array(at - begins[doc]), pa.array(row["start"] + at)],
                                          names=["doc_id", "place", "at"])

    return _over_shards(shards, read, "doc_id long, place long, at long", ["start"])
