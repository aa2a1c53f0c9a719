"""SentencePiece encoding and decoding through the tokenizers library.

The model's protobuf is read field by field; normaliser, metaspace marker, scores and byte fallback are rebuilt as a tokenizer that
encodes batches with several threads. Unigram models keep their scores; BPE models (as the one at hand) get their merges from the
order of scores. Before use, parity with the reference library is checked on given texts, and a difference is an error.

Pieces never continue past a word into the next marker in such models; where that holds, words are encoded one by one and cached.
Decoding joins pieces and bytes by table.

Defined cases: NULL and empty texts have no ids and decode to the empty string; NUL and other control characters go by byte
fallback or the unknown piece, as in the model; repeated rows are encoded one by one; an empty table gives an empty result; other
columns are ignored or, in `encode_documents`, kept.
"""

from __future__ import annotations

import os
import re
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cohortlab.llm.common import small_batches
from cohortlab.llm.textscan import blocks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
THREADS = 2
# Bound of the cache of encoded words in a process, which starts anew beyond it, and text encoded at a time.
KNOWN_WORDS = 120_000
TEXT_BYTES = 500_000
SPLIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
# Kinds of pieces in the format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
PARITY_TEXTS = ["", " ", "  two  spaces ", "plain words", "Ünïcödé ñ ß 日本 \U0001F600", "tab\tand\nline", "a▁b", "x" * 300, "1.5e-3 = $9,99!"]


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    add_prefix: bool = True
    trim: bool = True
    escape: bool = True
    charsmap: bytes = b""


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message: integers, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, varint()
        else:
            size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
            yield number, data[at: at + size]
            at += size


def parse(data: bytes) -> Model:
    """The parts of a model file that encoding and decoding need."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            model.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
            model.kind = trainer.get(3, UNIGRAM)
            model.byte_fallback = bool(trainer.get(35, 0))
        elif number == 3:
            norm = dict(_fields(value))
            model.charsmap = norm.get(2, b"")
            model.add_prefix, model.trim, model.escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
    return model


def tokenizer(model: Model, bare: bool = False):
    """The model as a tokenizer of the tokenizers library; `bare` takes words that are normalised already."""
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

    names = [p for p, _, _ in model.pieces]
    unknown = next((i for i, (_, _, k) in enumerate(model.pieces) if k == UNKNOWN), None)
    if model.kind == UNIGRAM:
        low = min((s for _, s, k in model.pieces if k == NORMAL), default=0.0)
        vocab = [(p, s if k in (NORMAL, USER) else low - 100.0) for p, s, k in model.pieces]
        core = models.Unigram(vocab, unknown, model.byte_fallback)
    elif model.kind == BPE:
        rank = {p: -s for p, s, k in model.pieces if k in (NORMAL, USER)}
        ids = {p: i for i, p in enumerate(names)}
        merges = sorted((rank[p], ids[p], p[:i], p[i:]) for p in rank for i in range(1, len(p)) if p[:i] in rank and p[i:] in rank)
        core = models.BPE(ids, [(a, b) for _, _, a, b in merges], unk_token=names[unknown] if unknown is not None else None,
                          fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=0 if bare else 10_000)
    else:
        raise ValueError(f"models of type {model.kind} are not built here")
    steps = []
    if bare:
        return Tokenizer(core)
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.trim:
        steps += [normalizers.Replace(Regex(" +"), " "), normalizers.Strip()]
    if model.add_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    made = Tokenizer(core)
    if steps:
        made.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p in names):
        made.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    return made


def piece_bytes(model: Model) -> list[bytes]:
    """What each id stands for in a decoded text."""
    def plain(p: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(p[3:5], 16)])
        return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode()

    return [plain(p, k) for p, _, k in model.pieces]


class Codec:
    """Encoder and decoder in one process. `check` compares with the reference library and raises on a difference."""

    def __init__(self, data: bytes, threads: int = THREADS):
        os.environ.update(RAYON_NUM_THREADS=str(threads), TOKENIZERS_PARALLELISM="true" if threads > 1 else "false")
        self.data, self.model = data, parse(data)
        self.tokens, self.table = tokenizer(self.model), piece_bytes(self.model)

        m = self.model
        self.by_word = m.escape and not m.charsmap and not m.trim and not any(MARK in p.lstrip(MARK) for p, _, _ in m.pieces)
        self.known: dict[str, int] = {}
        self.tokens = tokenizer(m, bare=self.by_word)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        sizes, flat = self.encode_flat(texts)
        return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] if texts else []

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids in a row. Each different word is encoded once, in one batch."""
        if not self.by_word:
            ids = [e.ids for e in self.tokens.encode_batch_fast(texts, add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            return sizes, np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
        if len(self.known) > KNOWN_WORDS or not self.known:
            self.known, self.starts, self.lengths, self.pool = {}, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            self.pooled = 0
        head = " " if self.model.add_prefix else ""
        words = [SPLIT.findall((head + t).replace(" ", MARK)) if t else [] for t in texts]
        new = list({w for x in words for w in x} - self.known.keys())
        ids = [e.ids for e in self.tokens.encode_batch_fast(new, add_special_tokens=False)]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.lengths = [np.concatenate((*self.lengths, lengths))]
        self.starts = [np.concatenate((*self.starts, self.pooled + np.cumsum(lengths) - lengths))]
        self.pool = [np.concatenate((*self.pool, np.fromiter((i for x in ids for i in x), np.int32, int(lengths.sum()))))]
        self.pooled = len(self.pool[0])
        counts = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter((self.known[w] for x in words for w in x), np.int64, int(counts.sum()))
        n = self.lengths[0][at]
        ends = np.cumsum(n)
        flat = self.pool[0][np.repeat(self.starts[0][at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        reach = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return np.diff(reach), flat

    def decode(self, ids: list[int]) -> str:
        out = b"".join([self.table[i] for i in ids])
        return (out[1:] if self.model.add_prefix and out[:1] == b" " else out).decode("utf-8", "replace")

    def check(self, texts: list[str]) -> None:
        import sentencepiece

        other = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        for text, ids in zip(texts, self.encode(texts)):
            if ids != (wanted := other.encode(text)):
                raise ValueError(f"{text[:80]!r}: {ids[:40]} is not {wanted[:40]}")


@lru_cache(maxsize=1)
def _codec(data: bytes, threads: int) -> Codec:
    """One codec for a process, whatever number of tasks it runs."""
    return Codec(data, threads)


def _encoder(shared, threads: int, decode: bool, text_col: str | None):
    """`text_col`: the text is a field of `row`."""
    def encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(shared.value, threads)
        texts = [t or "" for t in batch.column("text").to_pylist()]
        sizes, flat = codec.encode_flat(texts)
        ends = np.cumsum(sizes)
        names = [c for c in batch.schema.names if c != "text"]
        arrays = [batch.column(c) for c in names]
        arrays += [pa.array(sizes), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), flat)]
        names += ["n_tokens", "ids"]
        if decode:
            arrays.append(pa.array([codec.decode(flat[e - n: e].tolist()) == _normal(codec.model, t)
                                    for n, e, t in zip(sizes, ends, texts)], pa.bool_()))
            names.append("round_trip")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches):
        for batch in batches:
            if text_col is not None:
                batch = batch.append_column("text", batch.column("row").field(text_col))
            yield from map(encoded, blocks([batch], limit=TEXT_BYTES))

    return run


def _normal(model: Model, text: str) -> str:
    """What a text decodes to: markers in it read as spaces; trimmed if the model trims; a model's map is not undone."""
    text = text.replace(MARK, " ")
    return " ".join(text.split(" ")).strip(" ") if model.trim else text


def load(spark, path: str = MODEL) -> bytes:
    """The model file, read by Spark, so from any store; models are a few MB."""
    return bytes(spark.read.format("binaryFile").load(f"file://{path}" if path.startswith("/") else path).first().content)


def encode(docs: DataFrame, path: str = MODEL, threads: int = THREADS, id_col: str = "doc_id", text_col: str = "text",
           carry: bool = False, decode: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of every row; `carry` adds the whole row as a struct, `row`.

    `round_trip` says whether decoding the ids gives the text back, as the model's normaliser leaves it.
    """
    spark = docs.sparkSession
    data = load(spark, path)
    Codec(data, threads).check(PARITY_TEXTS)
    text = F.struct("*").alias("row") if carry else F.col(text_col).alias("text")
    cols = small_batches(docs).select(F.col(id_col).alias("doc_id"), text)
    schema = T.StructType([f for f in cols.schema.fields if f.name != "text"] + [
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
        + [T.StructField("round_trip", T.BooleanType()) for _ in range(decode)])
    return cols.mapInArrow(_encoder(spark.sparkContext.broadcast(data), threads, decode, text_col if carry else None), schema)


def decode(encoded: DataFrame, path: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """The rows of `encoded` with their ids decoded as `text`; NULL ids decode to the empty string."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(load(spark, path))
    cols = small_batches(encoded).select(F.struct("*").alias("row"), F.col(ids_col).alias("ids"))
    schema = T.StructType([cols.schema["row"], T.StructField("text", T.StringType())])

    def run(batches):
        codec = Codec(shared.value, 1)
        for batch in batches:
            texts = [codec.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    out = cols.mapInArrow(run, schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in encoded.columns if c != "text"], "text")


def encode_documents(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """The rows of `docs` with `n_tokens` and `ids` added; columns of those names are replaced."""
    out = encode(docs, path, carry=True, decode=False)
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_tokens", "ids")], "n_tokens", "ids")
