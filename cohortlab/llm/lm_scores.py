"""LM scoring with a log-frequency Bloom filter.

Texts are dealt into blocks by a hash of the row. A block asks hash buckets about its different words and word pairs, with their counts
in its training texts. A bucket sums the counts, enters each n-gram into its own stretch of the filter, under as many levels as the
count's logarithm says, and probes the stretch for all that was asked: level after level until one is absent; the last present level
gives the quantised count. Blocks meet their answers again and smooth pair and word counts into one probability by a Dirichlet prior.

A stretch has a fixed number of bits for each level entered, so the filter grows with the n-grams counted, false positives stay as rare
at any size of corpus, and no filter is ever broadcast or gathered for scoring.

The base score needs exact counts of every word; buckets send those along, with their totals.

Defined cases: NULL, empty and wordless texts are one end token; a missing id is trained on and shown as NULL; repeated rows count as
often as they occur and score alike; with nothing to train on every count is zero; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlab.llm.common import crc_mod, keyed, shown_id
from cohortlab.llm.exchange import bucket_count, bucket_of, pack, unpack
from cohortlab.llm.textscan import Block, blocks, mix

# Bits for each n-gram and level entered.
BITS_PER_NGRAM, HASHES, MAX_LEVEL = 8, 2, 40
PRIOR = 100.0
# Hashes that stand for the start and end of a text.
START, END = mix(np.array([11, 13], np.uint64))
PAIR_BYTES = 6
_LEVELS = mix(np.arange(1, HASHES * (MAX_LEVEL + 1) + 1, dtype=np.uint64) << np.uint64(20)).reshape(-1, HASHES)


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, hash of the token before it, number of its text); every text ends with END."""
    words = Block(batch.column("text")).words(lower=True)
    n = batch.num_rows
    at = np.arange(len(words.hash)) + words.doc
    token = np.full(len(words.hash) + n, END, np.uint64)
    token[at] = words.hash
    doc = np.repeat(np.arange(n), words.count + 1)
    before = np.concatenate(([START], token[:-1]))
    before[np.cumsum(words.count + 1) - (words.count + 1)] = START
    return token, before, doc


def pair(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + token) & np.uint64(2**64 - 256 ** (8 - PAIR_BYTES))


def positions(h: np.ndarray, level: int, bits: int):
    """Places of an n-gram's level in a stretch of the filter, one array per hash function."""
    for salt in _LEVELS[level]:
        yield (((mix(h ^ salt) >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)).astype(np.int64)


class Stretch:
    """One bucket's part of the filter, sized by what is entered."""

    def __init__(self, h: np.ndarray, n: np.ndarray):
        level = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64) + 1
        self.bits = np.zeros(max(64, BITS_PER_NGRAM * int(level.sum())), bool)
        for j in range(min(MAX_LEVEL, int(level.max(initial=0)))):
            for p in positions(h[level > j], j, len(self.bits)):
                self.bits[p] = True

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Levels present, by probing until one is absent."""
        level = np.zeros(len(h), np.uint8)
        active = np.arange(len(h))
        for j in range(MAX_LEVEL):
            there = np.ones(len(active), bool)
            for p in positions(h[active], j, len(self.bits)):
                there &= self.bits[p]
            active = active[there]
            if not len(active):
                break
            level[active] += 1
        return level


def quantised(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level."""
    level = level.astype(np.float64)
    return np.where(level > 0, (2.0 ** (level - 1) + 2.0 ** level - 1) / 2, 0.0)


@dataclass
class Model:
    """The stretches of a corpus's filter by bucket, for looking into it; scoring never gathers them."""

    stretches: dict[int, Stretch]
    n_buckets: int

    def count(self, h: np.ndarray) -> np.ndarray:
        """Quantised counts."""
        bucket = bucket_of(h, self.n_buckets).astype(np.int64)
        level = np.zeros(len(h), np.uint8)
        for b in np.unique(bucket).tolist():
            if b in self.stretches:
                level[bucket == b] = self.stretches[b].levels(h[bucket == b])
        return quantised(level)


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h, n = h[order], n[order]
    start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[start], np.add.reduceat(n, start) if len(start) else n


ASKS = "bucket int, block int, words binary, word_n binary, pairs binary, pair_n binary"
REPLIES = "block int, bucket int, types long, total long, word_n binary, word_levels binary, pair_levels binary"


def _block_tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`tokens` of a block, in pieces of bounded size."""
    out, rows = [], 0
    for batch in blocks(table.to_batches()):
        token, before, doc = tokens(batch)
        out.append((token, before, doc + rows))
        rows += batch.num_rows
    return tuple(np.concatenate(x) for x in zip(*out))


def _block_asks(n_buckets: int):
    """A row for each bucket: the block's different n-grams in ascending order, and their counts in its training texts."""
    def run(table: pa.Table) -> pa.Table:
        token, before, doc = _block_tokens(table)
        train = table.column("train").to_numpy()[doc].astype(np.int64)
        cols = {"bucket": pa.array(np.arange(n_buckets, dtype=np.int32)),
                "block": pa.array(np.full(n_buckets, table.column("block")[0].as_py(), np.int32))}
        for name, h, width in (("word", token, 8), ("pair", pair(before, token), PAIR_BYTES)):
            h, n = _summed(h, train)
            edges = np.searchsorted(bucket_of(h, n_buckets).astype(np.int64), np.arange(n_buckets + 1))
            cols[f"{name}s"] = pa.array([pack(h[a:b], width) for a, b in zip(edges, edges[1:])], pa.binary())
            cols[f"{name}_n"] = pa.array([n[a:b].astype("<u4").tobytes() for a, b in zip(edges, edges[1:])], pa.binary())
        return pa.table(cols)
    return run


def _counted(table: pa.Table, name: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Different n-grams of a bucket, their training counts, the place of each one asked for, and where each row's end."""
    asked = table.column(f"{name}s").to_pylist()
    names, at = np.unique(unpack(b"".join(asked), width), return_inverse=True)
    n = np.bincount(at, np.frombuffer(b"".join(table.column(f"{name}_n").to_pylist()), "<u4"), len(names)).astype(np.int64)
    return names, n, at, np.cumsum([len(x) // width for x in asked])[:-1].tolist()


def _bucket(table: pa.Table):
    word, pairs = _counted(table, "word", 8), _counted(table, "pair", PAIR_BYTES)
    seen = [(h[n > 0], n[n > 0]) for h, n, *_ in (word, pairs)]
    return word, pairs, Stretch(*(np.concatenate(x) for x in zip(*seen)))


def _bucket_replies(table: pa.Table) -> pa.Table:
    """To each block, in the order asked: exact counts of words, levels of words and pairs, and the bucket's totals."""
    (words, n, at, ends), (pairs, _, pair_at, pair_ends), stretch = _bucket(table)
    rows = table.num_rows

    def cut(x: np.ndarray, ends: list[int]) -> pa.Array:
        return pa.array([part.tobytes() for part in np.split(x, ends)], pa.binary())

    return pa.table({
        "block": table.column("block"), "bucket": table.column("bucket"), "types": np.full(rows, (n > 0).sum()), "total": np.full(rows, n.sum()),
        "word_n": cut(n.astype("<i8")[at], ends), "word_levels": cut(stretch.levels(words)[at], ends),
        "pair_levels": cut(stretch.levels(pairs)[pair_at], pair_ends)})


def _bucket_bits(table: pa.Table) -> pa.Table:
    bits = _bucket(table)[2].bits
    return pa.table({"bucket": table.column("bucket")[:1], "size": [len(bits)], "bits": [np.packbits(bits).tobytes()]})


def _asked(rows: DataFrame, n_buckets: int) -> tuple[DataFrame, DataFrame]:
    """Texts with their blocks, and what the blocks ask."""
    dealt = rows.select("doc", "text", "train", F.pmod(F.xxhash64("rk"), F.lit(n_buckets)).cast("int").alias("block"))
    return dealt, dealt.groupBy("block").applyInArrow(_block_asks(n_buckets), ASKS)


def learn(rows: DataFrame, n_buckets: int) -> Model:
    """The filter of the rows with `train`, gathered."""
    got = _asked(rows, n_buckets)[1].groupBy("bucket").applyInArrow(_bucket_bits, "bucket int, size long, bits binary").toArrow().to_pylist()
    stretches = {}
    for r in got:
        stretches[r["bucket"]] = stretch = Stretch(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        stretch.bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["size"]).astype(bool)
    return Model(stretches, n_buckets)


def _block_scores(n_texts: int, prior: float):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        token, before, doc = _block_tokens(table)
        rows = table.num_rows
        replies = replies.sort_by("bucket")
        # Buckets ascend with hashes, so their answers in order are those of the ascending different n-grams.
        exact, level, pair_level = (np.frombuffer(b"".join(replies.column(k).to_pylist()), t)
                                    for k, t in (("word_n", "<i8"), ("word_levels", np.uint8), ("pair_levels", np.uint8)))
        n_tokens = sum(replies.column("total").to_pylist())
        all_ = n_tokens + sum(replies.column("types").to_pylist()) + 1
        at = np.unique(token, return_inverse=True)[1]
        count, exact = quantised(level)[at], exact[at]
        # A quantised count may exceed the count, but a probability is at most 1.
        word = np.minimum((count + 1) / all_, 1.0)
        past = np.concatenate(([0.0], count[:-1]))
        past[before == START] = n_texts
        both = np.minimum(quantised(pair_level)[np.unique(pair(before, token), return_inverse=True)[1]], past)
        p = (both + prior * word) / (past + prior)
        return pa.table({
            "doc": table.column("doc"), "train": table.column("train"), "n_tokens": np.bincount(doc, minlength=rows),
            "n_known": np.bincount(doc, exact > 0, rows).astype(np.int64), "train_tokens": np.full(rows, n_tokens),
            "base_score": np.bincount(doc, np.log10((exact + 1) / all_), rows), "score": np.bincount(doc, np.log10(p), rows)})
    return run


def score(docs: DataFrame, prior: float = PRIOR, id_col: str = "doc_id", text_col: str = "text", folds: int = 7,
          held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Trained on documents whose crc32 of the id, modulo `folds`, is not `held_out`.
    """
    rows = keyed(docs, id_col, text_col).withColumn("train", crc_mod(shown_id(F.col("doc")), folds) != held_out)
    dealt, asked = _asked(rows, bucket_count(docs, text_col))
    replies = asked.groupBy("bucket").applyInArrow(_bucket_replies, REPLIES)
    scored = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        _block_scores(rows.where("train").count(), prior),
        "doc long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.select(shown_id(F.col("doc")).alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")
