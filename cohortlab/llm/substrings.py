"""Substring dedup by difference-cover anchors.

Anchors are hashes of a few words at the places of a difference cover modulo a period. Any two places have a shift that brings both
into the cover, so two equal stretches of anchor length plus period less one share an anchor at the same offset. Only stretches
around anchors that another document shares are extended to full windows, and a window is removed where its exact word sequence also
starts in a document with a smaller id.

Defined cases: NULL, empty and wordless texts have no words and the digest of the empty string; a missing id counts as larger than
any id and is not smaller than another missing id; rows with equal ids do not remove from each other; repeated windows inside one
document stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlab.llm.common import keyed, shown_id
from cohortlab.llm.exchange import ASKS, answer, asks, bucket_count, found_items, gathered
from cohortlab.llm.textscan import Block, blocks, mix

WINDOW = 13
# Every difference modulo the period is one between two members of the cover.
PERIOD, COVER = 7, (0, 1, 3)


def anchors(words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of anchors at cover places of each text; windows hold a whole period of them."""
    at, h = words.windows(window - PERIOD + 1, seed=2)
    inside = (at - words.first[words.doc[at]]) % PERIOD if len(at) else at
    chosen = np.isin(inside, COVER)
    return at[chosen], h[chosen]


def _ordered(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.take(pa.array(np.argsort(batch.column("doc").to_numpy(), kind="stable")))


def _anchor_asks(n_buckets: int, window: int):
    def run(batches):
        for batch in map(_ordered, blocks(batches)):
            words = Block(batch.column("text")).words(lower=False)
            at, h = anchors(words, window)
            yield asks(n_buckets, batch.column("doc").to_numpy(), batch.column("rk").to_numpy(), words.doc[at], h, 6, smaller=False)
    return run


def _window_asks(n_buckets: int, window: int):
    def run(batches):
        for batch in map(_ordered, blocks(batches)):
            words = Block(batch.column("text")).words(lower=False)
            at, h = anchors(words, window)
            _, shared = found_items(batch.column("found"))
            near = np.zeros(len(words.hash) + PERIOD + 1, np.int64)
            near[at[np.isin(h & np.uint64(0xFFFFFFFFFFFF0000), shared)] + 1] = 1
            near = np.cumsum(near)
            at, h = words.windows(window)
            ask = near[at + PERIOD] > near[at]
            yield asks(n_buckets, batch.column("doc").to_numpy(), batch.column("rk").to_numpy(), words.doc[at[ask]], h[ask], 8, smaller=True)
    return run


def _cut(window: int, texts: bool):
    def run(batches):
        for batch in blocks(batches):
            block = Block(batch.column("text"))
            rows = batch.num_rows
            which, marked = found_items(batch.column("found"))
            total, removed, kept = np.zeros(rows, np.int64), np.zeros(rows, np.int64), [b""] * rows
            gone = words = None
            if len(marked):
                words = block.words(lower=False)
                at, h = words.windows(window)
                salt = mix(np.arange(1, rows + 1, dtype=np.uint64))
                hit = at[np.isin(h ^ salt[words.doc[at]], marked ^ salt[which])]
                edge = np.zeros(len(words.hash) + 1, np.int64)
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
            for i in range(rows):
                parts = block.raw[block.begins[i]: block.ends[i]].split()
                total[i] = len(parts)
                if gone is not None and (mask := gone[words.first[i]: words.first[i + 1]]).any():
                    removed[i] = mask.sum()
                    parts = [p for p, g in zip(parts, mask.tolist()) if not g]
                kept[i] = b" ".join(parts)
            out = [batch.column("doc"), pa.array(total), pa.array(removed)]
            last = pa.array([k.decode() for k in kept]) if texts else pa.array([hashlib.sha256(k).hexdigest() for k in kept])
            yield pa.RecordBatch.from_arrays([*out, last], names=["doc", "n_words", "n_removed", "kept"])
    return run


def _dedup(docs: DataFrame, window: int, id_col: str, text_col: str, texts: bool) -> DataFrame:
    if window < PERIOD + 1:
        raise ValueError(f"windows have more than {PERIOD} words")
    rows = keyed(docs, id_col, text_col)
    n = bucket_count(docs, text_col)
    shared = gathered(answer(rows.mapInArrow(_anchor_asks(n, window), ASKS), 6, smaller=False))
    # Both joins deal the texts out by the same key, so one exchange of them serves both.
    near = rows.join(shared, "rk").select("doc", "rk", "text", "found")
    marks = gathered(answer(near.mapInArrow(_window_asks(n, window), ASKS), 8, smaller=True))
    whole = rows.join(marks, "rk", "left").select("doc", "text", "found")
    return whole.mapInArrow(_cut(window, texts), "doc long, n_words long, n_removed long, kept string")


def report(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    return _dedup(docs, window, id_col, text_col, texts=False).select(
        shown_id(F.col("doc")).alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def remove(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_words, n_removed): the words that are kept, joined by single spaces."""
    return _dedup(docs, window, id_col, text_col, texts=True).select(
        shown_id(F.col("doc")).alias("doc_id"), F.col("kept").alias("text"), "n_words", "n_removed")
