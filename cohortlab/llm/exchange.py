"""Which items of a document also occur in another: hashes exchanged in compact rows.

A block of documents asks once per different hash and bucket; a bucket answers with the hashes that were found elsewhere. However
common an item is, a block names it once, so a bucket receives at most one entry for it from each block. Where smaller ids count, so
does each different row of the block that shares the smallest id (as rows without an id do).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Text per bucket: what one call of a bucket holds is a fixed share of it. A floor keeps small runs parallel.
BUCKET_BYTES = 12_000_000
LEAST_BUCKETS = 64

ASKS = "bucket int, tell boolean, rks binary, docs binary, counts binary, hashes binary"
REPLIES = "rk long, hashes binary"


def bucket_count(docs: DataFrame, text_col: str = "text") -> int:
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))


def pack(h: np.ndarray, width: int) -> bytes:
    """The leading `width` bytes of each hash."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - width:].tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    raw = np.zeros((len(data) // width, 8), np.uint8)
    raw[:, 8 - width:] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return raw.view("<u8").ravel()


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def by_row(rk: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Different keys, and the bytes of each one's hashes."""
    order = np.argsort(rk, kind="stable")
    rk, h = rk[order], h[order].astype("<u8")
    first = np.flatnonzero(np.concatenate(([True], rk[1:] != rk[:-1]))) if len(rk) else np.zeros(0, np.int64)
    offsets = np.concatenate((first, [len(rk)])).astype(np.int32) * 8
    return rk[first], pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(h)])


def asks(n_buckets: int, docs: np.ndarray, rks: np.ndarray, item_doc: np.ndarray, h: np.ndarray, width: int, smaller: bool) -> pa.RecordBatch:
    """Rows of one block. `docs` ascends; `item_doc` is the number of each item's document.

    `smaller`: an item counts as found if a document with a smaller id has it, otherwise if any other document does. What the block
    itself finds is told at once.
    """
    h = h & np.uint64(2**64 - 256 ** (8 - width))
    order = np.argsort(h, kind="stable")
    h, item_doc = h[order], item_doc[order]
    same = h[1:] == h[:-1]
    fresh = np.concatenate(([True], ~(same & (item_doc[1:] == item_doc[:-1])))) if len(h) else np.zeros(0, bool)
    h, item_doc = h[fresh], item_doc[fresh]
    lead = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    group = np.cumsum(lead) - 1
    if smaller:
        told = docs[item_doc] > docs[item_doc[lead]][group] if len(h) else lead
    else:
        told = (np.bincount(group)[group] > 1) if len(h) else lead
    rk, hashes = by_row(rks[item_doc[told]], h[told])
    n = len(rk)
    rows = {"bucket": (rk % n_buckets).tolist(), "tell": [True] * n, "rks": [r.tobytes() for r in rk], "docs": [b""] * n,
            "counts": [b""] * n, "hashes": hashes.to_pylist()}
    if smaller and (~told).sum() > lead.sum():
        # Rows with the lead's own id are not told, so each different one asks.
        h, item_doc = h[~told], item_doc[~told]
        order = np.lexsort((rks[item_doc], h))
        h, item_doc = h[order], item_doc[order]
        lead = np.concatenate(([True], (h[1:] != h[:-1]) | (rks[item_doc[1:]] != rks[item_doc[:-1]])))
    h, item_doc = h[lead], item_doc[lead]
    bucket = bucket_of(h, n_buckets).astype(np.int64)
    order = np.lexsort((item_doc, bucket))
    h, item_doc, bucket = h[order], item_doc[order], bucket[order]
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *edges], [*edges, len(h)]) if len(h) else ():
        who = item_doc[a:b]
        start = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
        one = who[start]
        counts = np.diff(np.concatenate((start, [b - a]))).astype("<u4")
        for k, v in (("bucket", int(bucket[a])), ("tell", False), ("rks", rks[one].tobytes()), ("docs", docs[one].tobytes() if smaller else b""),
                     ("counts", counts.tobytes()), ("hashes", pack(h[a:b], width))):
            rows[k].append(v)
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[k], t) for k, t in (("bucket", pa.int32()), ("tell", pa.bool_()), ("rks", pa.binary()), ("docs", pa.binary()),
                                           ("counts", pa.binary()), ("hashes", pa.binary()))],
        names=["bucket", "tell", "rks", "docs", "counts", "hashes"])


def replier(width: int, smaller: bool, often: int | None = None):
    """What a bucket does: see `answer`."""
    def reply(table: pa.Table) -> pa.Table:
        tell = table.column("tell").to_numpy(zero_copy_only=False)
        cols = {k: table.column(k).to_pylist() for k in ("rks", "docs", "counts", "hashes")}
        ask = np.flatnonzero(~tell)
        counts = np.frombuffer(b"".join(cols["counts"][i] for i in ask), "<u4").astype(np.int64)
        rk = np.repeat(np.frombuffer(b"".join(cols["rks"][i] for i in ask), np.int64), counts)
        h = unpack(b"".join(cols["hashes"][i] for i in ask), width)
        if smaller:
            doc = np.repeat(np.frombuffer(b"".join(cols["docs"][i] for i in ask), np.int64), counts)
            order = np.lexsort((doc, h))
            h, rk, doc = h[order], rk[order], doc[order]
        else:
            order = np.argsort(h, kind="stable")
            h, rk = h[order], rk[order]
        lead = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        if smaller:
            found = doc > doc[lead][np.cumsum(lead) - 1] if len(h) else lead
        else:
            found = ~lead | np.concatenate((~lead[1:], [False])) if len(h) else lead
        keys, hashes = by_row(rk[found], h[found])
        told = np.flatnonzero(tell)
        top = np.zeros(0, np.uint64)
        if often is not None and len(h):
            top = h[lead][np.bincount(np.cumsum(lead) - 1) >= often]
        keys = np.concatenate((keys, np.frombuffer(b"".join(cols["rks"][i] for i in told), np.int64)))
        hashes = [hashes, pa.array([cols["hashes"][i] for i in told], pa.binary())]
        if often is None:
            return pa.table({"rk": keys, "hashes": pa.concat_arrays(hashes)})
        listed = pa.array([top.astype("<u8").tobytes()] if len(top) else [], pa.binary())
        return pa.table({"rk": pa.array([*keys.tolist(), *[None] * len(listed)], pa.int64()), "hashes": pa.concat_arrays([*hashes, listed]),
                         "common": pa.array([False] * len(keys) + [True] * len(listed), pa.bool_())})

    return reply


def answer(rows: DataFrame, width: int, smaller: bool, often: int | None = None) -> DataFrame:
    """(rk, hashes) of found items, from rows of `asks`.

    With `often` there is a third column, `common`: its rows list, without a key, the items that so many blocks or more asked for.
    """
    return rows.groupBy("bucket").applyInArrow(replier(width, smaller, often), REPLIES + ("" if often is None else ", common boolean"))


def gathered(replies: DataFrame) -> DataFrame:
    """One row per document: all its found hashes."""
    return replies.groupBy("rk").agg(F.collect_list("hashes").alias("found"))


def found_items(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of the row, hash) of a column of `gathered`; NULL rows have none."""
    joined = [b"".join(x) if x else b"" for x in column.to_pylist()]
    sizes = np.fromiter(map(len, joined), np.int64, len(joined)) // 8
    return np.repeat(np.arange(len(joined)), sizes), np.frombuffer(b"".join(joined), "<u8")
