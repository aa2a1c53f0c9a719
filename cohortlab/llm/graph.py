"""Connected components by alternating stars, and bounded bitmaps of keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cohortlab.staging import stage

# A bitmap of keys has this fixed size; it only saves work, and saves less as it fills.
BITMAP_BITS = 2**26


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); root is the smallest node of the component.

    Each round links larger neighbours, then smaller ones, to the least neighbour. Least neighbours are found by a combined
    aggregation and joined back, so a node with very many links is no single task's load. Rounds are written to the shared folder.
    """
    links = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    mark = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
        links = stage(small.distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 2**31), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """Bits at the keys' places, as 64-bit words; at most BITMAP_BITS / 64 of them come to the driver."""
    at = F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS))
    words = keys.select(at.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))).alias("bits")).toPandas()
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    out[words.w.to_numpy(np.int64)] = words.bits.to_numpy(np.int64)
    return out


def place(key: str):
    """The column that `among` looks up."""
    return F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS))


def among(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((bits[places >> 6] >> (places & 63)) & 1).astype(bool)
