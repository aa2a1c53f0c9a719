"""Embedding near-dedup by product quantisation.

Vectors lie in inverted lists by nearest coarse centroid and carry codes of their residual, one byte per subspace, with the length of
what the codes miss. A query looks up partial products in a table per subspace; since a vector's missed length bounds the error,
candidates below the bound cannot reach the threshold, and the rest are ranked by exact cosine in double precision.

Which lists to probe follows from the geometry: if y lies in list c and within distance d of x, then x (a - c) <= d |a - c| for x's own
centroid a. `margin` scales d: 1, the default, is a proof, so no link is lost; less skips lists and loses links whose difference lies
along the line between centroids. Each pair of lists is probed from one side. Lists and their queries are split into blocks of bounded size, and blocks return counts
and spanning links, not pairs.

Defined cases: vectors that are NULL, zero, of another length than most, or hold NULL or non-finite components link with nothing and
are kept; equal vectors are one class with a weight; a missing id counts as the largest and is shown as NULL; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlab.llm.common import NO_ID, shown_id
from cohortlab.llm.graph import components
from cohortlab.staging import stage

THRESHOLD, MARGIN = 0.9, 1.0
# Bound of the sample that centroids are fitted on; every vector is indexed.
SAMPLE_ROWS = 10_000
SUBSPACES, CODES = 16, 256
MAX_LISTS = 4_096
BLOCK_ROWS, QUERY_ROWS = 2_048, 8_192
# Queries looked up at a time.
QUERY_STEP = 256


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's rounds; empty ones restart at far points."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        d = (c * c).sum(1)[None] - 2 * x @ c.T
        at = d.argmin(1)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        if (n == 0).any():
            c[n == 0] = x[np.argsort(d.min(1))[::-1][: (n == 0).sum()]]
    return c


class Index:
    """Coarse centroids and residual codebooks for unit vectors."""

    def __init__(self, sample: np.ndarray, rows: int):
        lists = int(min(MAX_LISTS, max(1, len(sample) // 8), max(16, 2 ** round(np.log2(max(1, rows)) / 2))))
        self.coarse = kmeans(sample, lists)
        self.parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        rest = sample - self.coarse[self.cells(sample)]
        self.books = [kmeans(rest[:, p], min(CODES, len(sample))) for p in self.parts]
        gap = self.coarse[:, None] - self.coarse[None] if lists <= 512 else None
        self.gaps = np.sqrt((gap ** 2).sum(2)) if gap is not None else np.sqrt(np.maximum(
            0, (self.coarse ** 2).sum(1)[:, None] + (self.coarse ** 2).sum(1)[None] - 2 * self.coarse @ self.coarse.T))

    def cells(self, x: np.ndarray) -> np.ndarray:
        return ((self.coarse ** 2).sum(1)[None] / 2 - x @ self.coarse.T).argmin(1)

    def encode(self, x: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the length of what they miss."""
        rest = x - self.coarse[cells]
        codes = np.stack([((b ** 2).sum(1)[None] / 2 - rest[:, p] @ b.T).argmin(1) for p, b in zip(self.parts, self.books)], 1)
        back = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], 1)
        return codes.astype(np.uint8), np.sqrt(((rest[:, np.concatenate(self.parts)] - back) ** 2).sum(1))

    def probes(self, x: np.ndarray, cells: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) to search: lists from the own one on that can hold a vector within reach."""
        # Nearest by distance: |y - c| <= |y - a| is y (a - c) <= (|a|^2 - |c|^2) / 2.
        half = (self.coarse ** 2).sum(1) / 2
        score = x @ self.coarse.T - half
        own = score[np.arange(len(x)), cells][:, None]
        near = (own - score <= reach * self.gaps[cells]) & (np.arange(len(self.coarse))[None] >= cells[:, None])
        near[np.arange(len(x)), cells] = True
        return np.nonzero(near)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _placed(shared):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x = _unit(_vectors(batch.column("vec")))
                cells = shared.value.cells(x)
                codes, missed = shared.value.encode(x, cells)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cls"), batch.column("w"), batch.column("vec"), pa.array(cells.astype(np.int32)),
                     pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(missed)],
                    names=["cls", "w", "vec", "cell", "code", "missed"])
    return run


def _queries(shared, reach: float):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                row, cell = shared.value.probes(_unit(_vectors(batch.column("vec"))), batch.column("own").to_numpy(), reach)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cls").take(pa.array(row)), batch.column("own").take(pa.array(row)), pa.array(cell.astype(np.int32))],
                    names=["cls", "own", "cell"])
    return run


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of each place's component under links (i, j)."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return root


def _search(shared, threshold: float):
    """Counts and spanning links of one block of a list with one block of its queries."""
    def run(table: pa.Table) -> pa.Table:
        index = shared.value
        is_query = table.column("query").to_numpy(zero_copy_only=False)
        cls, w = table.column("cls").to_numpy(), table.column("w").to_numpy()
        own = table.column("own").to_numpy()
        x = _unit(_vectors(table.column("vec").combine_chunks()))
        data, query = np.flatnonzero(~is_query), np.flatnonzero(is_query)
        out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(data) and len(query):
            cell = int(own[data[0]])
            codes = np.frombuffer(b"".join(table.column("code").filter(pa.array(~is_query)).to_pylist()), np.uint8).reshape(len(data), -1)
            # Single precision for the lookups, with room for its error; tables by code, so that a lookup is a row for all queries.
            slack = (threshold - 1e-4 - table.column("missed").to_numpy()[data]).astype(np.float32)[:, None]
            for a in range(0, len(query), QUERY_STEP):
                rows = query[a: a + QUERY_STEP]
                near = np.repeat((x[rows] @ index.coarse[cell]).astype(np.float32)[None], len(data), 0)
                for m, (part, book) in enumerate(zip(index.parts, index.books)):
                    near += (book @ x[rows][:, part].T).astype(np.float32)[codes[:, m]]
                j, i = np.nonzero(near >= slack)
                i, j = rows[i], data[j]
                fresh = (own[i] != cell) | (cls[i] < cls[j])
                i, j = i[fresh], j[fresh]
                good = np.concatenate([(x[i[b: b + 65536]] * x[j[b: b + 65536]]).sum(1) >= threshold for b in range(0, len(i), 65536)]
                                      or [np.zeros(0, bool)])
                out_i.append(i[good])
                out_j.append(j[good])
        i, j = np.concatenate(out_i), np.concatenate(out_j)
        # The same class may be here as data and as a query.
        names, at = np.unique(cls, return_inverse=True)
        n = np.bincount(at[i], w[j], len(names)) + np.bincount(at[j], w[i], len(names)) if len(i) else np.zeros(len(names))
        root = names[_roots(len(names), at[i], at[j])]
        some = n > 0
        return pa.table({"cls": names[some], "n": n[some].astype(np.int64), "root": root[some]})
    return run


def links(vectors: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, sample_rows: int = SAMPLE_ROWS,
          id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    # Single-precision vectors travel as such; all arithmetic is in double precision.
    kind = "float" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    vec = F.col("vec")
    fine = vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(
        vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(vec, lambda v: v != 0)
    rows = vectors.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"))
    rows = rows.select("id", "vec", F.coalesce(fine, F.lit(False)).alias("fine"))
    common = rows.where("fine").groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return rows.select(shown_id(F.col("id")).alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"),
                           shown_id(F.col("id")).alias("component_id"), F.lit(True).alias("kept"))
    # Adding zero makes -0.0 equal to 0.0.
    rows = stage(rows.select("id", F.transform("vec", lambda v: v + F.lit(0).cast(kind)).alias("vec"), (F.col("fine") & (F.size("vec") == common.d)).alias("fine"))
                 .withColumn("cls", F.xxhash64("vec")))
    classes = stage(rows.where("fine").groupBy("cls").agg(F.count("*").alias("w"), F.min("id").alias("first"), F.any_value("vec").alias("vec")))
    size = classes.count()
    sample = classes.orderBy(F.xxhash64("cls"), "cls").limit(sample_rows).select("vec").toArrow()
    shared = spark.sparkContext.broadcast(Index(_unit(_vectors(sample.column("vec").combine_chunks())), size))
    placed = stage(classes.select("cls", "w", "vec").mapInArrow(
        _placed(shared), f"cls long, w long, vec array<{kind}>, cell int, code binary, missed double"))
    # A little more than the bound, for rounding.
    reach = margin * float(np.sqrt(2 - 2 * threshold)) + 1e-9
    asked = stage(placed.select("cls", F.col("cell").alias("own"), "vec").mapInArrow(_queries(shared, reach), "cls long, own int, cell int"))
    # Blocks of each list and of its queries; at most one row per list.
    blocks = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("kd")).join(
        asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("kq")), "cell")
    blocks = F.broadcast(blocks)
    data = placed.join(blocks, "cell").select(
        "cell", F.pmod(F.xxhash64("cls"), "kd").cast("int").alias("d"), F.explode(F.sequence(F.lit(0), F.col("kq") - 1)).alias("q"),
        F.lit(False).alias("query"), "cls", "w", F.col("cell").alias("own"), "vec", "code", "missed")
    query = asked.join(blocks, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("kd") - 1)).alias("d"), F.pmod(F.xxhash64("cls"), "kq").cast("int").alias("q"),
        F.lit(True).alias("query"), "cls", "own").join(placed.select("cls", "w", "vec"), "cls").select(
        "cell", "d", "q", "query", "cls", "w", "own", "vec", F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("missed"))
    found = stage(data.unionByName(query).groupBy("cell", "d", "q").applyInArrow(_search(shared, threshold), "cls long, n long, root long"))
    counts = found.groupBy("cls").agg(F.sum("n").alias("linked"))
    roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    named = classes.select("cls", "w", "first").join(roots, classes.cls == roots.node, "left").select(
        "cls", "w", "first", F.coalesce("root", "cls").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("first").alias("component")), "root").join(counts, "cls", "left").select(
        "cls", (F.col("w") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component")
    out = rows.select("id", "fine", "cls").join(named, "cls", "left")
    component = F.when(F.col("fine"), F.col("component")).otherwise(F.col("id"))
    return out.select(
        shown_id(F.col("id")).alias("vec_id"), F.when(F.col("fine"), F.col("n_links")).otherwise(0).cast("bigint").alias("n_links"),
        shown_id(component).alias("component_id"), (F.col("id") == component).alias("kept"))
