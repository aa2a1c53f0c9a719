"""The rows with the least keys of every stratum, for several orders, in one scan.

Each task keeps, per order and stratum, the rows with the least keys it has met, and throws out what lies above the last of them, as a
heap would, but a batch at a time. What tasks keep is merged exactly. So a table is read once however many samples are drawn from it,
and only kept rows are shuffled. It suits samples whose rows fit in a task; larger ones go by cut keys (`sampling.draw`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cohortlab.functions.predicates import col
from cohortlab.staging import stage

_KEEP, _COUNT = 0, 1
ORDER, KEY, RANK, COUNT = "_least_order", "_least_key", "_least_rank", "_least_rows"


class _Least:
    """Rows of one order and stratum: at most twice `most` are held before the larger half goes."""

    def __init__(self, most: int, sort: list[tuple[str, str]]):
        self.most, self.sort, self.held, self.rows, self.limit = most, sort, [], 0, None

    def add(self, keys: np.ndarray, rows: pa.RecordBatch, at: np.ndarray) -> None:
        if self.limit is not None:
            at = at[keys[at] <= self.limit]
        if len(at):
            self.held.append(rows.take(pa.array(at)).append_column(KEY, pa.array(keys[at].astype(str), pa.string())))
            self.rows += len(at)
            if self.rows > 2 * self.most + 1_000:
                self.cut()

    def cut(self) -> pa.Table | None:
        if not self.held:
            return None
        table = pa.Table.from_batches(self.held)
        table = table.take(pc.sort_indices(table, self.sort)[: self.most])
        if table.num_rows == self.most:
            self.limit = np.array(table.column(KEY)[-1].as_py(), "S32")
        self.held, self.rows = table.combine_chunks().to_batches(), table.num_rows
        return table


def _keeper(orders: int, most: list[int], ids: list[str], columns: list[str]):
    sort = [(KEY, "ascending"), *[(f"_id{i}", "ascending") for i in range(len(ids))]]

    def run(batches):
        kept: dict[tuple[str, int], _Least] = {}
        counts: dict[str, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("_stratum").dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False)
            keys = batch.column("_keys").flatten().to_numpy(zero_copy_only=False).astype("S32").reshape(-1, orders)
            body = batch.drop_columns(["_stratum", "_keys"])
            order = np.argsort(code, kind="stable")
            edges = np.searchsorted(code[order], np.arange(len(names.dictionary) + 1))
            for s, name in enumerate(names.dictionary.to_pylist()):
                at = order[edges[s]: edges[s + 1]]
                if name not in counts:
                    counts[name] = [0, body.slice(int(at[0]), 1)]
                counts[name][0] += len(at)
                for j in range(orders):
                    if most[j]:
                        kept.setdefault((name, j), _Least(most[j], sort)).add(keys[:, j], body, at)

        def out(kind: int, rows: pa.Table, order: int, name: str, n: int) -> list[pa.RecordBatch]:
            size = rows.num_rows
            fixed = [pa.array(np.full(size, kind, np.int32)), pa.array(np.full(size, order, np.int32)), pa.array([name] * size, pa.string()),
                     pa.array(np.full(size, n)), rows.column(KEY).combine_chunks() if kind == _KEEP else pa.array([None] * size, pa.string())]
            fixed = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in fixed]
            rest = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (rows.column(c) for c in columns)]
            rest = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in rest]
            return [pa.RecordBatch.from_arrays([*fixed, *rest], names=["_kind", ORDER, "_stratum", COUNT, KEY, *columns])]

        for (name, j), least in kept.items():
            table = least.cut()
            if table is not None:
                yield from out(_KEEP, table, j, name, 0)
        for name, (n, row) in counts.items():
            yield from out(_COUNT, pa.Table.from_batches([row]), -1, name, n)

    return run


def least_rows(pool: DataFrame, strata: list[str], id_cols: list[str], keys: list[Column], most: list[int]) -> tuple[DataFrame, DataFrame]:
    """Candidates and counts from one scan of `pool`.

    Candidates are the columns of `pool` with ORDER (the number of the key), KEY and RANK: per order and stratum the `most` rows, in
    order of key and id. Counts are (*strata, COUNT), for all strata; a missing stratum is one. `keys` are texts of
    32 characters that are never missing.
    """
    names = [f"_c{i}" for i in range(len(pool.columns))]
    ids = [F.coalesce(col(c).cast("string"), F.lit("")).alias(f"_id{i}") for i, c in enumerate(id_cols)]
    stratum = F.to_json(F.struct(*[col(c).cast("string").alias(str(i)) for i, c in enumerate(strata)])).alias("_stratum")
    cells = pool.select(*[col(c).alias(n) for c, n in zip(pool.columns, names)], *ids, stratum, F.array(*keys).alias("_keys"))
    columns = [*names, *[f"_id{i}" for i in range(len(id_cols))]]
    head = [T.StructField("_kind", T.IntegerType()), T.StructField(ORDER, T.IntegerType()), T.StructField("_stratum", T.StringType()),
            T.StructField(COUNT, T.LongType()), T.StructField(KEY, T.StringType())]
    schema = T.StructType(head + [T.StructField(c, cells.schema[c].dataType) for c in columns])
    found = stage(cells.mapInArrow(_keeper(len(keys), most, id_cols, columns), schema))
    back = [F.col(n).alias(c) for c, n in zip(pool.columns, names)]
    order = Window.partitionBy(ORDER, "_stratum").orderBy(KEY, *[f"_id{i}" for i in range(len(id_cols))])
    ranked = found.where(F.col("_kind") == _KEEP).withColumn(RANK, F.row_number().over(order)).where(F.col(RANK) <= max([*most, 1]))
    limit = F.element_at(F.array(*[F.lit(m) for m in most]), F.col(ORDER) + 1)
    candidates = ranked.where(F.col(RANK) <= limit).select(*back, ORDER, KEY, RANK)
    where = dict(zip(pool.columns, names))
    counts = found.where(F.col("_kind") == _COUNT).groupBy("_stratum").agg(
        F.sum(COUNT).alias(COUNT), *[F.any_value(where[c]).alias(f"_s{i}") for i, c in enumerate(strata)])
    return candidates, counts.select(*[F.col(f"_s{i}").alias(c) for i, c in enumerate(strata)], COUNT)
