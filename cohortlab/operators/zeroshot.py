"""Zero-shot scoring of embeddings against pairs of prompts."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortlab.constants import COSINE_EPS, UNCERTAIN
from cohortlab.functions.predicates import certain, col
from cohortlab.sources.placed import store_of
from cohortlab.staging import new_folder

# Findings whose prompts are held as one matrix in every task, and scores computed at a time.
MATRIX_FINDINGS = 2_000
CELLS = 1_000_000
# Images that meet all blocks of findings together.
ROWS_TOGETHER = 20_000


def flatten_prompts(spark, phrases: Mapping[str, tuple[str, str]]) -> DataFrame:
    """{finding: (present, absent)} to rows (finding, polarity, phrase)."""
    rows = spark.createDataFrame([(f, *pair) for f, pair in phrases.items()], "finding string, present string, absent string")
    return rows.unpivot("finding", ["present", "absent"], "polarity", "phrase")


def pair_prompts(prompts: DataFrame) -> DataFrame:
    """(finding, polarity, embedding) to (finding, present, absent)."""
    side = lambda p: F.any_value(F.when(F.col("polarity") == p, F.col("embedding")), F.lit(True))
    return prompts.groupBy("finding").agg(side("present").alias("present"), side("absent").alias("absent"))


def latest_embedding(df: DataFrame, key: str, embedding: str, order: str) -> DataFrame:
    """One embedding per key: the one with the greatest `order`, which must be
    distinct within a key for the choice to be settled."""
    return df.groupBy(col(key)).agg(F.max_by(col(embedding), col(order)).alias(embedding))


def zero_shot_scores(
    images: DataFrame, labels: DataFrame, prompts: DataFrame, findings: list[str], key: str,
    embedding: str = "embedding", uncertain: int = UNCERTAIN, strict: bool = True, matrix_findings: int | None = None,
) -> DataFrame:
    """(finding, key, y_true, y_score) for every image and finding with a certain label.

    `labels` is wide: `key` and one column per finding. `prompts` is (finding,
    present, absent). A finding named twice is scored once; one without
    prompts raises. An image without a label row, without a vector or without
    a label for a finding raises with `strict`; otherwise it is left out, and
    `scoring_gaps` lists it.

    Images meet their label row once, and are read once: prompts come to them,
    in blocks of findings held as matrices in every task. Scores of some
    images and a block are one matrix product. Beyond `matrix_findings`
    findings (MATRIX_FINDINGS if it is not given) the blocks are written to the shared folder, and a task opens one after
    the other for every ROWS_TOGETHER of its images.
    """
    findings = list(dict.fromkeys(findings))
    wanted = prompts.select(col("finding").cast("string").alias("finding"), "present", "absent")
    names = {r.finding for r in wanted.select("finding").filter(col("finding").isin(findings)).distinct().collect()}
    lacking = [f for f in findings if f not in names]
    if lacking:
        raise ValueError(f"findings without prompts: {lacking}")
    rows = _with_labels(images, labels, findings, key, embedding)
    if strict:
        rows = rows.withColumn(key, _checked(rows, findings, key))
    rows = rows.filter(col("_vector").isNotNull() & col("_known")).select(col(key), "_vector", *map(col, findings))
    size = matrix_findings or MATRIX_FINDINGS
    if len(findings) <= size:
        return _scored(rows, wanted, findings, key, uncertain)
    return _scored_by_blocks(rows, wanted, findings, key, uncertain, size)


def _with_labels(images: DataFrame, labels: DataFrame, findings: list[str], key: str, embedding: str) -> DataFrame:
    marked = labels.select(col(key), *map(col, findings), F.lit(True).alias("_known"))
    rows = images.select(col(key), col(embedding).alias("_vector")).join(marked, key, "left")
    return rows.withColumn("_known", F.coalesce("_known", F.lit(False)))


def _gaps(findings: list[str]) -> list[tuple[Column, Column, Column]]:
    """(condition, finding, reason) of what cannot be scored."""
    nothing = F.lit(None).cast("string")
    return [
        (~F.col("_known"), nothing, F.lit("no label row")), (F.col("_vector").isNull(), nothing, F.lit("no vector")),
        *[(F.col("_known") & col(f).isNull(), F.lit(f), F.lit("no label")) for f in findings],
    ]


def _checked(rows: DataFrame, findings: list[str], key: str) -> Column:
    """The key, which raises for an image that `scoring_gaps` would list."""
    reason = F.coalesce(*[F.when(bad, why) for bad, _, why in _gaps(findings)])
    broken = F.raise_error(F.concat(reason, F.lit(" for "), col(key).cast("string")))
    return F.when(reason.isNull(), col(key)).otherwise(broken.cast(rows.schema[key].dataType))


def scoring_gaps(images: DataFrame, labels: DataFrame, findings: list[str], key: str, embedding: str = "embedding") -> DataFrame:
    """(key, finding, reason) of images that cannot be scored; finding is NULL where that holds for all."""
    findings = list(dict.fromkeys(findings))
    rows = _with_labels(images, labels, findings, key, embedding)
    found = F.array(*[F.when(bad, F.struct(f.alias("finding"), why.alias("reason"))) for bad, f, why in _gaps(findings)])
    return rows.select(col(key), F.inline(F.filter(found, lambda x: x.isNotNull())))


def _scored(rows: DataFrame, prompts: DataFrame, findings: list[str], key: str, uncertain: int) -> DataFrame:
    """Scores of all images for one block of findings."""
    table = prompts.filter(col("finding").isin(findings)).toArrow()
    pairs = {r["finding"]: (r["present"], r["absent"]) for r in table.to_pylist()}
    scores = _batch_scorer(
        np.array([pairs[f][0] for f in findings], dtype="f8"), np.array([pairs[f][1] for f in findings], dtype="f8")
    )
    label_of = [F.struct(F.lit(f).alias("finding"), col(f).alias("y_true")) for f in findings]
    cells = F.arrays_zip(F.array(*label_of).alias("label"), F.col("_scores").alias("y_score"))
    scored = rows.withColumn("_scores", scores(F.col("_vector"))).select(col(key), F.inline(cells))
    return scored.select("label.finding", col(key), "label.y_true", "y_score") \
        .filter(certain("y_true", uncertain))


def _scored_by_blocks(rows: DataFrame, prompts: DataFrame, findings: list[str], key: str, uncertain: int, size: int) -> DataFrame:
    """Scores for any number of findings in one pass over the images."""
    spark, together = rows.sparkSession, ROWS_TOGETHER
    folder = new_folder(spark, "prompts")
    places = spark.createDataFrame(list(enumerate(findings)), "at int, finding string")
    placed = prompts.join(places, "finding").withColumn("block", F.expr(f"at div {size}").cast("int"))
    placed.select("at", col("present").cast("array<double>").alias("present"), col("absent").cast("array<double>").alias("absent"), "block") \
        .repartition("block").write.partitionBy("block").parquet(folder)
    blocks = -(-len(findings) // size)
    narrow = rows.select(col(key).alias("key"), col("_vector").cast("array<double>").alias("vector"),
                         F.array(*[col(f).cast("int") for f in findings]).alias("labels"))

    def run(batches):
        held, count = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= together:
                yield from scored(held)
                held, count = [], 0
        if held:
            yield from scored(held)

    def scored(held):
        table = pa.Table.from_batches(held).combine_chunks()
        keys, vectors, labels = (table.column(c).chunk(0) for c in ("key", "vector", "labels"))
        matrix = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)
        flat = labels.flatten()
        states = flat.fill_null(uncertain).to_numpy(zero_copy_only=False).reshape(len(keys), len(findings))
        for number in range(blocks):
            first = number * size
            score = _scorer(*_prompt_block(folder, number, first))
            names = pa.array(findings[first: first + size])
            part = states[:, first: first + size]
            step = max(1, CELLS // len(names))
            for a in range(0, len(keys), step):
                row, column = np.nonzero(part[a: a + step] != uncertain)
                if len(row):
                    values = score(matrix[a: a + step])[row, column]
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(column)), keys.take(pa.array(row + a)), pa.array(part[a: a + step][row, column]), pa.array(values)],
                        names=["finding", "key", "y_true", "y_score"])

    kind = rows.schema[key].dataType.simpleString()
    out = narrow.mapInArrow(run, f"finding string, key {kind}, y_true int, y_score double")
    return out.select("finding", col("key").alias(key), "y_true", "y_score")


def _prompt_block(folder: str, number: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The prompts of one block as matrices, a row per finding."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, root = store_of(f"{folder}/block={number}")
    files = [x.path for x in store.get_file_info(fs.FileSelector(root)) if x.path.endswith(".parquet")]
    table = pa.concat_tables([pq.ParquetFile(store.open_input_file(f)).read() for f in files])
    order = np.argsort(table.column("at").to_numpy() - first)
    sides = (table.column(c).combine_chunks() for c in ("present", "absent"))
    return tuple(x.flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1)[order] for x in sides)


def _batch_scorer(present: np.ndarray, absent: np.ndarray):
    """Arrow function from a batch of vectors to its scores for all findings."""
    score = _scorer(present, absent)

    @F.arrow_udf("array<double>")
    def scores(column: pa.Array) -> pa.Array:
        count, (findings, width) = len(column), present.shape
        vectors = column.flatten().to_numpy(zero_copy_only=False).reshape(count, width)
        step = max(1, CELLS // findings)
        values = np.concatenate([score(vectors[i: i + step].astype("f8")) for i in range(0, count, step)] or [np.zeros((0, findings))])
        offsets = np.arange(0, (count + 1) * findings, findings, dtype="i4")
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))

    return scores


def _scorer(present: np.ndarray, absent: np.ndarray):
    """From a matrix of vectors to that of their scores for all findings."""
    eps = COSINE_EPS
    present_norm, absent_norm = np.linalg.norm(present, axis=1), np.linalg.norm(absent, axis=1)

    def similarity(vectors, norms, matrix, matrix_norms):
        return vectors @ matrix.T / np.maximum(np.outer(norms, matrix_norms), eps)

    def score(vectors: np.ndarray) -> np.ndarray:
        norms = np.linalg.norm(vectors, axis=1)
        gap = similarity(vectors, norms, absent, absent_norm) - similarity(vectors, norms, present, present_norm)
        return 1.0 / (1.0 + np.exp(gap))

    return score
