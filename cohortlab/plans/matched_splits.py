"""Splits of a scan collection: positives, matched negatives, train subsamples."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, functions as F

from cohortlab.constants import DEFAULT_SEED, NEGATIVE_COUNTS, OFFICIAL_RANGES, SUBSAMPLES
from cohortlab.functions.predicates import col
from cohortlab.operators.checks import WatchedSplits, verify_splits
from cohortlab.operators.cohort import lookup, official_split, with_class
from cohortlab.operators.profile import split_crosstab
from cohortlab.operators.sampling import matched_negatives, ratio_subsamples
from cohortlab.sources.id_lists import write_split_files, write_splits
from cohortlab.staging import stage


@dataclass(frozen=True)
class ScanColumns:
    """Names of the columns the job reads."""

    id: str = "scan_id"
    id_num: str = "id_num"
    flag: str = "tumor?"
    stratum: str = "ct phase"


def classify(
    df: DataFrame, columns: ScanColumns, ranges: Mapping[str, tuple[int, int]], strict: bool = False
) -> DataFrame:
    """(id, id_num, flag, stratum, split, label) of scans inside a range, in one pass."""
    return with_class(_placed(df, columns, ranges), columns.flag, strict=strict)


def _placed(df: DataFrame, columns: ScanColumns, ranges: Mapping[str, tuple[int, int]]) -> DataFrame:
    read = dict.fromkeys([columns.id, columns.id_num, columns.flag, columns.stratum])
    narrow = df.select([col(c) for c in read])
    return official_split(narrow, columns.id_num, dict(ranges)).filter(F.col("split").isNotNull())


def build_splits(
    df: DataFrame,
    columns: ScanColumns = ScanColumns(),
    ranges: Mapping[str, tuple[int, int]] = OFFICIAL_RANGES,
    negatives: Mapping[str, int] = NEGATIVE_COUNTS,
    seed: int = DEFAULT_SEED,
    strict: bool = True,
    staged: bool = True,
    output: str | None = None,
    flat: bool = False,
) -> DataFrame:
    """(split, id): `{split}_pos` with all positives and `{split}_neg` with
    negatives matched to them; never across splits.

    A missing flag or a pool too small for its share raises; with `strict` off
    they are left out and short, and `split_shortfalls` lists what is missing.

    The classified narrow table is read by several passes of the draw;
    `staged` writes it once instead of deriving it each time. `output` gets a
    folder per split, or with `flat` one file `{split}.txt` per split.
    """
    classified = classify(df, columns, ranges, strict)
    if staged:
        classified = stage(classified)
    splits = matched_negatives(classified, negatives, "split", "label", columns.stratum, columns.id, seed, strict)
    if output and flat:
        write_split_files(splits, output, [f"{s}_{label}" for s in negatives for label in ("pos", "neg")])
    elif output:
        write_splits(splits, output)
    return splits


def build_checked_splits(
    df: DataFrame,
    columns: ScanColumns = ScanColumns(),
    ranges: Mapping[str, tuple[int, int]] = OFFICIAL_RANGES,
    negatives: Mapping[str, int] = NEGATIVE_COUNTS,
    seed: int = DEFAULT_SEED,
    output: str | None = None,
    flat: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(splits, report): the splits of `build_splits`, staged, and what is wrong with them, without another pass.

    The report is (split, rule, n_bad, message). Missing flags are counted while the classified scans are staged (`missing_flag`, by
    range), broken rules and negatives that are short (`shortfall`) while the splits are. Nothing raises; empty means clean.
    """
    names = [f"{s}_{label}" for s in negatives for label in ("pos", "neg")]
    read = Observation()
    lacking = [F.count_if((F.col("split") == s) & col(columns.flag).isNull()).alias(str(i)) for i, s in enumerate(negatives)]
    classified = stage(with_class(_placed(df, columns, ranges).observe(read, *lacking), columns.flag))
    drawn = matched_negatives(classified, negatives, "split", "label", columns.stratum, columns.id, seed,
                              keep={"_flag": columns.flag, "_num": columns.id_num})
    watched = WatchedSplits(names, columns.flag, dict(ranges))
    splits = stage(watched.watch(drawn.withColumn("_flag", F.col("_flag").cast("int")))).select("split", "id")
    rows = watched.rows()
    report = watched.broken() + [(s, "missing_flag", n, f"{s}: {n} rows without {columns.flag}") for i, s in enumerate(negatives)
                                 if (n := read.get[str(i)])]
    report += [(f"{s}_neg", "shortfall", wanted - rows[f"{s}_neg"], f"{s}_neg: {rows[f'{s}_neg']} of {wanted} rows")
               for s, wanted in negatives.items() if rows[f"{s}_neg"] < wanted]
    if output and flat:
        write_split_files(splits, output, names)
    elif output:
        write_splits(splits, output)
    return splits, df.sparkSession.createDataFrame(report, "split string, rule string, n_bad long, message string")


def split_shortfalls(splits: DataFrame, negatives: Mapping[str, int] = NEGATIVE_COUNTS) -> DataFrame:
    """(split, wanted, drawn) of negative splits with fewer ids than asked for."""
    wanted = splits.sparkSession.createDataFrame([(f"{s}_neg", n) for s, n in negatives.items()], "split string, wanted long")
    drawn = splits.groupBy("split").agg(F.count("*").alias("drawn"))
    report = F.broadcast(wanted).join(drawn, "split", "left").select("split", "wanted", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    return report.filter("drawn < wanted")


def build_train_subsamples(
    df: DataFrame,
    splits: DataFrame,
    columns: ScanColumns = ScanColumns(),
    subsamples: list[tuple[int, int]] = SUBSAMPLES,
    train: str = "train",
    strict: bool = True,
    output: str | None = None,
    flat: bool = False,
) -> DataFrame:
    """(split, id): one subsample of the train pool per (size, seed), each with
    the pool's pos:neg ratio and each class's own mix of strata.

    Ids that the metadata lack raise; with `strict` off they count towards the
    ratio, as they are in the lists, and are never drawn.

    Names: `{train}_sample_{size}` for a size drawn once, with `_seed{seed}`
    added for a size drawn with several seeds. `output` and `flat` are those
    of `build_splits`.
    """
    sizes = [size for size, _ in subsamples]
    specs = [
        (f"{train}_sample_{size}" + (f"_seed{seed}" if sizes.count(size) > 1 else ""), size, seed)
        for size, seed in subsamples
    ]
    labels = {f"{train}_pos": "pos", f"{train}_neg": "neg"}
    label = F.coalesce(*[F.when(F.col("split") == name, F.lit(value)) for name, value in labels.items()])
    listed = splits.filter(F.col("split").isin(list(labels))).select(col("id").alias(columns.id), label.alias("label"))
    known = lookup(listed, df.select(col(columns.id), col(columns.stratum)), columns.id, strict)
    pool = stage(known.select(columns.id, "label", col(columns.stratum)))
    drawn = ratio_subsamples(pool, specs, "label", columns.stratum, columns.id, strict)
    if output and flat:
        write_split_files(drawn, output, [f"{name}_{label}" for name, _, _ in specs for label in ("pos", "neg")])
    elif output:
        write_splits(drawn, output)
    return drawn


def check_splits(
    df: DataFrame, splits: DataFrame, columns: ScanColumns = ScanColumns(),
    ranges: Mapping[str, tuple[int, int]] = OFFICIAL_RANGES, strict: bool = True,
) -> DataFrame:
    """Broken rules of the splits; empty means clean."""
    return verify_splits(df, splits, columns.id, columns.flag, columns.id_num, dict(ranges), strict)


def crosstab(df: DataFrame, splits: DataFrame, names: list[str], columns: ScanColumns = ScanColumns()) -> DataFrame:
    """Stratum x split counts, to see negatives track their positives."""
    return split_crosstab(df, splits, columns.id, columns.stratum, names)
