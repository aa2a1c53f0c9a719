"""Integrity checks of splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from cohortlab.constants import OFFICIAL_RANGES
from cohortlab.functions.predicates import col
from cohortlab.functions.text import split_kind, split_label
from cohortlab.operators.cohort import lookup


def _rules(unknown: Column, flag: str, ranges: dict[str, tuple[int, int]]) -> dict[str, tuple[Column, str]]:
    """{rule: (is it broken, message after the split's name)} over columns split, _flag and _num."""
    kind, label = split_kind(F.col("split")), split_label(F.col("split"))
    known, flagged = ~unknown, label.isin("pos", "neg")
    # Message formats are fixed values.
    return {
        "positive_flag": (known & (label == "pos") & (F.col("_flag") < 1), f": contains a row with {flag} < 1"),
        "negative_flag": (known & (label == "neg") & (F.col("_flag") != 0), f": contains a row with {flag} != 0"),
        **{
            f"{name}_range": (
                known & (kind == name) & ~F.col("_num").between(low, high),
                f": contains an id outside {name.upper()}_ID_RANGE",
            )
            for name, (low, high) in ranges.items()
        },
        "unknown_id": (unknown, ": contains an unknown id"),
        "missing_flag": (known & flagged & F.col("_flag").isNull(), f": contains a row without {flag}"),
    }


class WatchedSplits:
    """Counts of rows and broken rules of splits, taken while the splits are written.

    `watch` adds the counts to rows (split, id, _flag, _num) that are about to be written; nothing is read for them. They must be
    written right after, so that each row is counted by the one task whose output is kept. `broken` and `rows` answer after the write.
    """

    def __init__(self, names: list[str], flag: str, ranges: dict[str, tuple[int, int]] = OFFICIAL_RANGES):
        self.names, self._rules = names, _rules(F.lit(False), flag, ranges)
        self._seen = Observation()

    def watch(self, splits: DataFrame) -> DataFrame:
        counts = [F.count_if(F.col("split") == name).alias(f"{i}|rows") for i, name in enumerate(self.names)]
        for i, name in enumerate(self.names):
            counts += [F.count_if((F.col("split") == name) & broken).alias(f"{i}|{rule}") for rule, (broken, _) in self._rules.items()]
        return splits.observe(self._seen, *counts)

    def rows(self) -> dict[str, int]:
        """Rows written of each split."""
        got = self._seen.get
        return {name: got[f"{i}|rows"] for i, name in enumerate(self.names)}

    def broken(self) -> list[tuple[str, str, int, str]]:
        """(split, rule, n_bad, message) of every broken rule."""
        got = self._seen.get
        return [(name, rule, n, name + text) for i, name in enumerate(self.names) for rule, (_, text) in self._rules.items()
                if (n := got[f"{i}|{rule}"])]


def verify_splits(
    df: DataFrame, splits: DataFrame, id_col: str, flag: str, id_num: str,
    ranges: dict[str, tuple[int, int]] = OFFICIAL_RANGES, strict: bool = True,
) -> DataFrame:
    """(split, rule, n_bad, message) for every broken rule; empty means clean.

    `splits` is (split, id). Rules: `pos` splits have flag >= 1, `neg` splits
    have flag = 0, and each range's splits stay inside that range. An unknown
    id, or a missing flag where a rule reads it, raises with `strict`;
    otherwise it is reported under `unknown_id` / `missing_flag`.
    """
    requested = splits.select("split", col("id").alias(id_col))
    table = df.select(col(id_col), col(flag).cast("int").alias("_flag"), col(id_num).alias("_num"))
    # Not read through a raising column: an unknown id is one more count.
    rows = lookup(requested, table, id_col, strict=False)
    rules = _rules(F.col("missing"), flag, ranges)
    counts = rows.groupBy("split").agg(*[F.count_if(broken).alias(rule) for rule, (broken, _) in rules.items()])
    entries = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("n_bad"),
                 F.concat(F.col("split"), F.lit(text)).alias("message"))
        for rule, (_, text) in rules.items()
    ])
    report = counts.select("split", F.inline(entries)).filter(F.col("n_bad") > 0)
    if not strict:
        return report
    fatal = F.col("rule").isin("unknown_id", "missing_flag")
    return report.withColumn(
        "n_bad", F.when(fatal, F.raise_error(F.col("message")).cast("bigint")).otherwise(F.col("n_bad"))
    )


def missing_flags(df: DataFrame, flag: str) -> DataFrame:
    """One row (n_rows, n_missing): rows on which a strict cast would fail."""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(col(flag).isNull()).alias("n_missing"))


def overlapping_ids(splits: DataFrame) -> DataFrame:
    """(id, n_splits) for ids listed in more than one split; empty means disjoint."""
    return splits.groupBy("id").agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")
