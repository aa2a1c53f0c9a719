"""Quality rules as learned decision lists, in DataFrame functions only.

Text statistics are computed once per document, in the row. Conjunctions of thresholds are then grown and pruned by sequential
covering on counts of labelled rows, and come back as one ordered CASE expression.

Defined cases: NULL and blank texts have zero words and fail the base rule; unlabelled rows and rows with a NULL label are judged
but teach nothing; repeated rows and repeated ids are judged one by one (an id is taught once per row and label); without labels of
both classes the list is empty and only the base rule decides; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cohortlab.llm.common import GAP
from cohortlab.staging import stage

# Bound of the labelled sample that a list is learned from; lowest hashes of the id.
SAMPLE_ROWS = 20_000
SYMBOLS = "#*$%&|<>"
RATES = ("n_words", "mean_chars", "symbol_rate", "dup_line_rate", "repeat_rate")


@dataclass(frozen=True)
class Test:
    """`feature > cut`, or `feature <= cut`."""

    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of every whole text.

    Repeated 3-word windows are found by sorting the window hashes of the row, with their places; words they cover are counted
    from the gaps between places.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    read = docs.select(
        F.col(id_col).alias("doc_id"), words.alias("_w"), lines.alias("_l"),
        F.length(F.regexp_replace(text, GAP, "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
    )
    n = F.size("_w")
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
        F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i"))))
    read = read.select(
        "doc_id", n.cast("bigint").alias("n_words"), "word_chars", "n_symbols", F.size("_l").cast("bigint").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"), F.sort_array(hashes).alias("_s"))
    twice = F.filter(F.col("_s"), lambda x, j: (x.h == F.get(F.col("_s"), j - 1).h) | (x.h == F.get(F.col("_s"), j + 1).h))
    kept = [c for c in read.columns if c != "_s"]
    read = read.select(*kept, F.when(F.size("_s") > 1, F.sort_array(F.transform(twice, lambda x: x.i))).alias("_p"))
    covered = F.aggregate(
        F.transform("_p", lambda p, j: F.coalesce(F.least(F.get(F.col("_p"), j + 1) - p, F.lit(3)), F.lit(3))), F.lit(0), lambda a, b: a + b)
    return read.select(*kept, F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def with_rates(stats: DataFrame) -> DataFrame:
    """The statistics with the length-free rates that rules may test."""
    def per(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return stats.withColumns({
        "mean_chars": per("word_chars", "n_words"), "symbol_rate": per("n_symbols", "n_words"),
        "dup_line_rate": per("n_dup_lines", "n_lines"), "repeat_rate": per("n_repeat_words", "n_words")})


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def learn_list(labelled: DataFrame, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, min_cover: int = 5,
               min_precision: float = 0.9, max_rules: int = 12, max_tests: int = 4) -> list[list[Test]]:
    """Rules that reject, in order; each is a conjunction of thresholds on RATES.

    Reads at most `sample_rows` labelled rows (lowest hashes), as counts per cell of candidate cuts: midpoints between quantiles of
    either class. Two thirds of them grow rules by gain of information, the rest prunes them and decides when to stop.
    """
    rows = stage(labelled.where(F.col(label_col).isin(0, 1)).withColumn("_h", F.xxhash64("doc_id", *RATES))
                 .orderBy("_h").limit(sample_rows))
    steps = [i / 8 for i in range(9)]
    found = rows.groupBy(label_col).agg(*[F.percentile_approx(c, steps, 10_000).alias(c) for c in RATES]).collect()
    if len(found) < 2:
        return []
    cuts = {}
    for name in RATES:
        values = sorted({float(v) for r in found for v in r[name]})
        cuts[name] = [(a + b) / 2 for a, b in zip(values, values[1:])]
    cell = [sum([(F.col(c) > x).cast("int") for x in cuts[c]], F.lit(0)).alias(c) for c in RATES]
    counts = rows.select((F.pmod("_h", F.lit(3)) > 0).alias("grow"), F.col(label_col).cast("int").alias("y"), *cell).groupBy(
        "grow", "y", *RATES).count().collect()
    tests = [(c, above, k) for c in RATES for k in range(len(cuts[c])) for above in (True, False)]
    rules = cover([r.asDict() for r in counts], tests, min_cover, min_precision, max_rules, max_tests)
    return [[Test(c, above, cuts[c][k]) for c, above, k in rule] for rule in rules]


def cover(cells: list[dict], tests: list[tuple], min_cover: int, min_precision: float, max_rules: int, max_tests: int) -> list[list[tuple]]:
    """Sequential covering on counted cells: each rule is grown, pruned, and takes what it covers out of the counts."""
    from math import log2

    def holds(x: dict, t: tuple) -> bool:
        return (x[t[0]] > t[2]) == t[1]

    def tally(rows: list[dict]) -> tuple[int, int]:
        return sum(r["count"] for r in rows if r["y"] == 0), sum(r["count"] for r in rows if r["y"] == 1)

    rules: list[list[tuple]] = []
    left = cells
    while len(rules) < max_rules:
        grow, prune = [r for r in left if r["grow"]], [r for r in left if not r["grow"]]
        rule, inside = [], grow
        bad, good = tally(inside)
        while good and bad and len(rule) < max_tests:
            best, gain = None, 1e-9
            for t in tests:
                b, g = tally([r for r in inside if holds(r, t)])
                value = b * (log2(b / (b + g)) - log2(bad / (bad + good))) if b else 0.0
                if value > gain:
                    best, gain = t, value
            if best is None:
                break
            rule.append(best)
            inside = [r for r in inside if holds(r, best)]
            bad, good = tally(inside)

        def worth(r: list[tuple]) -> float:
            b, g = tally([x for x in prune if all(holds(x, t) for t in r)])
            return (b - g) / (b + g) if b + g else -1.0

        while len(rule) > 1 and (shorter := max((rule[:i] + rule[i + 1:] for i in range(len(rule))), key=worth)) and worth(shorter) >= worth(rule):
            rule = shorter
        b, g = tally([r for r in left if all(holds(r, t) for t in rule)])
        if not rule or b < min_cover or b < min_precision * (b + g) or worth(rule) < 2 * min_precision - 1:
            break
        rules.append(rule)
        left = [r for r in left if not all(holds(r, t) for t in rule)]
    return rules


def verdict(rules: list[list[Test]]) -> Column:
    """One CASE over the rules in order: false where one rejects, else true."""
    out = F.lit(True)
    for rule in reversed(rules):
        condition = rule[0].column()
        for test in rule[1:]:
            condition = condition & test.column()
        out = F.when(condition, False).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics of every document with `base_failed` and `kept`; the list is learned from labelled rows that pass the base rule."""
    stats = with_rates(stage(text_statistics(docs, id_col, text_col)))
    taught = stats.where(~base_failed()).join(
        labels.select(F.col("doc_id"), F.col(label_col)).where(F.col(label_col).isNotNull()).distinct(), "doc_id")
    rules = learn_list(taught, label_col, sample_rows)
    return stats.select("*", base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
