"""Allocation, sampling, splitting and split-checking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.registry import PLACED, SCANS, Tables, query
from cohortlab.operators import checks, sampling
from cohortlab.operators.profile import label_counts, stem_crosstab
from cohortlab.plans import matched_splits, stratified_split

COLUMNS = matched_splits.ScanColumns(id="doc_id", id_num="doc_id", flag="toxic", stratum="lang")
NEGATIVES = {"train": 100, "test": 20}
SUBSAMPLES = [(60, 42), (20, 42), (20, 43), (20, 44), (20, 45), (20, 46)]


def splits_of(t: Tables) -> DataFrame:
    return matched_splits.build_splits(t.scans(), COLUMNS, t.ranges(), NEGATIVES, strict=False)


def subsamples_of(t: Tables) -> DataFrame:
    return matched_splits.build_train_subsamples(t.documents, splits_of(t), COLUMNS, SUBSAMPLES, strict=False)


_ALLOC = """want(split, size) AS (VALUES ('train', 100), ('test', 20)),
cnt AS (SELECT split, lang, count(*) AS n FROM placed WHERE label = 'pos' AND lang IS NOT NULL GROUP BY split, lang),
rounded AS (
  SELECT c.split, lang, n, size, round_even(n / sum(n) OVER (PARTITION BY c.split) * size, 0)::BIGINT AS k
  FROM cnt c JOIN want w ON c.split = w.split),
alloc AS (
  SELECT split, lang, (k + CASE WHEN row_number() OVER (PARTITION BY split ORDER BY k DESC, n DESC, lang) = 1
                                THEN size - sum(k) OVER (PARTITION BY split) ELSE 0 END)::BIGINT AS k FROM rounded)"""
SPLITS = f"""{PLACED}, {_ALLOC},
ranked AS (
  SELECT doc_id, split, lang,
         row_number() OVER (PARTITION BY split, lang ORDER BY md5('42:' || doc_id), doc_id) AS rn
  FROM placed WHERE label = 'neg'),
splits AS (
  SELECT split || '_pos' AS split, doc_id AS id FROM placed WHERE label = 'pos'
  UNION ALL
  SELECT r.split || '_neg', r.doc_id FROM ranked r JOIN alloc a ON r.split = a.split AND r.lang = a.lang
  WHERE rn <= k)"""
_SPECS = ", ".join(
    f"('train_sample_{size}{f'_seed{seed}' if size == 20 else ''}', {size}, {seed})" for size, seed in SUBSAMPLES
)
_SUBSAMPLES = f"""{SPLITS},
pool AS (
  SELECT s.id AS doc_id, CASE s.split WHEN 'train_pos' THEN 'pos' ELSE 'neg' END AS label, d.lang
  FROM splits s JOIN documents d ON s.id = d.doc_id WHERE s.split IN ('train_pos', 'train_neg')),
specs(name, size, seed) AS (VALUES {_SPECS}),
tot AS (SELECT count(*) FILTER (WHERE label = 'pos') AS p, count(*) AS t FROM pool),
sides AS (
  SELECT name, 'pos' AS label, round_even(size * p / t, 0)::BIGINT AS part FROM specs, tot
  UNION ALL
  SELECT name, 'neg', size - round_even(size * p / t, 0)::BIGINT FROM specs, tot),
pool_counts AS (SELECT label, lang, count(*) AS n FROM pool WHERE lang IS NOT NULL GROUP BY label, lang),
part_rounded AS (
  SELECT s.name, s.label, lang, n, part,
         round_even(n / sum(n) OVER (PARTITION BY s.name, s.label) * part, 0)::BIGINT AS k
  FROM sides s JOIN pool_counts c ON s.label = c.label),
part_alloc AS (
  SELECT name, label, lang,
         k + CASE WHEN row_number() OVER (PARTITION BY name, label ORDER BY k DESC, n DESC, lang) = 1
                  THEN part - sum(k) OVER (PARTITION BY name, label) ELSE 0 END AS k FROM part_rounded),
part_ranked AS (
  SELECT s.name, p.label, p.lang, p.doc_id,
         row_number() OVER (PARTITION BY s.name, p.label, p.lang ORDER BY md5(s.seed || ':' || p.doc_id), p.doc_id) AS rn
  FROM pool p, specs s),
subsamples AS (
  SELECT r.name || '_' || r.label AS split, r.doc_id AS id
  FROM part_ranked r JOIN part_alloc a ON r.name = a.name AND r.label = a.label AND r.lang = a.lang
  WHERE rn <= k)"""


@query(f"WITH {PLACED}, {_ALLOC} SELECT split, lang, k FROM alloc")
def q_allocation_drift(t: Tables) -> DataFrame:
    classified = matched_splits.classify(t.scans(), COLUMNS, t.ranges())
    counts = sampling.stratum_counts(classified.filter("label = 'pos'"), "lang", ["split"])
    size = F.coalesce(*[F.when(F.col("split") == s, F.lit(n)) for s, n in NEGATIVES.items()])
    return sampling.rounded_allocation(counts, size, "lang", ["split"])


@query("""
WITH cnt AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source),
exact AS (SELECT source, n / sum(n) OVER () * 150 AS e FROM cnt)
SELECT source, (floor(e) + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, source)
                                     <= 150 - sum(floor(e)) OVER () THEN 1 ELSE 0 END)::BIGINT AS k
FROM exact""")
def q_allocation_largest_remainder(t: Tables) -> DataFrame:
    return sampling.largest_remainder_allocation(sampling.stratum_counts(t.documents, "source"), 150, "source")


@query("""
WITH cnt AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang),
exact AS (SELECT lang, n / sum(n) OVER () * 150 AS e FROM cnt),
alloc AS (
  SELECT lang, floor(e) + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, lang)
                                    <= 150 - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS k FROM exact),
ranked AS (
  SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS rn
  FROM documents)
SELECT doc_id, r.lang, n_chars FROM ranked r JOIN alloc a ON r.lang = a.lang WHERE rn <= k""")
def q_stratified_sample(t: Tables) -> DataFrame:
    documents = t.documents.select("doc_id", "lang", "n_chars")
    allocation = sampling.largest_remainder_allocation(sampling.stratum_counts(documents, "lang"), 150, "lang")
    return sampling.draw(documents, allocation, ["lang"], "doc_id", seed=7)


@query("""
WITH cnt AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang),
exact AS (SELECT lang, n / sum(n) OVER () * 150 AS e FROM cnt),
alloc AS (
  SELECT lang, floor(e) + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, lang)
                                    <= 150 - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS k FROM exact),
ranked AS (
  SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS rn
  FROM documents)
SELECT doc_id, r.lang, n_chars FROM ranked r JOIN alloc a ON r.lang = a.lang WHERE rn <= k""")
def q_stratified_sample_at_once(t: Tables) -> DataFrame:
    """The same sample from one scan of the pool."""
    documents = t.documents.select("doc_id", "lang", "n_chars")
    allocation = sampling.largest_remainder_allocation(sampling.stratum_counts(documents, "lang"), 150, "lang")
    return sampling.draw_at_once(documents, allocation, ["lang"], "doc_id", seed=7)


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 20")
def q_simple_sample(t: Tables) -> DataFrame:
    return sampling.simple_sample(t.documents.select("doc_id"), 20, "doc_id")


@query("""
WITH s AS (SELECT * FROM labels ORDER BY md5('42:' || doc_id), doc_id LIMIT 20)
SELECT 'quality' AS finding, quality::BIGINT AS label, count(*) AS n FROM s GROUP BY quality
UNION ALL SELECT 'toxic', toxic::BIGINT, count(*) FROM s GROUP BY toxic""")
def q_sample_label_counts(t: Tables) -> DataFrame:
    return label_counts(sampling.simple_sample(t.labels, 20, "doc_id"), ["quality", "toxic"])


@query(f"WITH {SPLITS} SELECT split, id FROM splits")
def q_matched_negatives(t: Tables) -> DataFrame:
    return splits_of(t)


_ONE = _SUBSAMPLES.replace(_SPECS, "('train_sample_60', 60, 42)")


@query(f"WITH {_ONE} SELECT split, id FROM subsamples")
def q_ratio_subsample(t: Tables) -> DataFrame:
    return matched_splits.build_train_subsamples(t.documents, splits_of(t), COLUMNS, [(60, 42)], strict=False)


@query(f"WITH {_SUBSAMPLES} SELECT split, id FROM subsamples")
def q_multi_seed_subsamples(t: Tables) -> DataFrame:
    return subsamples_of(t)


@query(f"""WITH {_SUBSAMPLES}
SELECT b.split, count(*) AS n, count(a.id) AS n_in_large FROM subsamples b
LEFT JOIN subsamples a ON a.id = b.id AND a.split IN ('train_sample_60_pos', 'train_sample_60_neg')
WHERE b.split LIKE 'train_sample_20_%' GROUP BY b.split""")
def q_sample_nesting(t: Tables) -> DataFrame:
    """A sample drawn with the seed of a larger one lies inside it; others overlap in part."""
    drawn = subsamples_of(t)
    large = drawn.filter(F.col("split").startswith("train_sample_60_")).select("id", F.lit(1).alias("hit"))
    small = drawn.filter(F.col("split").startswith("train_sample_20_")).join(large, "id", "left")
    return small.groupBy("split").agg(F.count("*").alias("n"), F.count("hit").alias("n_in_large"))


_MEMBERS = """f AS (SELECT doc_id AS id, doc_id IN (SELECT doc_id FROM labels) AS is_member FROM documents),
want AS (SELECT {size} AS size FROM f),
cnt AS (SELECT is_member, count(*) AS n FROM f GROUP BY is_member),
exact AS (SELECT is_member, size, n / sum(n) OVER () * size AS e FROM cnt, want),
alloc AS (
  SELECT is_member, floor(e) + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, is_member)
                                         <= size - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS k FROM exact),
ranked AS (
  SELECT id, is_member, row_number() OVER (PARTITION BY is_member ORDER BY md5('42:' || id), id) AS rn FROM f)"""


@query(f"""WITH {_MEMBERS.format(size="count(*) * 9 // 10")}
SELECT r.id, r.is_member, CASE WHEN rn <= k THEN 'train' ELSE 'test' END AS split
FROM ranked r JOIN alloc a ON r.is_member = a.is_member""")
def q_stratified_split(t: Tables) -> DataFrame:
    ids = t.documents.select(F.col("doc_id").alias("id"))
    marked = t.labels.select(F.col("doc_id").alias("id"))
    return stratified_split.split_by_membership(ids, marked, ids.count() * 9 // 10)


@query(f"""WITH {_MEMBERS.format(size="max(50)")}
SELECT r.id, r.is_member FROM ranked r JOIN alloc a ON r.is_member = a.is_member WHERE rn <= k""")
def q_stratified_sample_ids(t: Tables) -> DataFrame:
    ids = t.documents.select(F.col("doc_id").alias("id"))
    marked = t.labels.select(F.col("doc_id").alias("id"))
    return stratified_split.sample_by_membership(ids, marked, 50)


_CLAIMED = """claimed AS (
  SELECT 'train_pos' AS split, doc_id AS id FROM labels WHERE quality = 1
  UNION ALL SELECT 'test_neg', doc_id FROM labels WHERE quality = 0
  UNION ALL SELECT 'train_neg', doc_id FROM documents WHERE lang = 'es'
  UNION ALL SELECT 'test_pos', event_id FROM events WHERE event_type = 'error')"""


def _rule(rule: str, condition: str, text: str) -> str:
    return (f"SELECT split, '{rule}' AS rule, count(*) AS n_bad, split || '{text}' AS message "
            f"FROM joined WHERE {condition} GROUP BY split")


_RULES = " UNION ALL ".join([
    _rule("positive_flag", "split LIKE '%_pos' AND toxic < 1", ": contains a row with toxic < 1"),
    _rule("negative_flag", "split LIKE '%_neg' AND toxic <> 0", ": contains a row with toxic != 0"),
    _rule("train_range", "split LIKE 'train_%' AND placed = 'test'", ": contains an id outside TRAIN_ID_RANGE"),
    _rule("test_range", "split LIKE 'test_%' AND placed = 'train'", ": contains an id outside TEST_ID_RANGE"),
    _rule("unknown_id", "doc_id IS NULL", ": contains an unknown id"),
    _rule("missing_flag", "doc_id IS NOT NULL AND toxic IS NULL", ": contains a row without toxic"),
])


@query(f"""WITH {PLACED}, {_CLAIMED},
joined AS (SELECT c.split, p.doc_id, p.toxic, p.split AS placed FROM claimed c LEFT JOIN placed p ON c.id = p.doc_id)
{_RULES}""")
def q_split_integrity(t: Tables) -> DataFrame:
    """Splits that were claimed wrongly, so every rule has something to find."""
    claims = {
        "train_pos": t.labels.filter("quality = 1").select("doc_id"),
        "test_neg": t.labels.filter("quality = 0").select("doc_id"),
        "train_neg": t.documents.filter("lang = 'es'").select("doc_id"),
        "test_pos": t.events.filter("event_type = 'error'").select("event_id"),
    }
    listed = [ids.toDF("id").select(F.lit(name).alias("split"), "id") for name, ids in claims.items()]
    claimed = listed[0].union(listed[1]).union(listed[2]).union(listed[3])
    return matched_splits.check_splits(t.scans(), claimed, COLUMNS, t.ranges(), strict=False)


@query(f"""WITH {SPLITS}
SELECT lang, count(*) FILTER (WHERE split = 'train_pos') AS train_pos,
       count(*) FILTER (WHERE split = 'train_neg') AS train_neg,
       count(*) FILTER (WHERE split = 'test_pos') AS test_pos,
       count(*) FILTER (WHERE split = 'test_neg') AS test_neg
FROM splits s JOIN documents d ON s.id = d.doc_id WHERE lang IS NOT NULL GROUP BY lang""")
def q_crosstab(t: Tables) -> DataFrame:
    names = ["train_pos", "train_neg", "test_pos", "test_neg"]
    return matched_splits.crosstab(t.documents, splits_of(t), names, COLUMNS)


@query(f"WITH {SCANS} SELECT count(*) AS n_rows, count(*) FILTER (WHERE toxic IS NULL) AS n_missing FROM scans")
def q_missing_flags(t: Tables) -> DataFrame:
    return checks.missing_flags(t.scans(), "toxic")


@query(f"""WITH {PLACED}, {_ALLOC},
asked AS (SELECT split, lang, k * 3 AS k FROM alloc),
there AS (SELECT split, lang, count(*) AS n FROM placed WHERE label = 'neg' GROUP BY split, lang)
SELECT a.split, a.lang, k::BIGINT AS requested, coalesce(n, 0) AS available, (k - coalesce(n, 0))::BIGINT AS shortfall
FROM asked a LEFT JOIN there t ON a.split = t.split AND a.lang = t.lang WHERE k > coalesce(n, 0)""")
def q_capacity(t: Tables) -> DataFrame:
    """Strata that cannot give three times the matched number of negatives."""
    classified = matched_splits.classify(t.scans(), COLUMNS, t.ranges())
    pool = sampling.stratum_counts(classified.filter("label = 'neg'"), "lang", ["split"])
    counts = sampling.stratum_counts(classified.filter("label = 'pos'"), "lang", ["split"])
    size = F.coalesce(*[F.when(F.col("split") == s, F.lit(n)) for s, n in NEGATIVES.items()])
    asked = sampling.rounded_allocation(counts, size, "lang", ["split"]).withColumn("k", F.col("k") * 3)
    return sampling.capacity_report(asked, pool, ["split", "lang"])


@query("""WITH lists AS (SELECT 'good' AS split, doc_id AS id FROM labels WHERE quality = 1
UNION ALL SELECT 'toxic', doc_id FROM labels WHERE toxic = 1)
SELECT id, count(DISTINCT split) AS n_splits FROM lists GROUP BY id HAVING count(DISTINCT split) > 1""")
def q_overlapping_ids(t: Tables) -> DataFrame:
    good = t.labels.filter("quality = 1").select(F.lit("good").alias("split"), F.col("doc_id").alias("id"))
    toxic = t.labels.filter("toxic = 1").select(F.lit("toxic").alias("split"), F.col("doc_id").alias("id"))
    return checks.overlapping_ids(good.unionByName(toxic))


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT (SELECT (count(*) * 3 // 5)::BIGINT FROM documents)")
def q_simple_sample_large(t: Tables) -> DataFrame:
    """A sample of most rows: the same draw as a small one."""
    return sampling.simple_sample(t.documents.select("doc_id"), t.documents.count() * 3 // 5, "doc_id")


@query("""
WITH ranked AS (
  SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42:' || o_orderkey), o_orderkey) AS rn,
         count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderkey, o_orderpriority FROM ranked WHERE rn <= n // 2""")
def q_draw_refined(t: Tables) -> DataFrame:
    """A draw whose prefixes are refined until few rows are ranked."""
    orders = t.orders.select("o_orderkey", "o_orderpriority")
    halves = sampling.stratum_counts(orders, "o_orderpriority").select("o_orderpriority", F.floor(F.col("n") / 2).alias("k"))
    return sampling.draw(orders, halves, ["o_orderpriority"], "o_orderkey", rank_rows=50)


@query(f"""WITH {SPLITS}, asked(split, wanted) AS (VALUES ('train_neg', 100), ('test_neg', 20))
SELECT w.split, wanted::BIGINT AS wanted, count(s.id) AS drawn FROM asked w LEFT JOIN splits s ON s.split = w.split
GROUP BY w.split, wanted HAVING count(s.id) < wanted""")
def q_split_shortfalls(t: Tables) -> DataFrame:
    """Splits with fewer negatives than asked for; on the smallest tables there is one."""
    return matched_splits.split_shortfalls(splits_of(t), NEGATIVES)


@query(f"""WITH {_SUBSAMPLES}
SELECT lang, regexp_extract(split, '^(.*)_[^_]+$', 1) AS stem, regexp_extract(split, '([^_]+)$', 1) AS label, count(*) AS n
FROM subsamples s JOIN documents d ON s.id = d.doc_id WHERE lang IS NOT NULL GROUP BY ALL""")
def q_stem_crosstab(t: Tables) -> DataFrame:
    """Strata of every subsample, by stem and label of its name."""
    return stem_crosstab(t.documents, subsamples_of(t), "doc_id", "lang")


@query(f"""WITH {SPLITS},
short AS (SELECT w.split || '_neg' AS split, w.size - (SELECT count(*) FROM splits s WHERE s.split = w.split || '_neg') AS n, w.size FROM want w)
SELECT split, 'missing_flag' AS rule, count(*) AS n_bad, split || ': ' || count(*) || ' rows without toxic' AS message
FROM placed WHERE split IS NOT NULL AND toxic IS NULL GROUP BY split
UNION ALL
SELECT split, 'shortfall', n, split || ': ' || (size - n) || ' of ' || size || ' rows' FROM short WHERE n > 0""")
def q_split_build_report(t: Tables) -> DataFrame:
    """What is wrong with splits, counted while they are built."""
    return matched_splits.build_checked_splits(t.scans(), COLUMNS, t.ranges(), NEGATIVES)[1]
