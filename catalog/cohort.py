"""Selection, membership and column-derivation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.registry import AGES, ORGANS, SCANS, Tables, query
from cohortlab.functions.predicates import all_above_zero, any_at_least_one, definite, nonzero
from cohortlab.functions.text import id_number, non_blank
from cohortlab.operators import cohort
from cohortlab.operators.profile import count_where, preview
from cohortlab.functions.numeric import to_number


@query("""
SELECT doc_id, CASE WHEN doc_id * 10 < 8 * (max(doc_id) OVER () + 1) THEN 'train' ELSE 'test' END AS split
FROM documents""")
def q_id_range_split(t: Tables) -> DataFrame:
    return cohort.official_split(t.documents.select("doc_id"), "doc_id", t.ranges())


@query("SELECT c_custkey, CAST(regexp_extract(c_name, '[0-9]+') AS BIGINT) AS id_num FROM customer")
def q_id_number(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", id_number(F.col("c_name")).alias("id_num"))


@query(f"WITH {SCANS} SELECT doc_id FROM scans WHERE toxic >= 1")
def q_positive_ids(t: Tables) -> DataFrame:
    return cohort.positives(t.scans(), "toxic").select("doc_id")


@query(f"WITH {SCANS} SELECT doc_id, lang, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM scans WHERE toxic = 0")
def q_negative_pool(t: Tables) -> DataFrame:
    return cohort.negative_pool(t.scans(), "toxic")


@query(f"WITH {ORGANS} SELECT c_custkey FROM organs WHERE n_pancreas >= 1")
def q_lesion_cohort(t: Tables) -> DataFrame:
    return cohort.lesion_cohort(t.organs(), "n_pancreas").select("c_custkey")


@query(f"WITH {ORGANS} SELECT c_custkey FROM organs WHERE n_pancreas >= 1 AND (n_liver >= 1 OR n_kidney >= 1)")
def q_compound_cohort(t: Tables) -> DataFrame:
    return cohort.compound_cohort(t.organs(), "n_pancreas", ["n_liver", "n_kidney"]).select("c_custkey")


@query(f"""WITH {ORGANS}
SELECT c_custkey, coalesce(n_pancreas > 0 AND n_liver > 0 AND n_kidney > 0, false) AS in_all,
       coalesce(n_pancreas >= 1, false) OR coalesce(n_liver >= 1, false) OR coalesce(n_kidney >= 1, false) AS in_any
FROM organs""")
def q_case_flags(t: Tables) -> DataFrame:
    names = ["n_pancreas", "n_liver", "n_kidney"]
    flags = {"in_all": all_above_zero(names), "in_any": any_at_least_one(names)}
    return t.organs().select("c_custkey", *[definite(c).alias(name) for name, c in flags.items()])


@query(f"""WITH {SCANS}
SELECT count(*) AS n_rows, count(*) FILTER (WHERE toxic IS NOT NULL AND toxic <> 0) AS n_nonzero,
       count(*) FILTER (WHERE toxic >= 1) AS n_positive FROM scans""")
def q_nonzero_flags(t: Tables) -> DataFrame:
    return count_where(t.scans(), {"n_nonzero": nonzero("toxic"), "n_positive": F.col("toxic") >= 1})


@query("""
SELECT doc_id, i::BIGINT AS line, note FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS note, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
WHERE regexp_matches(note, '[^\\s]')""")
def q_nonblank_text(t: Tables) -> DataFrame:
    """Every line of every text that is not blank."""
    notes = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "note"))
    return notes.withColumn("line", F.col("line") + 1).filter(non_blank(F.col("note")))


@query(f"WITH {AGES} SELECT event_id, round(value, 6) AS value FROM num WHERE value IS NOT NULL")
def q_coerce_numeric(t: Tables) -> DataFrame:
    values = t.ages().select("event_id", to_number(F.col("age")).alias("value"))
    return values.filter(F.col("value").isNotNull())


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def q_semi_join(t: Tables) -> DataFrame:
    good = t.labels.filter("quality = 1")
    return cohort.members(t.documents.select("doc_id", "lang", "n_chars"), good, "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_complement(t: Tables) -> DataFrame:
    return cohort.non_members(t.documents.select("doc_id"), t.labels, "doc_id")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents")
def q_membership_flag(t: Tables) -> DataFrame:
    return cohort.flag_members(t.documents.select("doc_id"), t.labels, "doc_id", "labelled")


@query("""
SELECT d.doc_id, l.quality::BIGINT AS quality, l.toxic::BIGINT AS toxic, l.doc_id IS NULL AS missing
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_lookup(t: Tables) -> DataFrame:
    return cohort.lookup(t.documents.select("doc_id"), t.labels, "doc_id", strict=False)


@query("SELECT l.doc_id, d.lang, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def q_strict_lookup(t: Tables) -> DataFrame:
    return cohort.lookup(t.labels.select("doc_id"), t.documents.select("doc_id", "lang", "n_chars"), "doc_id")


@query("SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 5")
def q_preview(t: Tables) -> DataFrame:
    return preview(t.documents.select("doc_id", "lang", "source", "n_chars"), ["doc_id"])
