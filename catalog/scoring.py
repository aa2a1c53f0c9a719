"""Embedding-scoring and classifier-evaluation queries.

The finding `finding_c` asks whether an embedding has label c. Its present
prompt is the first embedding with label c, its absent prompt the first with
the next label; those two embeddings are "uncertain" for the finding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.registry import Tables, query
from cohortlab.functions.vectors import cosine
from cohortlab.operators import metrics, zeroshot
from cohortlab.staging import small_table, stage

CLASSES = 10
FINDINGS = [f"finding_{c}" for c in range(CLASSES)]


def first_ids_of(t: Tables) -> DataFrame:
    """(label, first_id): the first embedding of every label."""
    return small_table(t.embeddings.groupBy("label").agg(F.min("vec_id").alias("first_id")))[0]


def exemplars_of(t: Tables, first: DataFrame) -> DataFrame:
    """(label, embedding) of the first embedding of every label."""
    rows = t.embeddings.select("label", F.col("vec_id").alias("first_id"), "embedding")
    return rows.join(first, ["label", "first_id"]).drop("first_id")


def prompt_rows_of(t: Tables, first: DataFrame) -> DataFrame:
    """(finding, polarity, embedding): each exemplar serves two findings."""
    served = F.array(
        F.struct(F.concat(F.lit("finding_"), "label").alias("finding"), F.lit("present").alias("polarity")),
        F.struct(
            F.concat(F.lit("finding_"), F.pmod(F.col("label") + (CLASSES - 1), F.lit(CLASSES))).alias("finding"),
            F.lit("absent").alias("polarity"),
        ),
    )
    return exemplars_of(t, first).select("embedding", F.inline(served))


def labels_of(t: Tables, first: DataFrame) -> DataFrame:
    """Wide labels (vec_id, finding_0..9): 1, 0, or -1 for the finding's own exemplars."""
    rows = t.embeddings.select("vec_id", "label").join(first, "label")
    is_exemplar = F.col("vec_id") == F.col("first_id")

    def state(c: int):
        own = F.col("label").isin(c, (c + 1) % CLASSES)
        return F.when(is_exemplar & own, F.lit(-1)).otherwise((F.col("label") == c).cast("int"))

    return rows.select("vec_id", *[state(c).alias(name) for c, name in enumerate(FINDINGS)])


def scored_of(t: Tables) -> DataFrame:
    first = first_ids_of(t)
    prompts = zeroshot.pair_prompts(prompt_rows_of(t, first))
    return zeroshot.zero_shot_scores(t.embeddings, labels_of(t, first), prompts, FINDINGS, "vec_id")


_EXEMPLARS = "first_of AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label)"
_SCORED = f"""{_EXEMPLARS},
prompts AS (
  SELECT a.label AS c, p.embedding::DOUBLE[] AS present, q.embedding::DOUBLE[] AS absent
  FROM first_of a JOIN embeddings p ON p.vec_id = a.vec_id
  JOIN first_of b ON b.label = (a.label + 1) % 10 JOIN embeddings q ON q.vec_id = b.vec_id),
stated AS (
  SELECT e.vec_id, c, e.embedding::DOUBLE[] AS v,
         CASE WHEN e.vec_id = f.vec_id AND e.label IN (c, (c + 1) % 10) THEN -1 WHEN e.label = c THEN 1 ELSE 0 END AS y
  FROM embeddings e JOIN first_of f ON f.label = e.label, range(10) r(c)),
scored AS (
  SELECT 'finding_' || s.c AS finding, s.vec_id, s.y AS y_true,
         1 / (1 + exp(list_cosine_similarity(v, absent) - list_cosine_similarity(v, present))) AS y_score
  FROM stated s JOIN prompts p ON p.c = s.c WHERE s.y <> -1)"""
_CONFUSION = f"""{_SCORED},
counts AS (
  SELECT finding, count(*) AS n, count(*) FILTER (WHERE y_true = 1) AS n_positive,
         count(*) FILTER (WHERE y_true = 1 AND y_score >= 0.5) AS tp,
         count(*) FILTER (WHERE y_true = 0 AND y_score >= 0.5) AS fp,
         count(*) FILTER (WHERE y_true = 1 AND y_score < 0.5) AS fn,
         count(*) FILTER (WHERE y_true = 0 AND y_score < 0.5) AS tn
  FROM scored GROUP BY finding),
confusion AS (
  SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
         coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM counts)"""
_REPORT = f"""{_CONFUSION},
ranks AS (
  SELECT finding, y_true,
         rank() OVER (PARTITION BY finding ORDER BY y_score)
         + (count(*) OVER (PARTITION BY finding, y_score) - 1) / 2 AS r FROM scored),
area AS (
  SELECT finding, (sum(r) FILTER (WHERE y_true = 1) - sum(y_true) * (sum(y_true) + 1) / 2)
                  / nullif(sum(y_true) * (count(*) - sum(y_true)), 0) AS auroc
  FROM ranks GROUP BY finding),
report AS (
  SELECT c.finding, n, n_positive, auroc, f1, "precision", recall FROM confusion c JOIN area a ON c.finding = a.finding)"""


@query(f"""WITH {_EXEMPLARS}
SELECT e.vec_id, e.label::BIGINT AS label,
       round(list_cosine_similarity(e.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings e JOIN first_of f ON f.label = e.label JOIN embeddings p ON p.vec_id = f.vec_id""")
def q_cosine(t: Tables) -> DataFrame:
    own = small_table(exemplars_of(t, first_ids_of(t)).select("label", F.col("embedding").alias("exemplar")))[0]
    similarity = cosine(F.col("embedding"), F.col("exemplar")).alias("similarity")
    return t.embeddings.join(own, "label").select("vec_id", "label", similarity)


@query(f"""WITH {_EXEMPLARS}
SELECT 'finding_' || a.label AS finding, i::BIGINT AS i, round(p.embedding[i]::DOUBLE, 6) AS present, round(q.embedding[i]::DOUBLE, 6) AS absent
FROM range(1, 65) r(i), first_of a JOIN embeddings p ON p.vec_id = a.vec_id
JOIN first_of b ON b.label = (a.label + 1) % 10 JOIN embeddings q ON q.vec_id = b.vec_id""")
def q_prompt_pairs(t: Tables) -> DataFrame:
    pairs = zeroshot.pair_prompts(prompt_rows_of(t, first_ids_of(t)))
    both = pairs.select("finding", F.posexplode(F.arrays_zip("present", "absent")).alias("i", "x"))
    return both.select("finding", (F.col("i") + 1).alias("i"), "x.present", "x.absent")


@query("""
SELECT e.label::BIGINT AS label, i::BIGINT AS i, round(e.embedding[i]::DOUBLE, 6) AS value
FROM range(1, 65) r(i), embeddings e JOIN (SELECT label, max(vec_id) AS vec_id FROM embeddings GROUP BY label) m ON e.vec_id = m.vec_id""")
def q_latest_embedding(t: Tables) -> DataFrame:
    latest = zeroshot.latest_embedding(t.embeddings, "label", "embedding", "vec_id")
    return latest.select("label", F.posexplode("embedding").alias("i", "value")).withColumn("i", F.col("i") + 1)


@query(f"WITH {_SCORED} SELECT finding, vec_id, y_true::BIGINT AS y_true, round(y_score, 6) AS y_score FROM scored")
def q_zero_shot_scores(t: Tables) -> DataFrame:
    return scored_of(t)


@query(f"WITH {_CONFUSION} SELECT finding, n, n_positive FROM counts")
def q_class_counts(t: Tables) -> DataFrame:
    return metrics.class_counts(scored_of(t), "finding")


@query(f"""WITH {_CONFUSION}
SELECT finding, n, n_positive, tp, fp, fn, tn, round("precision", 6) AS "precision", round(recall, 6) AS recall,
       round(f1, 6) AS f1 FROM confusion""")
def q_confusion_metrics(t: Tables) -> DataFrame:
    return metrics.confusion_metrics(scored_of(t), "finding")


@query(f"WITH {_REPORT} SELECT finding, round(auroc, 6) AS auroc FROM report")
def q_auroc(t: Tables) -> DataFrame:
    return metrics.auroc(stage(scored_of(t)), "finding")


@query(f"""WITH {_REPORT}
SELECT finding, n, n_positive, round(auroc, 6) AS auroc, round(f1, 6) AS f1, round("precision", 6) AS "precision",
       round(recall, 6) AS recall FROM report""")
def q_eval_report(t: Tables) -> DataFrame:
    return metrics.evaluation_report(stage(scored_of(t)), "finding")


@query(f"""WITH {_REPORT}
SELECT count(*) AS n_groups, round(avg(auroc), 6) AS macro_auroc, round(avg(f1), 6) AS macro_f1,
       round(avg("precision"), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall
FROM report WHERE auroc IS NOT NULL""")
def q_macro_average(t: Tables) -> DataFrame:
    return metrics.macro_average(metrics.evaluation_report(stage(scored_of(t)), "finding"))


@query("""
WITH p AS (SELECT quality, toxic, d.n_chars / (SELECT max(n_chars) FROM documents) AS y_score
           FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
r AS (SELECT quality, toxic, rank() OVER (PARTITION BY quality ORDER BY y_score)
             + (count(*) OVER (PARTITION BY quality, y_score) - 1) / 2 AS r FROM p)
SELECT quality::BIGINT AS quality,
       round((sum(r) FILTER (WHERE toxic = 1) - sum(toxic) * (sum(toxic) + 1) / 2)
             / nullif(sum(toxic) * (count(*) - sum(toxic)), 0), 6) AS auroc
FROM r GROUP BY quality""")
def q_auroc_tied_scores(t: Tables) -> DataFrame:
    """Text length as a score for toxicity: copies of documents tie."""
    longest = t.documents.agg(F.max("n_chars")).scalar()
    lengths = t.documents.select("doc_id", (F.col("n_chars") / longest).alias("y_score"))
    return metrics.auroc(stage(t.labels.join(lengths, "doc_id")), "quality", "toxic")


@query(f"WITH {_REPORT} SELECT finding, round(auroc, 6) AS auroc FROM report")
def q_auroc_bucketed(t: Tables) -> DataFrame:
    """The ranking over many buckets of few scores."""
    return metrics.auroc(stage(scored_of(t)), "finding", rows_per_bucket=100)


@query(f"""WITH {_SCORED.replace("1 / (1 + exp(", "CASE WHEN s.vec_id % 3 = 0 THEN 2.0 ELSE 1 / (1 + exp(").replace("absent) - list_cosine_similarity(v, present)))", "absent) - list_cosine_similarity(v, present))) END")},
ranks AS (
  SELECT finding, y_true, rank() OVER (PARTITION BY finding ORDER BY y_score)
         + (count(*) OVER (PARTITION BY finding, y_score) - 1) / 2 AS r FROM scored)
SELECT finding, round((sum(r) FILTER (WHERE y_true = 1) - sum(y_true) * (sum(y_true) + 1) / 2)
                      / nullif(sum(y_true) * (count(*) - sum(y_true)), 0), 6) AS auroc FROM ranks GROUP BY finding""")
def q_auroc_nonfinite(t: Tables) -> DataFrame:
    """Infinite scores rank above all others and tie with each other."""
    score = F.when(F.col("vec_id") % 3 == 0, F.lit(float("inf"))).otherwise(F.col("y_score"))
    return metrics.auroc(stage(scored_of(t).withColumn("y_score", score)), "finding", rows_per_bucket=100)


@query("""
SELECT v.vec_id, NULL::VARCHAR AS finding, 'no label row' AS reason FROM embeddings v
WHERE v.vec_id NOT IN (SELECT doc_id FROM labels)
UNION ALL
SELECT v.vec_id, 'toxic', 'no label' FROM embeddings v JOIN labels l ON l.doc_id = v.vec_id WHERE l.toxic IS NULL""")
def q_scoring_gaps(t: Tables) -> DataFrame:
    """Embeddings against the labels of the documents with their ids, which some lack."""
    return zeroshot.scoring_gaps(t.embeddings, t.labels.withColumnRenamed("doc_id", "vec_id"), ["toxic"], "vec_id")


@query(f"WITH {_SCORED} SELECT finding, vec_id, y_true::BIGINT AS y_true, round(y_score, 6) AS y_score FROM scored")
def q_zero_shot_blocks(t: Tables) -> DataFrame:
    """The same scores from one read of the embeddings, with prompts in blocks of three findings."""
    first = first_ids_of(t)
    prompts, labels = zeroshot.pair_prompts(prompt_rows_of(t, first)), labels_of(t, first)
    return zeroshot.zero_shot_scores(t.embeddings, labels, prompts, FINDINGS, "vec_id", matrix_findings=3)


_PARTIAL = """WITH p AS (
  SELECT d.lang, CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE d.n_chars / 1000.0 END AS y_score, l.toxic AS y_true
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def _partial(t: Tables) -> DataFrame:
    score = F.when(F.col("doc_id") % 5 != 0, F.col("n_chars") / 1000.0)
    return t.scans("n_chars").select("lang", score.alias("y_score"), F.col("toxic").alias("y_true"))


@query(f"""{_PARTIAL}
SELECT lang, count(*) AS n_rows, count(*) FILTER (WHERE y_true IS NULL) AS n_without_truth,
       count(*) FILTER (WHERE y_score IS NULL) AS n_without_score FROM p GROUP BY lang""")
def q_incomplete_scores(t: Tables) -> DataFrame:
    return metrics.incomplete_counts(_partial(t), "lang")


@query(f"""{_PARTIAL}
SELECT lang, count(*) AS n, count(*) FILTER (WHERE y_true = 1) AS n_positive,
       count(*) FILTER (WHERE y_true = 1 AND y_score >= 0.5) AS tp, count(*) FILTER (WHERE y_true = 0 AND y_score >= 0.5) AS fp
FROM p WHERE y_true IS NOT NULL AND y_score IS NOT NULL GROUP BY lang""")
def q_confusion_of_complete_rows(t: Tables) -> DataFrame:
    """Rows without truth or score are left out by every metric alike."""
    return metrics.confusion_metrics(_partial(t), "lang").select("lang", "n", "n_positive", "tp", "fp")


@query("SELECT 'negatives only' AS part, NULL::DOUBLE AS auroc, count(*) AS n FROM labels WHERE toxic = 0")
def q_auroc_of_one_class(t: Tables) -> DataFrame:
    """A group with one class has no AUROC."""
    rows = t.labels.filter("toxic = 0").join(t.documents.select("doc_id", F.col("n_chars").alias("y_score")), "doc_id")
    report = metrics.evaluation_report(stage(rows.withColumn("part", F.lit("negatives only"))), "part", "toxic")
    return report.select("part", "auroc", "n")


@query("""
SELECT DISTINCT o_orderpriority AS finding, x.polarity, x.phrase
FROM orders, (VALUES ('present'), ('absent')) v(polarity),
     LATERAL (SELECT v.polarity AS polarity, CASE WHEN v.polarity = 'present' THEN 'a case of ' ELSE 'no case of ' END || o_orderpriority AS phrase) x""")
def q_flatten_prompts(t: Tables) -> DataFrame:
    """Phrases for the findings that a table names."""
    names = [r[0] for r in t.orders.select("o_orderpriority").distinct().collect()]
    return zeroshot.flatten_prompts(t.spark, {n: (f"a case of {n}", f"no case of {n}") for n in names})
