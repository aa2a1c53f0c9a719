"""Queries that write files to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.registry import SCANS, Tables, query
from catalog.sampling import SPLITS, splits_of
from catalog.scoring import _SCORED, scored_of
from cohortlab.functions.resolve import present_columns
from cohortlab.operators.profile import completeness
from cohortlab.sources import id_lists, metadata, results, volumes
from cohortlab.staging import new_folder, stage


@query("SELECT c_name AS id FROM customer")
def q_id_list_roundtrip(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "ids")
    id_lists.write_ids(t.customer, path, "c_name")
    return id_lists.read_ids(t.spark, path)


@query(f"WITH {SPLITS} SELECT split, id::VARCHAR AS id FROM splits")
def q_split_roundtrip(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "splits")
    id_lists.write_splits(splits_of(t), path)
    return id_lists.read_splits(t.spark, path)


@query(f"WITH {SPLITS} SELECT split, id::VARCHAR AS id FROM splits")
def q_split_files_roundtrip(t: Tables) -> DataFrame:
    """One file of its own name per split."""
    path = new_folder(t.spark, "splits")
    id_lists.write_split_files(splits_of(t), path)
    return id_lists.read_split_files(t.spark, path)


@query(f"""WITH {SPLITS}
SELECT split, split AS id, sum(length(id::VARCHAR) + 1)::BIGINT AS length FROM splits GROUP BY split""")
def q_file_inventory(t: Tables) -> DataFrame:
    """Files of a collection written with one folder for each kind of split: ids and bytes."""
    path = new_folder(t.spark, "splits")
    splits = stage(splits_of(t))
    for kind in ("train", "test"):
        id_lists.write_split_files(splits.where(F.startswith("split", F.lit(kind))), f"{path}/{kind}")
    files = volumes.file_inventory(t.spark, path, ".txt", recursive=True)
    return files.select(F.regexp_extract("path", r"/([^/]+)\.txt$", 1).alias("split"), "id", "length")


@query(f"""WITH {SCANS}
SELECT doc_id, lang, n_chars, quality::BIGINT AS quality, toxic::BIGINT AS toxic, doc_id AS id_num, text FROM scans""")
def q_csv_roundtrip(t: Tables) -> DataFrame:
    """Missing labels are written as NA and come back as missing; texts with line breaks and quotes come back whole."""
    path = new_folder(t.spark, "csv")
    t.scans("n_chars", "text").withColumn("doc_id", F.concat(F.lit("DOC_"), "doc_id")) \
        .write.options(header=True, nullValue="NA", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    types = {"n_chars": "bigint", "quality": "int", "toxic": "int"}
    table = metadata.read_metadata(t.spark, path, types, id_col="doc_id", multi_line=True)
    return table.withColumn("doc_id", F.col("id_num"))


@query(f"""WITH {SCANS}
SELECT doc_id, lang, source, n_chars, quality::BIGINT AS quality, toxic::BIGINT AS toxic, n_chars / 4.0 AS size FROM scans""")
def q_csv_inferred(t: Tables) -> DataFrame:
    """A file of plain lines, read with inferred types; missing labels are written as NA."""
    path = new_folder(t.spark, "csv")
    t.scans("source", "n_chars").withColumn("size", F.col("n_chars") / 4).write.options(header=True, nullValue="NA").csv(path)
    return metadata.read_metadata(t.spark, path, infer=True)


@query(f"""WITH {_SCORED}
SELECT finding, vec_id::VARCHAR AS study_id, y_true::BIGINT AS y_true, round(y_score, 6) AS y_score FROM scored""")
def q_results_json_roundtrip(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "results")
    results.write_results(stage(scored_of(t)), path, "vec_id")
    return results.read_results(t.spark, path)


@query("""
SELECT d.doc_id AS id, 'volumes/' || d.doc_id || '.nii.gz' AS path,
       CASE WHEN l.doc_id IS NULL THEN 'fetch' ELSE 'present' END AS status
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_fetch_manifest(t: Tables) -> DataFrame:
    return volumes.fetch_manifest(t.documents, t.labels, "doc_id", "volumes")


@query(f"""WITH {SCANS}, asked AS (SELECT lang || '_' || source AS id, max(toxic) AS toxic FROM scans GROUP BY ALL)
SELECT id, id || '.txt' AS name, CASE WHEN toxic >= 1 THEN 'present' ELSE 'fetch' END AS status FROM asked WHERE id IS NOT NULL""")
def q_manifest_of_folder(t: Tables) -> DataFrame:
    """What is there comes from an inventory of the folder: one file for each language and source that has a toxic document."""
    path = new_folder(t.spark, "volumes")
    scans = stage(t.scans("source").select(F.concat("lang", F.lit("_"), "source").alias("split"), F.col("doc_id").alias("id"), "toxic").where("split IS NOT NULL"))
    id_lists.write_split_files(scans.where("toxic >= 1"), path)
    asked = scans.select(F.col("split").alias("id")).distinct()
    manifest = volumes.fetch_manifest(asked, volumes.file_inventory(t.spark, path, ".txt"), "id", path, ".txt")
    return manifest.select("id", F.substring_index("path", "/", -1).alias("name"), "status")


@query("""
SELECT doc_id AS id, 'volumes/' || doc_id || '.nii.gz' AS path FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def q_still_to_fetch(t: Tables) -> DataFrame:
    return volumes.still_to_fetch(t.documents, t.labels, "doc_id", "volumes")


@query(f"""WITH {_SCORED}
SELECT finding, vec_id::VARCHAR AS study_id, y_true::BIGINT AS y_true, round(y_score, 6) AS y_score FROM scored""")
def q_results_entries(t: Tables) -> DataFrame:
    """Results in many small entries; the layout is the same."""
    path = new_folder(t.spark, "results")
    results.write_results(stage(scored_of(t)), path, "vec_id", rows_per_entry=50)
    return results.read_results(t.spark, path)


@query(f"""WITH {_SCORED}
SELECT finding, vec_id::VARCHAR AS study_id, y_true::BIGINT AS y_true, round(y_score, 6) AS y_score FROM scored""")
def q_results_document(t: Tables) -> DataFrame:
    """One JSON document, written and read by many tasks."""
    path = new_folder(t.spark, "results") + "/results.json"
    results.write_document(scored_of(t), path, "vec_id")
    return results.read_results(t.spark, path, one_document=True)


@query("""
SELECT id, row_number() OVER (ORDER BY id) AS place FROM (SELECT DISTINCT 'lang=' || lang || '/shelf=' || doc_id % 25 AS id FROM documents)""")
def q_sorted_paths(t: Tables) -> DataFrame:
    """Many folders in path order, each counted once."""
    path = new_folder(t.spark, "paths")
    shelf = (F.col("doc_id") % 25).alias("shelf")
    t.documents.select("lang", shelf, F.col("doc_id").cast("string").alias("value")).repartition("lang", "shelf") \
        .write.partitionBy("lang", "shelf").text(path)
    files = volumes.file_inventory(t.spark, path, ".txt", recursive=True)
    folder = F.regexp_extract("path", r"(lang=[^/]+/shelf=[^/]+)/[^/]+$", 1)
    folders = volumes.numbered_paths(files.select(folder.alias("path")).distinct())
    return folders.select(F.col("path").alias("id"), "place")


@query(f"""WITH {SCANS} SELECT 'quality' AS "column", count(quality) AS n FROM scans UNION ALL SELECT 'toxic', count(toxic) FROM scans""")
def q_present_columns(t: Tables) -> DataFrame:
    """A report over those of the wanted columns that the table has."""
    scans = t.scans()
    present, _ = present_columns(scans.columns, ["quality", "mood", "toxic"])
    return completeness(scans, present).select("column", "n")
