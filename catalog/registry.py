"""Registration of queries, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cohortlab.functions.predicates import col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder as attributes, and the roles built from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def scans(self, *extra: str) -> DataFrame:
        """Scan metadata: documents with their labels, which some lack."""
        documents = self.documents.select("doc_id", "lang", *extra)
        return documents.join(self.labels, "doc_id", "left")

    def ranges(self) -> dict[str, tuple[int, int]]:
        """Id ranges of the official split: the first 80 % and the rest."""
        top = self.documents.agg(F.max("doc_id")).first()[0]
        last = (8 * (top + 1) - 1) // 10
        return {"train": (0, last), "test": (last + 1, top)}

    def organs(self) -> DataFrame:
        """Three counts per case, missing for customers without orders."""
        counts = self.orders.groupBy("o_custkey").agg(*[
            F.count_if(F.col("o_orderstatus") == status).alias(name)
            for name, status in (("n_pancreas", "F"), ("n_liver", "O"), ("n_kidney", "P"))
        ])
        return self.customer.select("c_custkey", "c_name").join(
            counts, F.col("c_custkey") == F.col("o_custkey"), "left"
        ).drop("o_custkey")

    def ages(self) -> DataFrame:
        """Age as text; error events carry a unit that makes it unreadable."""
        number = F.get_json_object("props", "$.k")
        age = F.when(F.col("event_type") == "error", F.concat(number, F.lit("Y"))).otherwise(number)
        return self.events.select("event_id", age.alias("age"))


def _comparable(df: DataFrame) -> DataFrame:
    """Integers as BIGINT and doubles at six places, as in the SQL."""
    def plain(field: T.StructField):
        column = col(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(column.cast("double"), 6)
        return column.alias(field.name)

    return df.select([plain(f) for f in df.schema.fields])


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""
    def register(build: Callable[[Tables], DataFrame]):
        @wraps(build)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return _comparable(build(Tables(spark, folder)))

        QUERIES[build.__name__] = run
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


# SQL of the roles above, to start a WITH list.
SCANS = """scans AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, d.text, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
ORGANS = """organs AS (
  SELECT c.c_custkey, c.c_name, o.n_pancreas, o.n_liver, o.n_kidney
  FROM customer c LEFT JOIN (
    SELECT o_custkey,
           count(*) FILTER (WHERE o_orderstatus = 'F') AS n_pancreas,
           count(*) FILTER (WHERE o_orderstatus = 'O') AS n_liver,
           count(*) FILTER (WHERE o_orderstatus = 'P') AS n_kidney
    FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey)"""
AGES = """ages AS (
  SELECT event_id, CASE WHEN event_type = 'error' THEN json_extract_string(props, '$.k') || 'Y'
                        ELSE json_extract_string(props, '$.k') END AS age FROM events),
num AS (
  SELECT event_id, age,
         CASE WHEN regexp_full_match(trim(age), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
              THEN TRY_CAST(trim(age) AS DOUBLE) END AS value FROM ages)"""
PLACED = SCANS + """, placed AS (
  SELECT doc_id, lang, toxic,
         CASE WHEN doc_id * 10 < 8 * ((SELECT max(doc_id) FROM documents) + 1) THEN 'train' ELSE 'test' END AS split,
         CASE WHEN toxic >= 1 THEN 'pos' WHEN toxic = 0 THEN 'neg' END AS label
  FROM scans)"""
