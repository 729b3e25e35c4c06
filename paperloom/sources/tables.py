"""Readers of the tables that the queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines get captions, addresses, citations, other scripts and so on by their number, so that every rule has rows to work on. The same text is valid in both SQL dialects.
DECORATED = """CASE (doc_id * 7 + line_no) % 19
 WHEN 0 THEN 'Figure ' || (line_no + 1) || ': ' || raw
 WHEN 1 THEN 'https://example.org/d/' || doc_id
 WHEN 2 THEN '[1, 2] (a) ⟦M1⟧ = ⟦M2⟧ 3 px'
 WHEN 3 THEN (line_no + 1) || '. Related Work'
 WHEN 4 THEN 'Abstract: ' || raw
 WHEN 5 THEN raw || ' an object-agnostic and shape- aware model'
 WHEN 6 THEN 'Keywords: ' || raw
 WHEN 7 THEN '这是一个中文句子。第二句在这里！' || raw
 WHEN 8 THEN 'Jane Doe, Rory Lane, Max Planck'
 WHEN 9 THEN '$x_{i} = 1/2 + y$ ' || raw
 WHEN 10 THEN 'where the loss, as we see it, is on the left of the figure and is to be read with the text'
 WHEN 11 THEN ''
 WHEN 12 THEN 'Table IV. ' || raw
 WHEN 13 THEN 'Conclusion'
 WHEN 14 THEN '[12] ' || raw
 ELSE raw END"""

LINES_SQL = f"""lines AS (
 SELECT doc_id, line_no, raw, {DECORATED} AS line FROM (
  SELECT doc_id, i AS line_no, l[i + 1] AS raw FROM (
   SELECT doc_id, l, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no (from 0), raw, line (decorated)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return split_lines(docs).withColumn("line", F.expr(DECORATED))


def split_lines(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw"))
    return rows.withColumn("line_no", F.col("line_no").cast("long"))
