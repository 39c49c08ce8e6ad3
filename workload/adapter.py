"""The given tables as files: the same view in Spark and in the checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuslens.operators.skew import spread
from corpuslens.sources.files import with_names

_NAMES = """
WITH q AS (SELECT *, CAST(floor(doc_id / 8) AS BIGINT) AS g, doc_id % 720 AS m,
                  CAST(floor(doc_id / 720) AS BIGINT) AS blk FROM documents)
SELECT doc_id, 'c' || (g % 3) AS corpus_id,
       CASE WHEN blk > 0 THEN 'b' || blk || '/' ELSE '' END
       || CASE doc_id % 10 WHEN 0 THEN 'node_modules/' WHEN 2 THEN 'Build/' WHEN 4 THEN ''
                           ELSE source || '/' || lang || '/' END
       || 'doc_' || m
       || CASE doc_id % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.cs' WHEN 2 THEN '.js' WHEN 3 THEN '.TS'
                          WHEN 4 THEN '.html' WHEN 5 THEN '.css' WHEN 6 THEN '.txt' ELSE '.md' END
       AS rel_path,
       'import doc_' || (8 * ((g * 4 + 3) % 90)) || chr(10)
       || 'from doc_' || (8 * ((g + 6 * (doc_id % 8)) % 90)) || ' import x' || chr(10)
       || {body} AS content
FROM q
"""

# Prose with blank lines and // comment lines.
DOCFILES = _NAMES.format(
    body="replace(replace(text, '. ', '.' || chr(10) || chr(10)), ', ', ',' || chr(10) || '// ')"
)
# Prose with class and function lines.
CODEFILES = _NAMES.format(
    body="replace(replace(text, '. ', '.' || chr(10) || chr(10) || 'class '), ', ', ',' || chr(10) || 'def ')"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id")
    files = spark.sql(sql.replace("FROM documents", "FROM {documents}"), documents=documents)
    return with_names(files).select(
        "*",
        F.concat(F.lit("/"), "corpus_id", F.lit("/"), "rel_path").alias("file_path"),
        F.octet_length("content").cast("bigint").alias("size_bytes"),
    )


def docfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, DOCFILES)


def codefiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, CODEFILES)
