"""Tables in the folder that all executors share, and small helpers of the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corpuslens.operators.skew import checkpoint_dir

#: A table of at most so many rows of a few numbers may be broadcast (some 16 MB); a larger one is shuffled.
BROADCAST_ROWS = 500_000

WORD = r"[^\x20\x09-\x0D]+"


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast after its rows are counted and found few; else left to a shuffle join.

    For rows of a few numbers only: never for text, arrays or bytes."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def sent_text(docs: DataFrame, columns: list[str]) -> tuple[list[Column], str]:
    """``columns`` and the text for an Arrow step, and under which name the step finds the text: it is sent once, so
    if it goes along as it is, the step reads it there and takes NULL for empty."""
    if "text" in columns and docs.schema["text"].dataType == T.StringType():
        return [F.col(c) for c in columns], "text"
    return [*(F.col(c) for c in columns), text_of().alias("__cl_text")], "__cl_text"


def row_key(*columns: str) -> Column:
    """Tells rows of one doc_id with different texts apart; equal rows share it."""
    return F.xxhash64(*columns)


def rows_with(docs: DataFrame, table: DataFrame) -> DataFrame:
    """Each different row of ``docs`` (by ``doc_id, __cl_key``) that ``table`` has, once, with the columns of ``table``.

    ``table`` has ``doc_id, __cl_key, __cl_rows``, ``__cl_rows`` being how often ``docs`` repeats the row: only
    repeated rows are shuffled to be dropped. It is broadcast if it stands for few rows, what else it holds
    being a few numbers for each of them.
    """
    right = table.withColumnsRenamed({"doc_id": "__cl_doc", "__cl_key": "__cl_of"})
    if table.agg(F.coalesce(F.sum("__cl_rows"), F.lit(0))).first()[0] <= BROADCAST_ROWS:
        right = F.broadcast(right)
    joined = docs.join(right, docs["doc_id"].eqNullSafe(right["__cl_doc"]) & (docs["__cl_key"] == right["__cl_of"])).drop("__cl_doc", "__cl_of")
    again = joined.filter("__cl_rows > 1").dropDuplicates(["doc_id", "__cl_key"])
    return joined.filter("__cl_rows = 1").union(again)
