"""A training corpus from raw documents, stage by stage.

Each stage takes all documents its predecessor kept and returns those that go on, with the columns of the
given table; the last returns their pieces. NULL and empty texts pass the filters (they hold nothing toxic
and resemble nothing) and leave at the mix, which takes words; an empty table stays empty.
"""

from __future__ import annotations

import sys

import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuslens.llm.jaccard import one_of_each
from corpuslens.llm.mixing import mixed
from corpuslens.llm.pieces import encode
from corpuslens.llm.shared import keep
from corpuslens.llm.substrings import with_removed
from corpuslens.llm.tokens import read_model
from corpuslens.llm.toxicity import THRESHOLD, score, train

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECES = "piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents scored as toxic."""
    scored = score(docs, *train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), columns=docs.columns)
    return scored.filter(F.col("__cl_score") < THRESHOLD).drop("__cl_score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group of similar ones."""
    return one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words of windows that an earlier document holds. Texts that lose words have the others joined by
    one space; a document that loses all of them goes, any other stays."""
    cut = with_removed(docs).filter("__cl_n_removed = 0 OR __cl_n_removed < __cl_n_words").withColumn("text", F.coalesce("__cl_kept", "text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col("__cl_n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cut.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by target weights; a document may come up to three times."""
    return mixed(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether they decode to it."""
    found = encode(docs, read_model(public_tokenizers.path(PIECES)), ["doc_id", "source", "text"], decoded=True)
    return found.select(
        "doc_id", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids",
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("lossless"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", to_pieces),
]

#: Learning and hashed schedules are not expressible in SQL; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.split()[0])
    return docs
