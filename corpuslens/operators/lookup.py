"""Look-ups by path over stored collections, for whole tables of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuslens.functions import paths as names
from corpuslens.operators.skew import lookup_join

FILE = ["corpus_id", "rel_path"]


def _summaries(collections: DataFrame) -> DataFrame:
    return collections.filter(F.col("collection") == "file_summaries")


def file_summary(collections: DataFrame, paths: DataFrame) -> DataFrame:
    """The summary of each distinct ``corpus_id, path``: by id, else by root-level name, else by full path.

    Each way is an equi-join on the distinct paths; the first way that finds something wins by a
    combining minimum. Where several files share an id, the very path wins, then path order.
    """
    asked = paths.select("corpus_id", "path").distinct().select(
        "*", names.safe_id(F.col("path")).alias("_id"), names.filename(F.col("path")).alias("_name")
    )
    stored = _summaries(collections).select("corpus_id", "id", "rel_path", "file_path")
    ways = None
    for way, (mine, theirs) in enumerate((("_id", "id"), ("_name", "rel_path"), ("path", "file_path")), 1):
        hit = F.struct(F.lit(way).alias("way"), "file_path", "rel_path", "id").alias("_hit")
        side = stored.select("corpus_id", F.col(theirs).alias(mine), hit)
        # Many paths may end in one name, so the join cuts hot keys.
        hits = lookup_join(asked, side, ["corpus_id", mine], ["path"], "inner").select("corpus_id", "path", "_hit")
        ways = hits if ways is None else ways.unionByName(hits)
    order = F.struct(F.col("_hit.way"), F.col("_hit.file_path") != F.col("path"), F.col("_hit.file_path"))
    best = ways.groupBy("corpus_id", "path").agg(F.min_by("_hit", order).alias("_hit"))
    return best.select("corpus_id", "path", F.col("_hit.way").alias("found_by"), F.col("_hit.rel_path").alias("rel_path")).join(
        _summaries(collections).select(*FILE, "id", F.col("document").alias("summary"), "filename", "extension",
                                       "total_lines", "has_error", "oversized_file"),
        FILE,
    )


def file_details(collections: DataFrame, paths: DataFrame, by: str = "path") -> DataFrame:
    """Every record of the asked files (``corpus_id, path``), one row each, ``section`` telling the kind and
    ``path`` which question it answers.

    ``by="path"``: exact ``corpus_id, rel_path``. ``by="filename"``: classes, functions and dependencies
    of every file of that name in the corpus, and the summary with the path's id, or, where no summary
    has it, those of the name.
    """
    if by == "path":
        asked = paths.select("corpus_id", F.col("path").alias("rel_path")).distinct()
        found = lookup_join(collections, asked, FILE, ["id"], "left_semi").withColumn("path", F.col("rel_path"))
    elif by == "filename":
        asked = paths.select(
            "corpus_id", "path", names.safe_id(F.col("path")).alias("id"), names.filename(F.col("path")).alias("filename")
        ).distinct()
        summaries = _summaries(collections)
        known_ids = asked.select("corpus_id", "id", "path")
        unknown = asked.join(summaries.select("corpus_id", "id").distinct(), ["corpus_id", "id"], "left_anti")
        by_id = lookup_join(summaries, known_ids, ["corpus_id", "id"], ["rel_path"], "inner")
        by_name = lookup_join(summaries, unknown.drop("id"), ["corpus_id", "filename"], ["rel_path"], "inner")
        entities = lookup_join(
            collections.filter(F.col("collection") != "file_summaries"),
            asked.drop("id"),
            ["corpus_id", "filename"],
            ["rel_path", "id"],
            "inner",
        )
        found = by_id.unionByName(by_name).unionByName(entities)
    else:
        raise ValueError("by is path or filename")
    section = F.when(F.col("collection") == "file_summaries", "summary").otherwise(F.col("collection"))
    return found.select("path", *FILE, "filename", section.alias("section"), "id", F.col("document").alias("content"), "name")


def list_files(collections: DataFrame) -> DataFrame:
    return _summaries(collections).select(
        "corpus_id",
        "id",
        F.coalesce("file_path", F.lit("Unknown")).alias("file_path"),
        F.coalesce("rel_path", "filename", F.lit("Unknown")).alias("rel_path"),
        F.coalesce("filename", F.lit("Unknown")).alias("filename"),
        F.coalesce("total_lines", F.lit(0)).cast("bigint").alias("total_lines"),
        F.coalesce("has_error", F.lit(False)).alias("has_error"),
    )


def project_info(info: DataFrame, corpus_id: str) -> DataFrame:
    return info.filter(F.col("corpus_id") == corpus_id)
