"""Import graph between the files of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuslens.functions.text import WORD
from corpuslens.operators.skew import lookup_join, rank_in_group

FILE = ["corpus_id", "rel_path"]

# The patterns that name an import, and the text form of the graph.
IMPORT = rf"(?U)import\s+({WORD}+)"
FROM_IMPORT = rf"(?U)from\s+({WORD}+)\s+import"
ENTRY_NAME = "cli.py"
HEADER = "graph TD"
ENTRY_STYLE = "  classDef entryPoint fill:#f96,stroke:#333,stroke-width:2px;"


def extract_imports(files: DataFrame) -> DataFrame:
    """Distinct module names each file imports, found anywhere in its text."""
    named = F.array_union(
        F.regexp_extract_all("content", F.lit(IMPORT), 1), F.regexp_extract_all("content", F.lit(FROM_IMPORT), 1)
    )
    return files.select(*FILE, F.explode(named).alias("module"))


def basename_counts(files: DataFrame) -> DataFrame:
    """How many files share a name, and one of their paths (the only one when the count is 1)."""
    return files.groupBy("corpus_id", "filename").agg(
        F.count(F.lit(1)).alias("files"), F.min("rel_path").alias("first_path")
    )


def import_edges(files: DataFrame) -> DataFrame:
    """Edges ``src_rel_path -> dst_rel_path``: a root file of the name, else the only file of the name.

    The text is scanned once: where the join must first count how hot each name is (one module may be
    imported everywhere), the imports found are written out before. Both targets of a name are merged
    into one lookup row, so one join answers both rules.
    """
    imports = extract_imports(files).select(
        "corpus_id", F.col("rel_path").alias("src_rel_path"), F.concat("module", F.lit(".py")).alias("filename")
    )
    names = (
        files.select("corpus_id", "rel_path", "filename")
        .groupBy("corpus_id", "filename")
        .agg(
            F.bool_or(F.col("rel_path") == F.col("filename")).alias("_at_root"),
            F.count(F.lit(1)).alias("_files"),
            F.min("rel_path").alias("_first"),
        )
        .filter(F.col("_at_root") | (F.col("_files") == 1))
        .select(
            "corpus_id",
            "filename",
            F.when(F.col("_at_root"), F.col("filename")).otherwise(F.col("_first")).alias("dst_rel_path"),
            F.when(F.col("_at_root"), "exact").otherwise("basename").alias("match_kind"),
        )
    )
    # Names are distinct per source and lead to distinct files, so no edge comes twice.
    return lookup_join(imports, names, ["corpus_id", "filename"], ["src_rel_path"], "inner", costly=True).select(
        "corpus_id", "src_rel_path", "dst_rel_path", "match_kind"
    )


def graph_nodes(files: DataFrame) -> DataFrame:
    """Numbered and labelled nodes; a shared name is labelled by its path. Marks the entry point."""
    listed = files.select(*FILE, "file_path", "filename")
    shared = basename_counts(listed).filter(F.col("files") > 1).select(
        "corpus_id", "filename", F.lit(True).alias("_shared")
    )
    entry = (
        listed.filter(F.col("filename") == ENTRY_NAME)
        .groupBy("corpus_id")
        .agg(F.min_by("rel_path", F.struct(F.col("rel_path") != ENTRY_NAME, "file_path")).alias("rel_path"))
        .withColumn("_entry", F.lit(True))
    )
    numbered = rank_in_group(listed, ["corpus_id"], ["file_path"], "_number")
    return (
        lookup_join(numbered, shared, ["corpus_id", "filename"], ["rel_path"])
        .join(entry, FILE, "left")
        .select(
            *FILE,
            F.col("_number").alias("node_no"),
            F.concat(F.lit("f_"), F.col("_number").cast("string")).alias("node_id"),
            F.when(F.col("_shared"), F.col("rel_path")).otherwise(F.col("filename")).alias("label"),
            F.coalesce("_entry", F.lit(False)).alias("is_entry"),
        )
    )


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Text form of the graph, one row per line; read in order of part, src_no, dst_no.

    Rows instead of one string per corpus: the text of a large corpus never sits in one task.
    """
    none = F.lit(None).cast("bigint")
    head = nodes.groupBy("corpus_id").agg(F.bool_or("is_entry").alias("_styled"))
    header = head.select("corpus_id", F.lit(0).alias("part"), none.alias("src_no"), none.alias("dst_no"), F.lit(HEADER).alias("line"))
    style = head.filter("_styled").select(
        "corpus_id", F.lit(1).alias("part"), none.alias("src_no"), none.alias("dst_no"), F.lit(ENTRY_STYLE).alias("line")
    )
    node_lines = nodes.select(
        "corpus_id",
        F.lit(2).alias("part"),
        F.col("node_no").alias("src_no"),
        none.alias("dst_no"),
        F.concat(
            F.lit("  "), "node_id", F.lit('["'), "label", F.lit('"]'),
            F.when(F.col("is_entry"), ":::entryPoint").otherwise(""),
        ).alias("line"),
    )
    numbers = nodes.select(*FILE, "node_no")
    ends = lambda name, no: numbers.select(
        "corpus_id", F.col("rel_path").alias(name), F.col("node_no").alias(no)
    )
    numbered = lookup_join(edges, ends("dst_rel_path", "dst_no"), ["corpus_id", "dst_rel_path"], ["src_rel_path"], "inner")
    numbered = lookup_join(numbered, ends("src_rel_path", "src_no"), ["corpus_id", "src_rel_path"], ["dst_rel_path"], "inner")
    edge_lines = numbered.select(
        "corpus_id",
        F.lit(3).alias("part"),
        "src_no",
        "dst_no",
        F.concat(F.lit("  f_"), F.col("src_no"), F.lit(" --> f_"), F.col("dst_no")).alias("line"),
    )
    return header.unionByName(style).unionByName(node_lines).unionByName(edge_lines)
