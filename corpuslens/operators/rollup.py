"""From chunk results to one row per file, and from those to collection records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens import config
from corpuslens.functions import paths
from corpuslens.functions.replies import SECTIONS
from corpuslens.operators.skew import lookup_join, rank_in_group

FILE = ["corpus_id", "rel_path"]
CHUNK_COLUMNS = (
    "chunk_no", "start_line", "end_line", "reported_end_line", "total_lines", "n_sig", "eof", "structural_only",
    "content", "prompt", "prompt_hash", "response", "error", "description", *SECTIONS, "parse_route",
)


def attach_responses(chunks: DataFrame, responses: DataFrame) -> DataFrame:
    """Replies back onto chunks. A chunk without a reply stays, with an error.

    Copies of one chunk may hold a large share of all rows under one hash, so the join cuts hot keys.
    """
    answers = responses.select(
        "prompt_hash", "response", F.coalesce("error", F.when(F.isnull("response"), "empty reply")).alias("error"),
        F.lit(True).alias("_answered"),
    )
    missing = F.col("_answered").isNull() & F.col("chunk_no").isNotNull()
    return (
        lookup_join(chunks, answers, ["prompt_hash"], [*FILE, "chunk_no"], costly=True)
        .withColumn("error", F.when(missing, "no reply").otherwise(F.col("error")))
        .drop("_answered")
    )


def rollup(chunk_analysis: DataFrame, functions: bool = True, dependencies: bool = True) -> DataFrame:
    """One row per file out of its chunk rows, which carry the file's own columns.

    A file without chunks comes as one row with a NULL ``chunk_no`` (``keep_empty``), so it stays
    without a join back to the files and their text is read once. One shuffle on the file key; a group
    is one file's replies, so it is bounded by the size of one file.
    """
    is_chunk = F.col("chunk_no").isNotNull()
    union = lambda c: F.sort_array(
        F.array_distinct(F.array_compact(F.flatten(F.collect_list(F.when(is_chunk, F.col(c))))))
    )
    own = [c for c in chunk_analysis.columns if c not in (*FILE, *CHUNK_COLUMNS)]
    on = {"classes": True, "functions": functions, "dependencies": dependencies}
    return chunk_analysis.groupBy(*FILE).agg(
        *[F.any_value(c).alias(c) for c in own],
        F.coalesce(F.max("total_lines"), F.lit(0)).cast("bigint").alias("total_lines"),
        F.count("chunk_no").alias("chunks"),
        F.count_if(is_chunk & F.col("error").isNull()).alias("chunks_analyzed"),
        F.bool_or(is_chunk & F.col("error").isNotNull()).alias("has_errors"),
        *[union(s).alias(s) if on[s] else F.lit(None).cast("array<string>").alias(s) for s in SECTIONS],
    )


def section(items: Column) -> Column:
    """Sorted distinct items and whether there are any."""
    listed = F.sort_array(F.array_distinct(F.coalesce(items, F.expr("array()").cast("array<string>"))))
    return F.struct(listed.alias("items"), (F.size(listed) > 0).alias("has_items"))


def valid_files(file_analysis: DataFrame) -> DataFrame:
    return file_analysis.filter(F.coalesce("file_path", F.lit("")) != "")


def rejected_files(file_analysis: DataFrame) -> DataFrame:
    return file_analysis.filter(F.coalesce("file_path", F.lit("")) == "").withColumn(
        "reason", F.lit("file_path is blank")
    )


def to_records(file_analysis: DataFrame) -> DataFrame:
    """Summary, class, function and dependency records; entity numbers follow sorted order.

    Narrow: each file row opens into its records, nothing is shuffled. A failed file has only its
    summary record, which tells the error. What a file's records share is worked out once, and what
    each has of its own after the opening.
    """
    summary = F.when(
        F.col("error").isNotNull(), F.concat(F.lit(config.FILE_ERROR_PREFIX), F.col("error"))
    ).otherwise(F.coalesce("summary", F.lit(config.NO_SUMMARY)))
    naming = {
        "classes": ("class", paths.class_name),
        "functions": ("function", paths.function_name),
        "dependencies": ("dependency", paths.module_name),
    }
    failed = F.col("error").isNotNull()
    opened = [F.array(F.struct(F.lit("file_summaries").alias("c"), F.lit(0).alias("i"), summary.cast("string").alias("d")))]
    for name in naming:
        items = F.sort_array(F.array_distinct(F.array_compact(F.col(name))))
        numbered = F.transform(
            F.when(~failed, items), lambda item, i: F.struct(F.lit(name).alias("c"), i.alias("i"), item.cast("string").alias("d"))
        )
        opened.append(F.coalesce(numbered, F.filter(opened[0], lambda r: F.lit(False))))
    version = [c for c in ("modified_at", "content_key") if c in file_analysis.columns]
    rows = (
        valid_files(file_analysis)
        .withColumn("_base", paths.safe_id(F.col("file_path")))
        .select(
            *FILE, "file_path", "filename", *version, "_base", "extension", F.col("error").cast("string").alias("error"),
            F.when(~failed, F.coalesce("total_lines", F.lit(0))).cast("bigint").alias("total_lines"),
            (failed | F.coalesce("has_errors", F.lit(False))).alias("has_error"),
            F.when(~failed, F.coalesce("oversized_file", F.lit(False))).alias("oversized_file"),
            F.explode(F.concat(*opened)).alias("_r"),
        )
    )
    collection, item = F.col("_r.c"), F.col("_r.d")
    of_summary = lambda c, t: F.when(collection == "file_summaries", F.col(c)).cast(t).alias(c)
    suffix, title, kind = F.lit(""), F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (one, rule) in naming.items():
        mine = collection == name
        suffix = F.when(mine, F.concat(F.lit(f"_{one}_"), F.col("_r.i").cast("string"))).otherwise(suffix)
        title, kind = F.when(mine, rule(item)).otherwise(title), F.when(mine, one).otherwise(kind)
    return rows.select(
        collection.alias("collection"), *FILE, F.concat("_base", suffix).alias("id"), item.alias("document"), "file_path", "filename",
        title.alias("name"), kind.alias("type"), of_summary("extension", "string"), of_summary("total_lines", "bigint"),
        of_summary("has_error", "boolean"), of_summary("oversized_file", "boolean"),
        F.when(collection == "file_summaries", F.col("error")).alias("error_message"), *version,
    )


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """All records of a file in ``new`` replace all records of that file in ``old``."""
    touched = new.filter(F.col("collection") == "file_summaries").select(*FILE)  # one row a file
    return old.join(touched, FILE, "left_anti").unionByName(new)


def collection_stats(records: DataFrame) -> DataFrame:
    return records.groupBy("collection").agg(F.count(F.lit(1)).alias("records"))


def project_info(files: DataFrame, source_dir: Column) -> DataFrame:
    """One row per corpus: where it is and how many files it has."""
    return (
        files.groupBy("corpus_id")
        .agg(F.max(source_dir).alias("source_dir"), F.count(F.lit(1)).alias("file_count"))
        .withColumn("analysis_date", F.current_timestamp())
        .withColumn("completed", F.lit(False))
        .withColumn("completion_date", F.lit(None).cast("timestamp"))
    )


def finish_run(info: DataFrame, corpora: DataFrame | None = None) -> DataFrame:
    """Marks corpora complete: those in ``corpora``, or all."""
    if corpora is None:
        marked = info.withColumn("_done", F.lit(True))
    else:
        marked = info.join(corpora.select("corpus_id", F.lit(True).alias("_done")).distinct(), "corpus_id", "left")
    return marked.select(
        *[c for c in info.columns if c not in ("completed", "completion_date")],
        F.coalesce("_done", "completed").alias("completed"),
        F.when(F.col("_done"), F.current_timestamp()).otherwise(F.col("completion_date")).alias("completion_date"),
    )


def run_counts(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files found and files analysed, per corpus."""
    marked = files.select(*FILE).join(
        done.select(*FILE).distinct().withColumn("_done", F.lit(True)), FILE, "left"
    )
    return marked.groupBy("corpus_id").agg(
        F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("_done")).alias("analyzed")
    )


def file_list_pages(files: DataFrame, page: int = config.FILE_LIST_PAGE) -> DataFrame:
    """Sorted paths of each corpus in pages. A group is one page; no task sees a whole corpus."""
    return (
        rank_in_group(files.select("corpus_id", "file_path"), ["corpus_id"], ["file_path"], "_at")
        .withColumn("chunk", F.floor(F.col("_at") / page).cast("int"))
        .groupBy("corpus_id", "chunk")
        .agg(
            F.array_join(F.sort_array(F.collect_list("file_path")), "\n").alias("document"),
            F.count(F.lit(1)).cast("int").alias("count"),
        )
        .withColumn("id", F.concat(F.lit("files_chunk_"), F.col("chunk")))
    )
