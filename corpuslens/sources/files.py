"""Where files come from: a folder tree, or any table of paths and contents."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corpuslens import config
from corpuslens.functions import paths
from corpuslens.operators.skew import materialise

#: Entries of a folder in one frame, and bytes of content in one batch.
LISTED_AT_ONCE, READ_AT_ONCE = 50_000, 32 << 20
LISTED = "corpus_id string, root string, folder string, file_path string, size_bytes bigint, modified_at timestamp, is_folder boolean"


def decode_text(content: Column) -> Column:
    """UTF-8 text of bytes; what is no UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def from_table(
    table: DataFrame,
    corpus_id: Column,
    path: Column,
    content: Column | None = None,
    root: Column | None = None,
    modified_at: Column | None = None,
) -> DataFrame:
    """The ``files`` table out of any table that knows paths (Parquet, JSON, JDBC, ... as Spark reads them)."""
    columns = [
        corpus_id.alias("corpus_id"),
        path.alias("file_path"),
        (paths.relative_path(path, root) if root is not None else F.translate(path, "\\", "/")).alias("rel_path"),
    ]
    if content is not None:
        columns.append(content.alias("content"))
    if modified_at is not None:
        columns.append(modified_at.alias("modified_at"))
    files = with_names(table.select(*columns))
    return files if content is None else files.withColumn("size_bytes", F.octet_length("content").cast("bigint"))


def with_names(files: DataFrame) -> DataFrame:
    return files.withColumn("filename", paths.filename(F.col("rel_path"))).withColumn(
        "extension", paths.extension(F.col("rel_path"))
    )


def scan(spark: SparkSession, root: str, corpus_id: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """One folder as files with their content, every name included. A missing root is an error."""
    base = root if "://" in root else os.path.abspath(root)
    listed = walk(spark.createDataFrame([(corpus_id, base)], "corpus_id string, root string"), recursive, excluded_folders=())
    if glob:
        listed = listed.filter(F.col("filename").rlike(fnmatch.translate(glob).replace("\\Z", "$").replace("\\z", "$")))
    return read_content(listed.drop("root"))


def walk(roots: DataFrame, recursive: bool = True, excluded_folders: Sequence[str] = config.EXCLUDED_FOLDERS) -> DataFrame:
    """Lists many folder trees at once (``corpus_id, root``), every name included, without content.

    One step per depth: the folders found are spread over the tasks, which list them. Excluded folders
    and links to folders are not entered. A missing root is an error. Roots are local paths on shared storage or
    URIs that pyarrow's file systems know.
    """
    excluded = {f.lower() for f in excluded_folders}

    names = [part.split()[0] for part in LISTED.split(", ")]

    def listing(frames):
        import pandas as pd
        from pyarrow import fs

        for frame in frames:
            for corpus_id, root, folder in zip(frame["corpus_id"], frame["root"], frame["folder"]):
                store, inner = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
                prefix = folder[: len(folder) - len(inner)] if "://" in folder and folder.endswith(inner) else ""
                local = isinstance(store, fs.LocalFileSystem)
                entries = store.get_file_info(fs.FileSelector(inner))
                for at in range(0, len(entries), LISTED_AT_ONCE):
                    rows = []
                    for entry in entries[at : at + LISTED_AT_ONCE]:
                        is_folder = entry.type == fs.FileType.Directory
                        if is_folder and (entry.base_name.lower() in excluded or local and os.path.islink(entry.path)):
                            continue
                        rows.append((corpus_id, root, folder, prefix + entry.path, entry.size, entry.mtime, is_folder))
                    out = pd.DataFrame(rows, columns=names)
                    out["modified_at"] = pd.to_datetime(out["modified_at"], utc=True)
                    out["size_bytes"] = out["size_bytes"].astype("Int64")
                    yield out

    tasks = roots.sparkSession.sparkContext.defaultParallelism * 4
    frontier = roots.select("corpus_id", "root", F.col("root").alias("folder"))
    found = None
    while frontier is not None:
        level = materialise(frontier.repartition(tasks, "folder").mapInPandas(listing, LISTED))
        files = level.filter(~F.col("is_folder"))
        found = files if found is None else found.unionByName(files)
        deeper = level.filter("is_folder").select("corpus_id", "root", F.col("file_path").alias("folder"))
        frontier = deeper if recursive and not deeper.isEmpty() else None
    rel_path = paths.relative_path(F.col("file_path"), F.col("root"))
    return with_names(found.select("corpus_id", "root", "file_path", rel_path.alias("rel_path"), "size_bytes", "modified_at"))


def read_content(files: DataFrame) -> DataFrame:
    """Adds ``content`` and ``read_error`` to listed files: run the filters first, then read only what is left.

    The other columns pass through the stage that reads, so content is never shuffled.
    """
    listed = files.drop("content", "read_error")
    names = listed.columns

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        def out(part, contents, errors):
            columns = [*part.columns, pa.array(contents, pa.binary()), pa.array(errors, pa.string())]
            return pa.RecordBatch.from_arrays(columns, [*names, "content", "read_error"])

        for batch in batches:
            start, size, contents, errors = 0, 0, [], []
            for i, path in enumerate(batch.column(names.index("file_path")).to_pylist()):
                content = error = None
                try:
                    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                    with store.open_input_stream(inner) as stream:
                        content = stream.read()
                except OSError as failure:
                    error = str(failure)
                contents.append(content)
                errors.append(error)
                size += len(content or b"")
                if size >= READ_AT_ONCE:
                    yield out(batch.slice(start, i + 1 - start), contents, errors)
                    start, size, contents, errors = i + 1, 0, [], []
            if contents:
                yield out(batch.slice(start), contents, errors)

    tasks = files.sparkSession.sparkContext.defaultParallelism * 4
    more = [T.StructField("content", T.BinaryType()), T.StructField("read_error", T.StringType())]
    found = listed.repartition(tasks, "file_path").mapInArrow(read, T.StructType([*listed.schema.fields, *more]))
    return found.withColumn("content", decode_text(F.col("content")))
