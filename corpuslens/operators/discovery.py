"""Which files take part. The filters commute, so Catalyst orders them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens import config
from corpuslens.functions import ignore
from corpuslens.functions.paths import suffix
from corpuslens.operators.skew import lookup_join

IGNORE_FILE = ".gitignore"


def at_root(rel_path: Column) -> Column:
    return ~F.contains(rel_path, F.lit("/"))


def in_excluded_folder(rel_path: Column, folders: Sequence[str]) -> Column:
    """A folder below the root, never the file name itself, is in the list in any case."""
    parts = F.split(F.lower(rel_path), "/")
    inside = F.slice(parts, 1, F.size(parts) - 1)
    return F.arrays_overlap(inside, F.array(*[F.lit(f.lower()) for f in folders]))


def discover(
    files: DataFrame,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] | None = None,
    rules: DataFrame | None = None,
    recursive: bool = False,
    extensions: Sequence[str] = config.EXTENSIONS,
    excluded_folders: Sequence[str] = config.EXCLUDED_FOLDERS,
) -> DataFrame:
    """Files that pass folder, extension, ignore, include and exclude tests.

    Include patterns replace the extension test. ``rules`` holds ``corpus_id`` and ``content``, the
    text of each corpus's ignore file (see ``ignore_files``). Run it on a listing without
    ``content`` where you can: the rules join may shuffle what it is given.
    """
    path = F.col("rel_path")
    kept = files if recursive else files.filter(at_root(path))
    if excluded_folders:
        kept = kept.filter(~in_excluded_folder(path, excluded_folders))
    if include:
        kept = kept.filter(ignore.matches(path, include))
    else:
        kept = kept.filter(F.lower(suffix(path)).isin([e.lower() for e in extensions]))
    if exclude:
        kept = kept.filter(~ignore.matches(path, exclude))
    return kept if rules is None else drop_ignored(kept, rules)


def ignore_files(files: DataFrame) -> DataFrame:
    """The ignore file at the root of each corpus, as ``discover`` wants its rules."""
    return files.filter(F.col("rel_path") == IGNORE_FILE).select("corpus_id", "content")


def drop_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files that their own corpus's rules do not ignore. One rules row per corpus."""
    runs = rules.select("corpus_id", ignore.runs_of(F.col("content")).alias("_runs"))
    return (
        lookup_join(files, runs, ["corpus_id"], ["rel_path"])
        .filter(~ignore.matches_runs(F.col("rel_path"), F.col("_runs")))
        .drop("_runs")
    )


def with_content_key(files: DataFrame) -> DataFrame:
    """Adds ``content_key``, which changes with the file: a hash of the text, or size and time of a listing."""
    if "content_key" in files.columns:
        return files
    if "content" in files.columns:
        return files.withColumn("content_key", F.md5("content"))
    return files.withColumn("content_key", F.concat_ws("@", "size_bytes", F.unix_micros("modified_at")))


def remaining(files: DataFrame, done: DataFrame, keys: Sequence[str] = ("corpus_id", "rel_path")) -> DataFrame:
    """Found but not yet analysed. With ``content_key`` among ``keys`` changed files are found again."""
    return files.join(done.select(*keys).distinct(), list(keys), "left_anti")


def resumable(listed: DataFrame, files: DataFrame, keys: Sequence[str] = ("corpus_id", "rel_path")) -> DataFrame:
    """Listed as remaining and still there."""
    return listed.join(files.select(*keys).distinct(), list(keys), "left_semi")


def vanished(listed: DataFrame, files: DataFrame, keys: Sequence[str] = ("corpus_id", "rel_path")) -> DataFrame:
    """Listed as remaining but gone."""
    return listed.join(files.select(*keys).distinct(), list(keys), "left_anti")
