"""The whole run: files in, rolled-up files and stored collections out."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed
from datetime import datetime, timezone
from itertools import count
from queue import SimpleQueue

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuslens import config
from corpuslens.functions.vectors import DIMENSIONS, Embedder, embed
from corpuslens.operators import chunks, discovery, model, rollup
from corpuslens.operators.skew import checkpoint_dir, materialise
from corpuslens.sources import store as stores
from corpuslens.sources.files import read_content

RULES = "rules"
#: Prompts asked between two commits.
WAVE = 100_000
#: Prompts in one file of a wave.
WAVE_FILE = 20_000
#: Waves under way at once; they share the tasks and the rate of calls of one.
WAVES_AT_ONCE = 8

# Takes chunks with their prompts, gives chunk_analysis: a whole chunk stage of the user's own.
Analyzer = Callable[[DataFrame], DataFrame]


def chunk_files(
    files: DataFrame,
    size: int = config.CHUNK_SIZE,
    overlap: int = 1,
    context: int = config.DEFAULT_CONTEXT_LENGTH,
    functions: bool = True,
    dependencies: bool = True,
    keep_empty: bool = False,
) -> DataFrame:
    """Chunks with their prompts. Narrow: nothing is shuffled."""
    cut = chunks.chunk_significant(chunks.mark_oversized(files, context), size, overlap, keep_empty)
    return model.add_prompts(chunks.mark_structural(cut), functions, dependencies)


def answer(prompts: DataFrame, store: str, provider: model.Provider, wave: int = WAVE, **options) -> DataFrame:
    """Responses for all prompts: asks for those without a good answer in the store, stores what comes, reads
    theirs back. Only the hashes of the prompts meet the store, of which other rows are not shuffled.

    Writing comes before reading on purpose: the stage behind a model must never run twice. Prompts are
    asked in waves of about ``wave``, each stored as soon as it ends, so a broken run keeps what it has.
    """
    spark = prompts.sparkSession
    hashes = materialise(prompts.select("prompt_hash").distinct())
    held = stores.read_responses(spark, store, hashes)
    pending = hashes.count()
    if held is not None:
        held = materialise(held.filter("error IS NULL").select("prompt_hash", "error"))
        pending -= held.count()
    waves = max(1, -(-pending // wave))
    if waves == 1:
        stores.write_responses(model.infer(model.pending_prompts(prompts, held), provider, **options), store)
    else:
        deal = {
            "_wave": F.pmod(F.xxhash64("prompt_hash"), F.lit(waves)).cast("int"),
            "_file": F.pmod(F.xxhash64("prompt_hash", F.lit("file")), F.lit(-(-wave // WAVE_FILE))),
        }
        _ask_waves(model.pending_prompts(prompts, held, deal), waves, store, provider, **options)
    return stores.read_responses(spark, store, hashes)


class Clock:
    """The time, told anew once a second: Spark compiles a stage again for each other time that it writes."""

    def __init__(self) -> None:
        self._told = (0.0, None)

    def now(self) -> datetime:
        told, at = time.monotonic(), self._told
        if at[1] is None or told - at[0] >= 1.0:
            at = self._told = (told, datetime.now(timezone.utc))
        return at[1]


def _ask_waves(
    asked: DataFrame, waves: int, store: str, provider: model.Provider,
    tasks: int | None = None, calls_per_second: float | None = None, **options,
) -> None:
    """Each wave lies in a folder of its own, so none reads the prompts of another. ``WAVES_AT_ONCE`` are under way,
    so a small wave does not hold the cluster while it is planned and committed; together they have no more tasks
    and calls a second than one would have. After a failure no further wave begins."""
    spark = asked.sparkSession
    tasks = tasks or spark.sparkContext.defaultParallelism
    together = min(WAVES_AT_ONCE, waves, tasks)
    shares: SimpleQueue = SimpleQueue()
    for i in range(together):
        shares.put(tasks // together + (i < tasks % together))
    rate = calls_per_second and calls_per_second / together
    folder = f"{checkpoint_dir(spark)}/waves-{uuid.uuid4().hex}"
    asked.select("prompt_hash", "prompt", "_wave").write.partitionBy("_wave").parquet(folder)

    places, stored, clock = count(stores.next_response_part(spark, store)), [], Clock()

    def ask(at: int) -> None:
        part = spark.read.schema("prompt_hash string, prompt string").parquet(f"{folder}/_wave={at}")
        mine = shares.get()
        alone = mine == 1  # a wave that one task asks needs no shuffle
        try:
            answers = model.infer(
                part.coalesce(1) if alone else part, provider, tasks=mine, calls_per_second=rate, **options | {"dealt": alone}
            )
            stores.write_responses(answers, store, fold_after=None, place=next(places), asked_at=clock.now())
            stored.append(at)
        finally:
            shares.put(mine)

    held = sorted(int(name.removeprefix("_wave=")) for name in stores.folder_names(spark, folder))
    with ThreadPoolExecutor(together) as pool:
        running, folded = [pool.submit(ask, at) for at in held], 0
        try:
            for one in as_completed(running):
                one.result()
                if len(stored) >= folded + stores.FAN:  # waves go on during a fold: the next takes all that ended meanwhile
                    folded = len(stored)
                    stores.fold_responses(spark, store)
            stores.fold_responses(spark, store)
        finally:
            for one in running:
                one.cancel()


def analyze_rules(
    files: DataFrame,
    size: int = config.CHUNK_SIZE,
    overlap: int = 1,
    context: int = config.DEFAULT_CONTEXT_LENGTH,
    functions: bool = True,
    dependencies: bool = True,
    keep_empty: bool = False,
) -> DataFrame:
    """``chunk_analysis`` by the built-in patterns: no model, no Python, no shuffle."""
    cut = chunks.chunk_significant(chunks.mark_oversized(files, context), size, overlap, keep_empty)
    return model.rules_analysis(cut, functions, dependencies)


def analyze_files(
    files: DataFrame,
    provider: model.Provider | str = RULES,
    store: str | None = None,
    size: int = config.CHUNK_SIZE,
    overlap: int = 1,
    context: int = config.DEFAULT_CONTEXT_LENGTH,
    functions: bool = True,
    dependencies: bool = True,
    analyzer: Analyzer | None = None,
    **options,
) -> DataFrame:
    """``file_analysis``: one row per file. ``provider`` is RULES or a model provider with a ``store``.

    File columns ride along with the chunks, empty and unreadable files included. An ``analyzer``
    replaces the chunk stage of the rules.
    """
    known = F.col("read_error") if "read_error" in files.columns else F.lit(None).cast("string")
    unread = F.when(F.col("content").isNull(), F.coalesce(known, F.lit("content could not be read")))
    marked = discovery.with_content_key(files).withColumn("file_error", unread)
    if provider == RULES:
        if analyzer is None:
            analysis = analyze_rules(marked, size, overlap, context, functions, dependencies, keep_empty=True)
        else:
            analysis = analyzer(chunk_files(marked, size, overlap, context, functions, dependencies, keep_empty=True))
        summarised = rollup.rollup(analysis, functions, dependencies).withColumn("summary", rules_summary())
    else:
        if store is None:
            raise ValueError("a model provider needs a store for its responses")
        cut = materialise(chunk_files(marked, size, overlap, context, functions, dependencies, keep_empty=True))
        asked = cut.filter(F.col("chunk_no").isNotNull()).select("prompt_hash", "prompt")
        responses = answer(asked, store, provider, **options)
        attached = rollup.attach_responses(cut.drop("content", "prompt"), responses)
        analysis = model.normalise_replies(attached, functions, dependencies)
        prompts = materialise(model.add_summary_prompts(rollup.rollup(analysis, functions, dependencies), functions, dependencies))
        replies = answer(prompts.filter(F.col("prompt").isNotNull()), store, provider, **options)
        summarised = model.add_summaries(prompts, replies)
    failed = F.col("file_error").isNotNull()
    return (
        summarised.withColumn("last_line_analyzed", F.when(failed, F.lit(0)))
        .withColumn("has_errors", F.col("has_errors") | failed)
        .withColumn("summary", F.when(~failed, F.col("summary")))
        .withColumnRenamed("file_error", "error")
        .drop("estimated_tokens", "read_error")
    )


def rules_summary():
    """Summary of a file analysed by patterns: what was counted."""
    count = lambda name, one: F.concat(
        F.coalesce(F.size(name), F.lit(0)).cast("string"), F.lit(f" {one}")
    )
    text = F.concat(
        F.lit("# "), F.col("filename"), F.lit(":\n\n"), F.col("total_lines").cast("string"), F.lit(" lines, "),
        count("classes", "classes, "), count("functions", "functions, "), count("dependencies", "imports."),
    )
    return F.when(F.col("chunks") > 0, text).otherwise(F.lit(config.NO_ANALYSIS))


def collection_records(
    file_analysis: DataFrame, embedder: Embedder | None = None, dim: int = DIMENSIONS
) -> DataFrame:
    """Records with their vectors, ready to store."""
    return embed(rollup.to_records(file_analysis), "document", embedder, dim=dim)


def analyze_corpora(
    files: DataFrame,
    store: str,
    provider: model.Provider | str = RULES,
    *,
    size: int = config.CHUNK_SIZE,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] | None = None,
    rules: DataFrame | None = None,
    obey_gitignore: bool = False,
    recursive: bool = False,
    functions: bool = True,
    dependencies: bool = True,
    context: int = config.DEFAULT_CONTEXT_LENGTH,
    embedder: Embedder | None = None,
    dim: int = DIMENSIONS,
    resume: bool = True,
    label: str | None = None,
    source_dir: Column | None = None,
    **options,
) -> str:
    """Discovers, analyses and stores; gives the generation written. With ``resume`` only files that are not
    stored yet, have changed since, or have failed.

    ``files`` may be a listing without ``content`` (see ``walk``): filters, resume and bookkeeping then
    work on names alone, and only what is left to analyse is read. ``rules`` holds ignore texts per
    corpus; ``obey_gitignore`` takes each corpus's own.
    """
    spark = files.sparkSession
    listing = "content" not in files.columns
    if obey_gitignore and rules is None:
        own = files.filter(F.col("rel_path") == discovery.IGNORE_FILE)
        rules = discovery.ignore_files(read_content(own) if listing else own)
    found = discovery.with_content_key(discovery.discover(files, include, exclude, rules, recursive))
    start_run(found, store, source_dir)
    pending = found
    if resume:
        try:
            done = stores.read_collections(spark, store, ["file_summaries"]).filter(~F.coalesce("has_error", F.lit(False)))
            pending = discovery.remaining(found, done, (*rollup.FILE, "content_key"))
        except ValueError:
            pass  # nothing stored yet
    analysis = analyze_files(
        read_content(pending) if listing else pending,
        provider, store, size, context=context, functions=functions, dependencies=dependencies, **options,
    )
    written = stores.write_records(collection_records(analysis, embedder, dim), store, label)
    end_run(spark, store, found)
    return written


def start_run(found: DataFrame, store: str, source_dir: Column | None = None) -> None:
    """Project rows and paged file lists of the corpora found; corpora stored earlier keep theirs."""
    spark = found.sparkSession
    listed = found.select("corpus_id", "file_path", "rel_path")
    root = F.col("file_path").substr(F.lit(1), F.length("file_path") - F.length("rel_path") - 1)
    for name, new in (
        (stores.PROJECTS, rollup.project_info(listed, root if source_dir is None else source_dir)),
        (stores.FILE_LISTS, rollup.file_list_pages(listed)),
    ):
        old = stores.read_table(spark, store, name)
        if old is not None:
            new = materialise(new)
            new = old.join(new.select("corpus_id").distinct(), "corpus_id", "left_anti").unionByName(new)
        stores.write_table(new, store, name)


def end_run(spark: SparkSession, store: str, corpora: DataFrame | None = None) -> DataFrame:
    """Marks the corpora complete; gives record counts per collection."""
    info = stores.read_table(spark, store, stores.PROJECTS)
    if info is not None:
        stores.write_table(rollup.finish_run(info, corpora), store, stores.PROJECTS)
    return rollup.collection_stats(stores.read_collections(spark, store))
