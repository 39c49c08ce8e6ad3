"""Files as a stream: each micro-batch is analysed and stored like a batch run."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuslens.operators.report import file_report
from corpuslens.operators.rollup import FILE, collection_stats, finish_run
from corpuslens.operators.skew import materialise
from corpuslens.plans import analyze
from corpuslens.sources import store as stores

# A sink takes the analysed rows of a micro-batch and its name, which no other batch of any stream has.
Sink = Callable[[DataFrame, str], None]


def latest_version(files: DataFrame, order: str = "modified_at") -> DataFrame:
    """One row per file: the newest by ``order``. Keys alone are compared; the rows of the winners are joined
    back, and only files that come with one row twice are compared whole."""
    rest = [c for c in files.columns if c not in (*FILE, order)]
    keyed = files.withColumn("_mark", F.struct(order, F.xxhash64(*rest)))
    newest = keyed.groupBy(*FILE).agg(F.max("_mark").alias("_mark"), F.count(F.lit(1)).alias("_rows"))
    won = keyed.join(newest, [*FILE, "_mark"]).drop("_mark")
    once = won.filter("_rows = 1").drop("_rows")
    return once.unionByName(won.filter("_rows > 1").drop("_rows").dropDuplicates(FILE))


def store_sink(store: str, embedder=None, dim: int = analyze.DIMENSIONS) -> Sink:
    """Stores a micro-batch under its name, so a replay replaces what it wrote and nothing else."""

    def write(file_analysis: DataFrame, batch: str) -> None:
        stores.write_records(analyze.collection_records(file_analysis, embedder, dim), store, batch)

    return write


def report_sink(folder: str, name: str = "reports") -> Sink:
    """Reports of a micro-batch, one row per file, in a folder of the batch's name."""

    def write(file_analysis: DataFrame, batch: str) -> None:
        file_report(file_analysis).write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")

    return write


def all_of(*sinks: Sink) -> Sink:
    """Several sinks on one analysis, which is computed once."""

    def write(file_analysis: DataFrame, batch: str) -> None:
        rows = materialise(file_analysis)
        for sink in sinks:
            sink(rows, batch)

    return write


def analyze_stream(
    files: DataFrame,
    checkpoint: str,
    sink: Sink,
    provider=analyze.RULES,
    order: str | None = "modified_at",
    **options,
) -> StreamingQuery:
    """Analyses all files that have arrived and stops; run it again to go on where it stopped.

    A file seen twice in one batch counts once, in its newest version; seen again later, it replaces its
    records if it is not older than they are. A batch is named by the id that Spark keeps in the checkpoint
    and by its number, so streams may share a store.
    """

    def batch(files: DataFrame, batch_id: int) -> None:
        once = latest_version(files, order) if order else files
        stream = files.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        sink(analyze.analyze_files(once, provider, **options), f"{stream or uuid.uuid5(uuid.NAMESPACE_URL, checkpoint)}.{batch_id:012d}")

    return (
        files.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def finish(spark, store: str, info: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After the stream has ended: the project rows marked complete, and record counts per collection."""
    return finish_run(info), collection_stats(stores.read_collections(spark, store))
