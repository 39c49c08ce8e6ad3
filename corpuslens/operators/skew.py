"""Joins and rankings that hold when one key owns a third of all rows."""

from __future__ import annotations

import re
import tempfile
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

ROWS_PER_SPLIT = 1_000_000
NULL_PIECES = 1 << 20
#: Bytes, by Spark's estimate, that one piece of a spread table holds.
PIECE_BYTES = 8 << 20
#: Hot keys that may be broadcast; more of them meet the rows in a shuffle, which Spark splits.
BROADCAST_KEYS = 100_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; only a local session may fall back to a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="corpuslens-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Computed once, kept in the shared folder, safe against lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pieces(df: DataFrame) -> int:
    """Tasks for a table: one a core at least, and more as it grows, so that none holds much over PIECE_BYTES."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-estimated_bytes(df) // PIECE_BYTES))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A scan with fewer splits than cores is spread by key into ``pieces``; a large one is left where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(pieces(df), *keys) if df.rdd.getNumPartitions() <= cores else df


def fits_broadcast(df: DataFrame) -> bool:
    """Spark's own size check: would it broadcast this table by the estimate it has?"""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return 0 <= estimated_bytes(df) <= limit


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    keys: list[str],
    vary: list[str],
    how: str = "left",
    rows_per_split: int = ROWS_PER_SPLIT,
    costly: bool = False,
) -> DataFrame:
    """Join many ``facts`` rows to about one ``dim`` row per key.

    A ``dim`` that Spark knows to be small is broadcast by Spark, and no key can be hot. Otherwise the
    hot keys of ``facts`` are counted with map-side combining. Each is cut into pieces of about
    ``rows_per_split`` rows by a hash of the ``vary`` columns, and its ``dim`` row is repeated per
    piece. Every key of more rows is cut; the list of them is broadcast if it is short. Rows with a NULL
    key, which find nothing, are spread by the same hash.

    The count reads ``facts`` a second time: ``costly`` facts are written out first.
    """
    if fits_broadcast(dim):
        return facts.join(dim, keys, how)
    if costly:
        facts = materialise(facts)
    hot = materialise(
        facts.dropna(subset=keys)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > rows_per_split)
        .select(*keys, F.ceil(F.col("_rows") / rows_per_split).cast("int").alias("_pieces"))
    )
    if hot.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        hot = F.broadcast(hot)
    pieces = F.coalesce("_pieces", F.lit(1))
    spread_by = lambda n: F.pmod(F.xxhash64(*vary), n).cast("int")
    unknown = reduce(or_, [F.col(k).isNull() for k in keys])
    cut = facts.join(hot, keys, "left").withColumn(
        "_piece",
        F.when(unknown, -1 - spread_by(F.lit(NULL_PIECES))).when(pieces > 1, spread_by(pieces)).otherwise(F.lit(0)),
    )
    repeated = dim.join(hot, keys, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return cut.drop("_pieces").join(repeated.drop("_pieces"), [*keys, "_piece"], how).drop("_piece")


def rank_in_group(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """0-based position of each row in its group, without bringing a group into one task.

    Rows are range-partitioned on group and order, numbered inside each partition, and shifted by
    what earlier partitions hold of the same group (one small row per partition and group).
    """
    placed = materialise(
        df.repartitionByRange(*group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    heads = placed.groupBy(*group, "_part").agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_held")
    )
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = heads.select(
        *group, "_part", (F.coalesce(F.sum("_held").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return (
        placed.join(shifts, [*group, "_part"])
        .withColumn(name, F.col("_pos") + F.col("_shift"))
        .drop("_part", "_pos", "_shift")
    )
