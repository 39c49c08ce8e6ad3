"""Connected components of a table of links.

Links are first dealt over tasks of at most ``AT_ONCE`` each; a task joins what its links connect and gives
a star for each part. If that took several tasks, alternating large and small stars finish the work: each
round gives every node's neighbours the smallest node among them, first the larger ones, then the smaller.
Minima combine before they shuffle, and joins on a hot centre can be split: no neighbourhood is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuslens.llm.shared import keep

AT_ONCE = 1_000_000


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := top.setdefault(x, x)) != x:
            top[x] = top[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = root(a), root(b)
            if a != b:
                top[max(a, b)] = min(a, b)
    rows = [(x, r) for x in list(top) if (r := root(x)) != x]
    for at in range(0, len(rows), 1 << 16):
        u, v = zip(*rows[at : at + (1 << 16)])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links`` are rows (u, v) with v < u."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("_m").alias("v")).union(joined.select("u", F.col("_m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """``node, root`` for every node of the links ``a, b`` that is not itself the smallest of its component.

    ``links`` is read twice: give a table.
    """
    tasks = max(1, -(-links.count() // at_once))
    now = keep(links.select("a", "b").repartition(tasks).mapInArrow(_local_stars, "u long, v long"), "stars")
    mark = None
    while tasks > 1:
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark:
            break
        mark = seen
        now = keep(_star(keep(_star(now, True), "large"), False), "small")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
