"""Substring dedup by level-wise doubling (operator 9).

Windows of ``length / 2`` words that occur in one document alone are dropped; only the others are
extended to ``length`` words and compared again. Which short windows are looked at is decided by their
own content (``winnow``): of every ``length`` words at least one short window is, and equal runs of
words look at the same ones, so no long window is lost while thirteen of fourteen positions are never
moved. A word goes if a window over it also starts in a document with a smaller doc_id.

Windows are compared by 64-bit hashes of their words, at both levels. Hot windows (``HOT``) are resolved
by a grouped minimum, which combines before it shuffles, and a join that Spark may split; all others
meet in sorted runs that are read as a stream.

Cases: NULL text counts as empty (no words). Empty and short texts keep everything. Rows with NULL
doc_id neither lose words nor take any. Repeated rows of one doc_id are one document to each other:
they lose nothing to one another. Columns of any other name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from corpuslens.llm.batches import WORD_SLICE, Rolling, Words, column, mix, slices, winnow
from corpuslens.llm.shared import WORD, keep, row_key, small, text_of

WINDOW_WORDS = 50
#: A short window held by more documents than this is hot.
HOT = 2_000
#: Long windows in one row; they are told apart by the bits of a mask.
RUN = 62

_LONG_BASE = 0xA24BAED4963EE407 | 1


def _anchors(words: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the short window at every word, which of them are looked at, and the end of each word's row."""
    half, n = length // 2, len(words.begin)
    at, stop = np.arange(n), np.repeat(words.first[1:], words.count)
    valid = at + half <= stop
    short = Rolling(words.hashes).hash(at, np.minimum(at + half, n))
    return short, winnow(short, valid, length - half + 1), stop


def short_windows(docs: DataFrame, length: int) -> DataFrame:
    """``doc_id, short``: the short windows looked at, once per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=WORD_SLICE):
            words = Words(column(part, "text"))
            short, marked, _ = _anchors(words, length)
            rows, found = words.owner()[marked], short[marked]
            order = np.lexsort((found, rows))
            rows, found = rows[order], found[order]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id").take(pa.array(rows[new])), pa.array(found[new].view(np.int64))], ["doc_id", "short"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, short long")


def _extended(docs: DataFrame, length: int) -> DataFrame:
    """Rows ``short, doc_id, row_key, start, longs``: the long windows from word ``start`` on that stand on
    the short window ``short`` (the least one inside them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = length // 2
        for part in slices(batches, limit=WORD_SLICE):
            words = Words(column(part, "text"))
            n = len(words.begin)
            short, _, stop = _anchors(words, length)
            at = np.arange(n)
            lists = column(part, "shorts")
            held_in = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            held = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            starts = at[at + length <= stop]
            if not len(starts):
                continue
            least = np.empty(len(starts), np.int64)  # the last of the least short windows inside each long one
            for lo in range(0, len(starts), 1 << 16):
                s = starts[lo : lo + (1 << 16)]
                inside = short[s[:, None] + np.arange(length - half, -1, -1)]
                least[lo : lo + len(s)] = s + (length - half) - inside.argmin(axis=1)
            rows = words.owner()[starts]
            known = np.zeros(len(starts), bool)
            keys = np.sort(_pair(held_in, held))
            if len(keys):
                mine = _pair(rows, short[least])
                place = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                known = keys[place] == mine
            starts, least, rows = starts[known], least[known], rows[known]
            if not len(starts):
                continue
            longs = Rolling(words.hashes, _LONG_BASE).hash(starts, starts + length)
            head = np.ones(len(starts), bool)
            head[1:] = (short[least[1:]] != short[least[:-1]]) | (starts[1:] != starts[:-1] + 1)
            first = np.flatnonzero(head)
            within = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))
            first = np.flatnonzero(within % RUN == 0)
            offsets = np.append(first, len(starts)).astype(np.int32)
            take = pa.array(rows[first])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(short[least[first]].view(np.int64)),
                    column(part, "doc_id").take(take),
                    column(part, "row_key").take(take),
                    pa.array((starts[first] - words.first[rows[first]]).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(longs.view(np.int64))),
                ],
                ["short", "doc_id", "row_key", "start", "longs"],
            )

    return docs.mapInArrow(run, "short long, doc_id long, row_key long, start int, longs array<long>")


def _pair(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return mix(hashes ^ mix(rows.astype(np.uint64) + np.uint64(1)))


def _repeats_in_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``short, doc_id``: which long windows has a smaller doc_id shown before?"""
    current, seen = None, {}
    for batch in batches:
        shorts, ids = column(batch, "short").to_pylist(), column(batch, "doc_id").to_pylist()
        out = []
        for i, longs in enumerate(column(batch, "longs").to_pylist()):
            if shorts[i] != current:
                current, seen = shorts[i], {}
            mask = 0
            for bit, h in enumerate(longs):
                if seen.setdefault(h, ids[i]) < ids[i]:
                    mask |= 1 << bit
            out.append(mask)
        masks = np.array(out, np.int64)
        hit = pa.array(np.flatnonzero(masks))
        yield pa.RecordBatch.from_arrays(
            [column(batch, c).take(hit) for c in ("doc_id", "row_key", "start")] + [pa.array(masks).take(hit)],
            ["doc_id", "row_key", "start", "mask"],
        )


def repeated_starts(docs: DataFrame, length: int = WINDOW_WORDS, hot: int = HOT) -> DataFrame:
    """``doc_id, row_key, starts``: per text the runs ``(start, mask)`` of long windows that a document with
    a smaller doc_id also holds; bit b of ``mask`` stands for the window at word ``start + b``."""
    if length % 2 or length < 2:
        raise ValueError("length must be even")
    named = docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")
    )
    held = keep(short_windows(named, length), "short")
    shared = held.groupBy("short").agg(
        F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most"), F.count(F.lit(1)).alias("_docs")
    ).filter("_least < _most")
    kept = held.join(shared.select("short", "_docs"), "short")
    wanted = keep(
        kept.groupBy("doc_id").agg(
            F.collect_list("short").alias("shorts"),
            F.collect_list(F.when(F.col("_docs") > hot, F.col("short"))).alias("hot"),
        ),
        "wanted",
    )
    # documents without a repeat stay where they are: ids go to them first, if few
    touched = named.withColumn("row_key", row_key("text")).join(small(wanted.select("doc_id")), "doc_id", "left_semi")
    reached = _extended(touched.join(wanted.select("doc_id", "shorts"), "doc_id"), length)
    many = small(wanted.select(F.explode("hot").alias("short")).distinct())
    reached = keep(reached, "long")
    calm = (
        reached.join(many, "short", "left_anti")
        .repartition("short")
        .sortWithinPartitions("short", "doc_id")
        .mapInArrow(_repeats_in_runs, "doc_id long, row_key long, start int, mask long")
    )
    busy = reached.join(many, "short", "left_semi").select(
        "doc_id", "row_key", "start", F.posexplode("longs").alias("bit", "long")
    )
    least = busy.groupBy("long").agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most")).filter("_least < _most")
    found = busy.join(least, "long").filter("doc_id > _least")
    found = found.groupBy("doc_id", "row_key", "start").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")
    )
    return calm.union(found).groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("start", "mask")).alias("starts"))


def removed_words(n: int, starts: list[dict], length: int) -> np.ndarray:
    """Marks the words that any of the windows covers."""
    steps = np.zeros(n + 1, np.int64)
    for run in starts:
        mask, at = run["mask"], run["start"]
        while mask:
            low = mask & -mask
            s = at + low.bit_length() - 1
            steps[s] += 1
            steps[s + length] -= 1
            mask ^= low
    return np.cumsum(steps[:n]) > 0


def with_removed(docs: DataFrame, length: int = WINDOW_WORDS) -> DataFrame:
    """Every row of ``docs`` and ``__cl_n_words, __cl_n_removed, __cl_kept``: its words, those removed, and the kept ones
    joined by one space (NULL where none is removed)."""
    hits = keep(repeated_starts(docs, length), "starts")
    columns = docs.columns
    keyed = docs.withColumn("__cl_id", F.col("doc_id").cast("long")).withColumn("__cl_key", row_key(text_of()))
    named = hits.select(F.col("doc_id").alias("__cl_id"), F.col("row_key").alias("__cl_key"))
    touched = keyed.join(small(named), ["__cl_id", "__cl_key"], "left_semi")
    rest = keyed.join(small(named), ["__cl_id", "__cl_key"], "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            removed, kept, total = [], [], []
            for text, starts in zip(column(part, "text").to_pylist(), column(part, "__cl_starts").to_pylist()):
                words = text.encode().split()
                out = removed_words(len(words), starts, length)
                total.append(len(words))
                removed.append(int(out.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~out)]).decode())
            yield pa.RecordBatch.from_arrays(
                [*(column(part, c) for c in columns), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                [*columns, "__cl_n_words", "__cl_n_removed", "__cl_kept"],
            )

    more = [T.StructField("__cl_n_words", T.LongType()), T.StructField("__cl_n_removed", T.LongType()), T.StructField("__cl_kept", T.StringType())]
    starts = hits.select(F.col("doc_id").alias("__cl_id"), F.col("row_key").alias("__cl_key"), F.col("starts").alias("__cl_starts"))
    cut = touched.join(starts, ["__cl_id", "__cl_key"]).select(*columns, "__cl_starts").mapInArrow(run, T.StructType([*docs.schema.fields, *more]))
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    whole = rest.select(*columns, words.alias("__cl_n_words"), F.lit(0).cast("long").alias("__cl_n_removed"), F.lit(None).cast("string").alias("__cl_kept"))
    return cut.union(whole)


def dedup_substrings(docs: DataFrame, length: int = WINDOW_WORDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, kept_sha256`` for every row; ``kept`` is the kept words joined by one
    space."""
    spaced = F.array_join(F.regexp_extract_all(text_of(), F.lit(WORD), 0), " ")
    kept = F.coalesce("__cl_kept", spaced)
    found = with_removed(docs.select("doc_id", "text"), length)
    return found.select(
        "doc_id", F.col("__cl_n_words").alias("n_words"), F.col("__cl_n_removed").alias("n_removed"), kept.alias("kept"), F.sha2(kept, 256).alias("kept_sha256")
    )
