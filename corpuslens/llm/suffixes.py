"""Suffix-array dedup by deep-shallow sorting (operator 8).

Bytes covered by a string of ``LENGTH`` bytes that also starts elsewhere are removed. Only suffixes that
can stand in such a string are sorted: every LENGTH bytes have an anchor, chosen by their content alone, so
equal strings share an anchor at one place; strings that go round in one text are told there (``_anchors``).
A string starts in the first or the second half of the LENGTH - DEPTH bytes before its anchor; either half has
some LENGTH / 2 bytes around the anchor that all its strings hold. Anchors for which these bytes occur once,
told by their hash, are dropped; the others are partitioned by it.

In its task a partition's suffixes are sorted by multikey quicksort to the shallow depth ``DEPTH``; the
groups left, of long common prefixes, are ordered by blind tries. The same is done with what stands
before the anchors, read backwards. Both orders, with the lengths of the common prefixes between
neighbours, tell for every start before an anchor whether its LENGTH bytes occur twice; bytes are
compared, not hashes.

Equal texts are handled once: if a text of LENGTH bytes or more occurs twice, all of it is covered, and
one copy stands for all against other texts, so no group of copies meets anywhere.

Equal contexts of anchors are settled in a stream sorted over all tasks (``_settle``), so a group that is large
because its texts agree goes to no task as a whole. Where more than ``HOT`` different ones stay, their starts
are halved again until a group is of ``HOT`` at most (``_split``).

Cases: NULL counts as empty; texts shorter than LENGTH keep everything; repeated rows cover each other;
rows with NULL doc_id take part like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.llm.batches import BYTE_VALUES, Rolling, buffers, column, slices
from corpuslens.llm.shared import keep, small, text_of

LENGTH = 400
DEPTH = 32
#: Bytes of text in memory at a time; every byte takes some hundred more while anchors are found.
SLICE = 1 << 20
#: Anchors that one task may compare at a time, some 800 bytes each and as much again for the tries.
HOT = 4096

CONTEXT = ["head", "uid", "pos", "lo", "hi", "before", "after"]

_BLOCK = 4


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def multikey_quicksort(strings: list[bytes], depth: int) -> list[list[int]]:
    """Indices in order of the first ``depth`` bytes; those equal so far stay together in one list."""
    out, todo = [], [(list(range(len(strings))), 0)]
    while todo:
        part, at = todo.pop()
        if len(part) < 2 or at >= depth:
            if part:
                out.append(part)
            continue
        stop = min(at + _BLOCK, depth)
        keys = {i: strings[i][at:stop] for i in part}
        pivot = sorted((keys[part[0]], keys[part[len(part) // 2]], keys[part[-1]]))[1]
        less = [i for i in part if keys[i] < pivot]
        same = [i for i in part if keys[i] == pivot]
        more = [i for i in part if keys[i] > pivot]
        # strings that end inside the block are equal to the end
        todo += [(more, at), (same, stop if len(pivot) == stop - at else depth), (less, at)]
    return out


class BlindTrie:
    """A Patricia trie over strings: inner nodes hold a depth and a branch per byte (-1: the end)."""

    def __init__(self, strings: list[bytes], members: list[int]):
        self.strings = strings
        self.root: list | None = None
        for i in members:
            self.insert(i)

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [len(s), None, [i]]
            return
        node = self.root
        while node[1] is not None:  # blindly: bytes between the branches are not looked at
            children = node[1]
            node = children.get(s[node[0]] if node[0] < len(s) else -1) or next(iter(children.values()))
        other = self.strings[node[2][0]]
        if s == other:
            node[2].append(i)
            return
        length = common(s, other)
        node = self.root
        while node[1] is not None and node[0] < length:
            node = node[1][s[node[0]] if node[0] < len(s) else -1]
        mine = s[length] if length < len(s) else -1
        if node[1] is not None and node[0] == length:
            node[1][mine] = [len(s), None, [i]]
        else:
            below = [node[0], node[1], node[2]]
            node[0], node[2] = length, None
            node[1] = {(other[length] if length < len(other) else -1): below, mine: [len(s), None, [i]]}

    def ordered(self) -> tuple[list[int], list[int]]:
        """Members in order, and the common prefix of each with the one before."""
        order, lengths = [], []
        todo = [(self.root, 0)] if self.root else []
        while todo:
            node, above = todo.pop()
            if node[1] is None:
                order += node[2]
                lengths += [above] + [node[0]] * (len(node[2]) - 1)
            else:
                for byte in sorted(node[1], reverse=True):
                    todo.append((node[1][byte], node[0]))
                # the leftmost child takes over what separates this node from the one before
                todo[-1] = (todo[-1][0], above)
        return order, lengths


def deep_shallow(strings: list[bytes], depth: int) -> list[tuple[list[int], list[int]]]:
    """Groups of strings equal to ``depth``, in order, each ordered inside with its common prefixes."""
    return [BlindTrie(strings, group).ordered() for group in multikey_quicksort(strings, depth)]


def repeated_ranges(lefts: list[bytes], rights: list[bytes], length: int, depth: int, order: list[int], shared: list[int]) -> list[list[tuple[int, int]]]:
    """For every anchor of a group the ranges (first, last) of a for which the ``length`` bytes that start a
    bytes before it occur at two anchors. ``order`` and ``shared`` are those of the right sides."""
    m = len(order)
    out: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    most = length - depth
    if m < 2:
        return out
    if m == 2:
        i, j = order
        first, last = max(0, length - shared[1]), min(most, common(lefts[i], lefts[j]))
        if first <= last:
            out[0].append((first, last))
            out[1].append((first, last))
        return out
    left_order, left_shared = BlindTrie([lefts[i] for i in order], list(range(m))).ordered()
    left_at = np.empty(m, np.int64)
    left_at[left_order] = np.arange(m)
    left_shared, right_shared = np.array(left_shared), np.array(shared)
    before = np.array([len(lefts[i]) for i in order])
    after = np.array([len(rights[i]) for i in order])
    breaks = np.unique(np.concatenate([[0], left_shared + 1, length - right_shared, before + 1, length - after]))
    breaks = breaks[(breaks >= 0) & (breaks <= most)]
    for a, b in zip(breaks.tolist(), [*(breaks[1:] - 1).tolist(), most]):
        right_class = np.cumsum(right_shared < length - a)
        left_class = np.cumsum(left_shared < a)[left_at] if a else 0
        there = (before >= a) & (after >= length - a)
        key = np.where(there, right_class * (m + 1) + left_class, -1 - np.arange(m))
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        for i in np.flatnonzero(count[which] > 1).tolist():
            if out[i] and out[i][-1][1] == a - 1:
                out[i][-1] = (out[i][-1][0], b)
            else:
                out[i].append((a, b))
    return out


def _sides(length: int, depth: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """The starts before an anchor, ``lo`` to ``hi`` bytes, in two halves."""
    middle = (length - depth) // 2
    return (0, middle), (middle + 1, length - depth)


def _leftmost(values: np.ndarray, width: int) -> np.ndarray:
    """Of every ``width`` neighbours the place of the least, the first of equal ones."""
    place, have = np.arange(len(values), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        left, right = values[:-step], values[step:]
        place = np.where(right < left, place[step:], place[:-step])
        values = np.minimum(left, right)
        have += step
    return place


def _repeats_nearby(data: np.ndarray, rolling: Rolling, start: np.ndarray, gap: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which of the ascending ``start`` have the ``length`` bytes that stand ``gap`` before (0: nowhere), and the
    ranges of bytes that such strings and those before them cover. Bytes are compared."""
    again = np.zeros(len(start), bool)
    some = np.flatnonzero(gap)
    here, there = start[some], start[some] - gap[some]
    some = some[rolling.hash(here, here + length) == rolling.hash(there, there + length)]
    covered = []
    for run in np.split(some, np.flatnonzero((np.diff(start[some]) != 1) | (np.diff(gap[some]) != 0)) + 1):
        if len(run):
            first, last, back = int(start[run[0]]), int(start[run[-1]]) + length, int(gap[run[0]])
            if np.array_equal(data[first:last], data[first - back : last - back]):
                again[run] = True
                covered.append((first - back, last))
    return again, covered


def _anchors(docs: DataFrame, length: int, depth: int) -> DataFrame:
    """``uid, pos, early, late, last``: places of the anchors, and for each half of the starts a hash of the bytes
    around the anchor that all its strings hold; NULL if none of them fits into the text. Rows with ``last`` are
    covered bytes instead, from ``pos`` on.

    Every string of ``length`` bytes has its anchor where the least hash of ``depth`` bytes first stands in it. In
    a text that goes round, such as one word many times, that is a place for each round. A string that stands the
    distance of two such anchors before itself is covered, and the earlier one asks for both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE):
            data, offsets = buffers(column(part, "text"))
            n = len(data)
            if n < length:
                continue
            row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
            at = np.arange(n)
            rolling = Rolling(BYTE_VALUES[data])
            heads = rolling.hash(at, np.minimum(at + depth, n))
            start = np.flatnonzero(at + length <= offsets[row + 1])
            if not len(start):
                continue
            place = _leftmost(heads, length - depth + 1)[start].astype(np.int64)
            new = np.concatenate([[True], place[1:] != place[:-1]])
            marked = place[new]
            alike = (heads[marked[1:]] == heads[marked[:-1]]) & (row[marked[1:]] == row[marked[:-1]])
            gap = np.concatenate([[0], np.where(alike, np.diff(marked), 0)])[np.cumsum(new) - 1]
            gap[start - gap < offsets[row[start]]] = 0
            again, covered = _repeats_nearby(data, rolling, start, gap, length)
            asked = place[~again]
            marked = asked[np.concatenate([[True], asked[1:] != asked[:-1]])]
            owner = row[marked]
            before, after = marked - offsets[owner], offsets[owner + 1] - marked
            keys = []
            for lo, hi in _sides(length, depth):
                farthest = np.minimum(hi, before)
                fits = (farthest >= lo) & (after >= length - farthest)
                hashes = np.zeros(len(marked), np.uint64)
                hashes[fits] = rolling.hash(marked[fits] - lo, marked[fits] + length - hi)
                keys.append(pa.array(hashes.view(np.int64), mask=~fits))
            uid = column(part, "uid")
            yield pa.RecordBatch.from_arrays(
                [uid.take(pa.array(owner)), pa.array(before.astype(np.int32)), *keys, pa.nulls(len(marked), pa.int32())],
                ["uid", "pos", "early", "late", "last"],
            )
            if covered:
                first, last = np.array(covered).T
                none = pa.nulls(len(first), pa.int64())
                spans = [pa.array((x - offsets[row[first]]).astype(np.int32)) for x in (first, last)]
                yield pa.RecordBatch.from_arrays(
                    [uid.take(pa.array(row[first])), spans[0], none, none, spans[1]], ["uid", "pos", "early", "late", "last"]
                )

    return docs.select("uid", "text").mapInArrow(run, "uid long, pos int, early long, late long, last int")


def _with_last(held: pa.RecordBatch | None, batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by ``head`` those that share it with a neighbour. The first and the last row of a task stay
    as well, their neighbours being elsewhere."""
    held, linked = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = _with_last(held, batch)
        head = column(batch, "head").to_numpy()
        same = head[1:] == head[:-1]
        before = np.concatenate([[linked], same])
        yield batch.slice(0, len(head) - 1).filter(pa.array(before[:-1] | same))
        held, linked = batch.slice(len(head) - 1), bool(before[-1])
    if held is not None:
        yield held


def _contexts(docs: DataFrame, length: int, depth: int) -> DataFrame:
    """``head, uid, pos, lo, hi, before, after``: the bytes around each anchor that the strings starting ``lo`` to
    ``hi`` bytes before it can hold; ``before`` is read backwards."""
    sides = _sides(length, depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE):
            data, offsets = buffers(column(part, "text"))
            raw = data.tobytes()
            back = raw[::-1]
            n = len(raw)
            rows = offsets.tolist()
            cols = [[] for _ in range(7)]
            for i, (uid, marks) in enumerate(zip(column(part, "uid").to_pylist(), column(part, "marks").to_pylist())):
                a, b = rows[i], rows[i + 1]
                for mark in marks:
                    x = a + mark["pos"]
                    lo, hi = sides[mark["side"]]
                    found = mark["head"], uid, mark["pos"], lo, hi, back[n - x : n - max(a, x - hi)], raw[x : min(b, x + length - lo)]
                    for values, value in zip(cols, found):
                        values.append(value)
            kinds = pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], CONTEXT)

    return docs.mapInArrow(run, "head long, uid long, pos int, lo int, hi int, before binary, after binary")


def _settle(rows: DataFrame, length: int) -> DataFrame:
    """Contexts sorted so that equal ones of a head follow each other, whichever tasks they lie in: those equal to
    a neighbour have all their starts covered, ``first, last``. Of a run one row in each task keeps its bytes and
    stands for the others. A task holds one batch, never a group."""
    order = ["head", "before", "after", "uid", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(batch: pa.RecordBatch, leads: np.ndarray, alike: np.ndarray) -> pa.RecordBatch:
            number = lambda name: column(batch, name).to_numpy().astype(np.int64)
            size = lambda name: pc.binary_length(column(batch, name)).to_numpy().astype(np.int64)
            low, high = np.maximum(number("lo"), length - size("after")), np.minimum(number("hi"), size("before"))
            none, picked = ~(alike & (low <= high)), pa.array(np.arange(batch.num_rows), mask=~leads)
            spans = [pa.array(x.astype(np.int32), mask=none) for x in (number("pos") - high, number("pos") - low + length)]
            kept = [column(batch, name).take(picked) for name in ("before", "after")]
            return pa.RecordBatch.from_arrays([*(column(batch, name) for name in CONTEXT[:5]), *kept, *spans], [*CONTEXT, "first", "last"])

        held, linked = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = _with_last(held, batch)
            equal = lambda name: pc.equal(column(batch, name).slice(1), column(batch, name).slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            same = equal("head") & equal("before") & equal("after")
            copy = same & equal("uid") & equal("pos")  # a copy of one row
            if copy.any():
                stays = np.concatenate([[True], ~copy])
                batch = batch.filter(pa.array(stays))
                same = same[~copy]
            before = np.concatenate([[linked], same])
            if batch.num_rows > 1:
                yield out(batch.slice(0, batch.num_rows - 1), ~before[:-1], before[:-1] | same)
            held, linked = batch.slice(batch.num_rows - 1), bool(before[-1])
        if held is not None:
            yield out(held, np.array([not linked]), np.array([linked]))

    schema = "head long, uid long, pos int, lo int, hi int, before binary, after binary, first int, last int"
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def _covered(length: int, depth: int, at_once: int = 2_000):
    """Rows sorted by ``head`` to ``uid, first, last``: covered bytes."""

    def of(rows: list[tuple]) -> Iterator[tuple[int, int, int]]:
        if len(rows) < 2:
            return
        lefts, rights = [r[3] for r in rows], [r[4] for r in rows]
        for order, shared in deep_shallow(rights, depth):
            for i, ranges in zip(order, repeated_ranges(lefts, rights, length, depth, order, shared)):
                for a, b in ranges:
                    yield rows[i][1], rows[i][2] - b, rows[i][2] - a + length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}  # by head; whole groups only are sorted
        size, current = 0, None

        def out(groups: dict[int, list[tuple]]) -> pa.RecordBatch:
            found = [f for rows in groups.values() for f in of(rows)]
            cols = list(zip(*found)) or [[], [], []]
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], ["uid", "first", "last"]
            )

        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != current:
                    if size >= at_once:
                        yield out(held)
                        held, size = {}, 0
                    current, seen = row[0], set()
                if (row[1], row[2]) in seen:  # a copy of one row
                    continue
                seen.add((row[1], row[2]))
                held.setdefault(row[0], []).append(row)
                size += 1
        yield out(held)

    return run


def _split(rows: DataFrame, length: int, limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Contexts to ``uid, first, last`` of what is settled, and contexts, in groups of at most ``limit`` by ``head``,
    that tell the rest.

    A row asks about the starts ``lo`` to ``hi`` bytes before its anchor, so only ``hi`` bytes before and
    ``length - lo`` after it count. Where both are those of another anchor, all these starts are covered, and
    one row stands for both. Where more than ``limit`` stay, each half of the starts is asked alone: it can be
    equal only where the ``lo`` bytes before and ``length - hi`` after agree, which makes the new groups. Halves
    of one start are the strings themselves, of which a task of the sort leaves one, so this ends after
    log2(length) rounds.
    """
    settled, groups = [], []
    while True:
        told = keep(_settle(rows, length), "told")
        settled.append(told.filter(F.col("first").isNotNull()).select("uid", "first", "last"))
        ones = told.filter(F.col("before").isNotNull()).select(*CONTEXT)
        hot = keep(ones.filter("lo < hi").groupBy("head").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select("head"), "heads")
        if not hot.limit(1).count():
            groups.append(ones)
            return settled, groups
        groups.append(ones.join(small(hot), "head", "left_anti"))
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        half = F.explode(F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi"))))
        asked = ones.join(small(hot), "head", "left_semi").select("uid", "pos", "before", "after", half.alias("_h")).select("uid", "pos", "_h.*", "before", "after").filter(
            (F.octet_length("before") >= F.col("lo")) & (F.octet_length("after") >= F.lit(length) - F.col("hi"))
        )
        agreed = F.xxhash64("lo", "hi", F.substring("before", F.lit(1), F.col("lo")), F.substring("after", F.lit(1), F.lit(length) - F.col("hi")))
        rows = keep(
            asked.select(
                agreed.alias("head"), "uid", "pos", "lo", "hi", F.substring("before", F.lit(1), F.col("hi")).alias("before"),
                F.substring("after", F.lit(1), F.lit(length) - F.col("lo")).alias("after"),
            ),
            "halves",
        )


def covered_spans(base: DataFrame, length: int = LENGTH, depth: int = DEPTH, limit: int = HOT) -> DataFrame:
    """``uid, spans``: of each different text the covered byte ranges ``(first, last)``, ``last`` not included.

    ``base`` has ``doc_id, text, uid``. Texts that are covered as copies are not listed for that alone.
    """
    anchors = keep(_anchors(base, length, depth).distinct(), "anchors")
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(name).alias("head")) for i, name in enumerate(("early", "late"))]))
    asked = anchors.select("uid", "pos", sides.alias("_s")).select("_s.head", "uid", "pos", "_s.side").filter(F.col("head").isNotNull())
    order = ["head", "uid", "pos"]
    shared = asked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_shared, asked.schema)
    marks = keep(shared.groupBy("uid").agg(F.collect_list(F.struct("pos", "side", "head")).alias("marks")), "marks")
    # only texts with marks travel, one document for all of its copies
    few = small(marks.select("uid").join(base.groupBy("uid").agg(F.min("doc_id").alias("_rep")), "uid"))
    texts = base.join(few, (base["uid"] == few["uid"]) & base["doc_id"].eqNullSafe(few["_rep"])).select(base["uid"], "text")
    contexts = keep(_contexts(texts.join(marks, "uid").select("uid", "text", "marks"), length, depth), "contexts")
    settled, groups = _split(contexts, length, limit)
    settled.append(anchors.filter(F.col("last").isNotNull()).select("uid", F.col("pos").alias("first"), "last"))
    sorted_ = reduce(DataFrame.union, groups).select("head", "uid", "pos", "before", "after").repartition("head").sortWithinPartitions("head")
    found = reduce(DataFrame.union, [sorted_.mapInArrow(_covered(length, depth), "uid long, first int, last int"), *settled])
    return found.distinct().groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def text_ids(docs: DataFrame, hashed: Column | None = None) -> DataFrame:
    """``doc_id, text, uid``: texts have one ``uid`` if they are equal. Where different texts share a hash of 64
    bits (some 70 pairs of 5*10^10 texts), a second hash, which tells them apart, becomes their ``uid``."""
    base = docs.select("doc_id", text_of().alias("text")).withColumn("uid", F.xxhash64("text") if hashed is None else hashed)
    second = F.xxhash64(F.lit(1), "text")
    told = base.groupBy("uid").agg(F.min(second).alias("_a"), F.max(second).alias("_b")).filter("_a <> _b")
    shared = keep(told.select("uid"), "shared")
    if not shared.limit(1).count():
        return base
    mixed = base.join(small(shared).withColumn("_mixed", F.lit(True)), "uid", "left")
    return mixed.select("doc_id", "text", F.when(F.col("_mixed"), second).otherwise(F.col("uid")).alias("uid"))


def dedup_suffixes(docs: DataFrame, length: int = LENGTH, depth: int = DEPTH, limit: int = HOT, hashed: Column | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256`` of every row; ``kept`` are bytes."""
    if not 0 < depth < length:
        raise ValueError("depth must be less than length")
    base = text_ids(docs, hashed)
    spans = keep(covered_spans(base, length, depth, limit), "spans")
    copied = base.groupBy("uid").agg(F.count(F.lit(1)).alias("_n"), F.max(F.octet_length("text")).alias("_b")).filter(
        (F.col("_n") > 1) & (F.col("_b") >= length)
    )
    whole = keep(copied.select("uid"), "copied")
    n_bytes = F.octet_length("text").cast("long")
    none = F.lit(0).cast("long")
    gone = base.join(small(whole), "uid", "left_semi").select(
        "doc_id", n_bytes.alias("n_bytes"), n_bytes.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept")
    )
    rest = base.join(small(whole), "uid", "left_anti")
    named = small(spans.select("uid"))
    kept = rest.join(named, "uid", "left_anti").select(
        "doc_id", n_bytes.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("text").cast("binary").alias("kept")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sizes, removed, runs, left = [], [], [], []
            for text, ranges in zip(column(part, "text").to_pylist(), column(part, "spans").to_pylist()):
                raw = text.encode()
                steps = np.zeros(len(raw) + 1, np.int64)
                for r in ranges:
                    steps[r["first"]] += 1
                    steps[r["last"]] -= 1
                out = np.cumsum(steps[:-1]) > 0
                sizes.append(len(raw))
                removed.append(int(out.sum()))
                runs.append(int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()))
                left.append(np.frombuffer(raw, np.uint8)[~out].tobytes())
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(left, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = (
        rest.join(named, "uid", "left_semi").join(spans, "uid").select("doc_id", "text", "spans")
        .mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    )
    return gone.union(kept).union(cut).withColumn("kept_sha256", F.sha2("kept", 256))
