"""N-gram Jaccard join by grouped prefixes (operator 1).

A document's set holds its distinct shingles of ``SHINGLE`` words. All sets share one order of shingles:
those that the corpus holds often come last, so the first ``n - ceil(0.8 n) + 1`` of a set of n (its
prefix) are rare ones, and two sets of Jaccard similarity 0.8 or more share a shingle of their prefixes.

1. Shingles of all documents are counted in a table of fixed size; its logarithms give the order.
2. Documents of one set are one class; classes of one prefix and size are one group. Groups post their
   prefix; shingles that one group alone posts, or groups of too different sizes, are dropped.
3. The groups that share a shingle are expanded into their classes: a bucket. In a bucket pairs are
   filtered by size and by parity bitmaps, as wide as the set is large, whose difference is never more
   than that of the sets. Each class not yet reached becomes a pivot and is paired with all that pass (never all pairs).
4. Pairs are verified on the whole sets; links give components. Buckets that still hold several
   components give every pair across components that passes the filters, which is verified in turn; a
   pair that a bucket of a smaller shingle gives, as far as the ``FIRST`` smallest ones of each class
   tell, is not given again. So each link is either verified or joins two documents already connected:
   components are exact.

Shingles are compared by 59-bit hashes. Hot shingles are last in order, and a bucket in memory takes one
bitmap a class.

Cases: NULL and empty texts have an empty set and link with nothing; fewer than ``SHINGLE`` words give
one shingle, the whole sequence; rows with NULL doc_id are in a component of their own (NULL);
repeated rows link with each other like any two equal texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuslens.llm.batches import LOWER, WORD_SLICE, Rolling, Words, column, mix, slices
from corpuslens.llm.components import components
from corpuslens.llm.shared import keep, row_key, rows_with, small, text_of

SHINGLE = 5
#: Similar: 100 * |intersection| >= PERCENT * |union|.
PERCENT = 80
#: The table of counts has 2 ** PLACES places, sent in parts of 2 ** PART.
PLACES, PART = 22, 12
#: Shingles that a class names to the others of its buckets.
FIRST = 8


def shingles(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes of each text (repeats included) and where each text's begin."""
    words = Words(texts, LOWER)
    count = np.where(words.count >= width, words.count - width + 1, np.minimum(words.count, 1))
    first = np.append(0, np.cumsum(count))
    row = np.repeat(np.arange(len(count)), count)
    start = np.arange(first[-1]) - first[row] + words.first[row]
    end = np.minimum(start + width, words.first[row + 1])
    return Rolling(words.hashes).hash(start, end), first


def _place(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - PLACES)).astype(np.int64)


def ranked_sets(texts: pa.Array, levels: np.ndarray) -> list[np.ndarray]:
    """The distinct shingles of each text in the common order: a value is its level and its hash."""
    hashes, first = shingles(texts)
    values = levels[_place(hashes)].astype(np.uint64) << np.uint64(59) | hashes >> np.uint64(5)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        held = np.sort(values[a:b])
        out.append(held[np.append(True, held[1:] != held[:-1])] if b > a else held)
    return out


def corpus_levels(docs: DataFrame) -> np.ndarray:
    """For every place of the table the logarithm (base 2) of how many shingles of the corpus fall on it."""
    parts = 1 << (PLACES - PART)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << PLACES, np.uint32)  # a task reads far fewer shingles than would overflow it
        for part in slices(batches, limit=WORD_SLICE):
            places, times = np.unique(_place(shingles(column(part, "text"))[0]), return_counts=True)
            table[places] += times.astype(np.uint32)
        rows = table.reshape(parts, -1)
        for a in range(0, parts, 64):
            held = [row.astype("<u4").tobytes() for row in rows[a : a + 64]]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(held), dtype=np.int32)), pa.array(held, pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(*(c.to_pylist() for c in batch.columns)):
                more = np.frombuffer(counts, "<u4").astype(np.int64)
                sums[part] = sums[part] + more if part in sums else more
        levels = [np.log2(np.maximum(s, 1)).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["part", "levels"])

    counted = docs.select("text").mapInArrow(count, "part int, counts binary").repartition("part")
    levels = np.zeros((parts, 1 << PART), np.uint8)
    for row in counted.mapInArrow(add, "part int, levels binary").collect():  # 2 ** PLACES bytes in all
        levels[row.part] = np.frombuffer(bytes(row.levels), np.uint8)
    return np.minimum(levels.ravel(), 31)


def _prefix(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def _identity(held: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    h = mix(held + np.uint64(1))
    total = np.array([h.sum(), np.bitwise_xor.reduce(h), len(h)], np.uint64)
    return int(mix(mix(mix(total[:1]) + total[1:2]) + total[2:])[0])


def parity(held: np.ndarray) -> bytes:
    """For each of ``width`` places whether an odd number of the set's hashes falls on it. Halving the width
    is to put one half over the other (exclusive or), so sets of different widths compare."""
    width = max(512, 1 << int(np.ceil(np.log2(max(1.5 * len(held), 1)))))
    odd = np.bincount((mix(held) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _sets(docs: DataFrame, levels) -> DataFrame:
    """``doc_id, row_key, n, cls, grp, bits`` per document: size, class, group and parity bitmap of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=WORD_SLICE):
            sets = ranked_sets(column(part, "text"), levels.value)
            n = np.array(list(map(len, sets)), np.int64)
            cls = np.array([_identity(s) if len(s) else 0 for s in sets], np.uint64)
            grp = np.array([_identity(np.append(s[: _prefix(len(s))], np.uint64(len(s)))) if len(s) else 0 for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    column(part, "doc_id"), column(part, "row_key"), pa.array(n), pa.array(cls.view(np.int64)), pa.array(grp.view(np.int64)),
                    pa.array(list(map(parity, sets)), pa.binary()),
                ],
                ["doc_id", "row_key", "n", "cls", "grp", "bits"],
            )

    return docs.mapInArrow(run, "doc_id long, row_key long, n long, cls long, grp long, bits binary")


def _postings(docs: DataFrame, levels) -> DataFrame:
    """``token, sizes, grp``: the prefix of every group.

    ``sizes`` is the group's size and, in its lower half, the largest size of a set that can link with it if
    this is the first shingle they share: the further back it stands, the less may follow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=WORD_SLICE):
            held = [s for s in ranked_sets(column(part, "text"), levels.value) if len(s)]
            heads = [s[: _prefix(len(s))] for s in held]
            grp = [_identity(np.append(h, np.uint64(len(s)))) for h, s in zip(heads, held)]
            once = {g: (h, len(s)) for g, h, s in zip(grp, heads, held)}  # equal groups of one slice post once
            if once:
                sizes = np.array([len(h) for h, _ in once.values()])
                n = np.repeat(np.array([n for _, n in once.values()], np.int64), sizes)
                at = np.arange(len(n)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                most = (100 + PERCENT) * (n - at) // PERCENT - n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([h for h, _ in once.values()]).view(np.int64)),
                        pa.array(n << 32 | np.maximum(most, 0)),
                        pa.array(np.repeat(np.array(list(once), np.uint64), sizes).view(np.int64)),
                    ],
                    ["token", "sizes", "grp"],
                )

    return docs.select("text").mapInArrow(run, "token long, sizes long, grp long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``token, grp`` of the different rows, sorted by ``token, sizes, grp``, that may have a partner: of two
    rows of a token both must allow the other's size, of more one next to it must fit by size."""
    names = ("token", "sizes", "grp")
    held = [np.zeros(0, np.int64) for _ in names]
    before, near = 0, False  # rows of the first held token that are gone, and whether the last of them fits the next

    def out(rows: list[np.ndarray], stop: int) -> pa.RecordBatch:
        """Decides over the rows up to ``stop``; those behind it are seen only."""
        token, sizes, grp = rows
        n, most = sizes >> 32, sizes & 0xFFFFFFFF
        new = np.append(True, token[1:] != token[:-1])
        run = np.cumsum(new) - 1
        length = np.bincount(run)
        if len(length):
            length[0] += before
        pair = ~new[1:] & (100 * n[:-1] >= PERCENT * n[1:])
        two = length[run[1:]] == 2
        pair &= ~two | (n[1:] <= most[:-1]) & (n[:-1] <= most[1:])
        fits = np.append(near, pair) | np.append(pair, False)
        take = np.flatnonzero(fits[:stop])
        out.state = (int((run[:stop] == run[stop]).sum()) + (before if stop < len(run) and run[stop] == 0 else 0), bool(pair[stop - 1])) if 0 < stop < len(run) else (0, False)
        return pa.RecordBatch.from_arrays([pa.array(token[take]), pa.array(grp[take])], ["token", "grp"])

    for batch in batches:
        rows = [np.append(h, column(batch, c).to_numpy()) for h, c in zip(held, names)]
        same = np.ones(max(len(rows[0]) - 1, 0), bool)
        for r in rows:
            same &= r[1:] == r[:-1]
        rows = [r[np.append(True, ~same)[: len(r)]] for r in rows]
        if len(rows[0]) > 3:
            yield out(rows, len(rows[0]) - 3)  # three rows tell whether a token has more than two
            before, near = out.state
            held = [r[-3:] for r in rows]
        else:
            held = rows
    if len(held[0]):
        yield out(held, len(held[0]))


class Bucket:
    """Classes that share a shingle, by size."""

    def __init__(self, cls: np.ndarray, n: np.ndarray, bits: list[bytes], root: list[int] | None = None, first: list[list[int]] | None = None):
        order = np.lexsort((cls, n))
        self.cls, self.n = cls[order], n[order]
        if root is not None:
            self.root = np.array(root, np.int64)[order]
            self.first = np.full((len(order), FIRST), np.iinfo(np.int64).max)
            for row, i in zip(self.first, order):
                row[: len(first[i])] = first[i]
        maps = [bits[i] for i in order]
        size = np.array(list(map(len, maps)))
        self.widths = np.unique(size)
        self.at = {w: np.flatnonzero(size == w) for w in self.widths.tolist()}
        self.maps = {w: np.frombuffer(b"".join(maps[i] for i in at), np.uint64).reshape(len(at), -1) for w, at in self.at.items()}
        self.size = size
        self.row = np.zeros(len(maps), np.int64)
        for at in self.at.values():
            self.row[at] = np.arange(len(at))

    def passing(self, i: int) -> np.ndarray:
        """Marks the classes that may link with class i."""
        lo = int(np.searchsorted(self.n, -(-PERCENT * self.n[i] // 100)))
        hi = int(np.searchsorted(self.n, 100 * self.n[i] // PERCENT, side="right"))
        fits = np.zeros(len(self.n), bool)
        mine = self.maps[int(self.size[i])][self.row[i]]
        for w, at in self.at.items():
            a, b = np.searchsorted(at, (lo, hi))
            if a == b:
                continue
            theirs, one = self.maps[w][a:b], mine
            while theirs.shape[1] > len(one):
                half = theirs.shape[1] // 2
                theirs = theirs[:, :half] ^ theirs[:, half:]
            while len(one) > theirs.shape[1]:
                one = one[: len(one) // 2] ^ one[len(one) // 2 :]
            differ = np.bitwise_count(theirs ^ one).sum(axis=1, dtype=np.int64)
            fits[at[a:b]] = (100 + PERCENT) * differ <= (100 - PERCENT) * (self.n[at[a:b]] + self.n[i])
        fits[i] = False
        return fits


def _buckets(batches: Iterator[pa.RecordBatch], rooted: bool = False) -> Iterator[tuple[int, Bucket]]:
    """Buckets of two classes or more from rows sorted by token. With ``root``, only those of several roots."""
    held: list[tuple] = []

    def bucket() -> Bucket | None:
        if len(held) < 2 or rooted and len({r[4] for r in held}) < 2:
            return None
        more = ([r[4] for r in held], [r[5] for r in held]) if rooted else ()
        return Bucket(np.array([r[1] for r in held], np.int64), np.array([r[2] for r in held], np.int64), [r[3] for r in held], *more)

    names = ["token", "cls", "n", "bits"] + ["root", "first"] * rooted
    for batch in batches:
        for row in zip(*(column(batch, c).to_pylist() for c in names)):
            if held and row[0] != held[0][0]:
                if found := bucket():
                    yield held[0][0], found
                held = []
            held.append(row)
    if held and (found := bucket()):
        yield held[0][0], found


def _pivot_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``kind, x, y``: pairs of a pivot and a class (kind 0), and the members of buckets in which more pairs
    than these pass the filters (kind 1: token and class)."""
    for rows in _batched(_pivot_rows(batches)):
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1]), pa.array(rows[2])], ["kind", "x", "y"])


def _pivot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for token, bucket in _buckets(batches):
        m = len(bucket.cls)
        covered, involved = np.zeros(m, bool), np.zeros(m, bool)
        given = 0
        for i in range(m):
            if covered[i]:
                continue
            fits = bucket.passing(i)
            covered |= fits
            found = np.flatnonzero(fits)
            if len(found):
                involved |= fits
                involved[i] = True
                given += len(found)
                yield np.zeros(len(found), np.int32), np.full(len(found), bucket.cls[i]), bucket.cls[found]
        if given and involved.sum() > 2:
            rest = bucket.cls[involved]
            yield np.ones(len(rest), np.int32), np.full(len(rest), token), rest


def _batched(rows: Iterator[tuple], limit: int = 1 << 16) -> Iterator[tuple[np.ndarray, ...]]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[0])
        if size >= limit:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _cross_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``x, y``: pairs of different components that pass the filters."""

    def rows() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for token, bucket in _buckets(batches, rooted=True):
            for i in range(len(bucket.cls) - 1):
                fits = bucket.passing(i) & (bucket.root != bucket.root[i])
                fits[: i + 1] = False
                found = np.flatnonzero(fits)
                if len(found):
                    smaller = bucket.first[i][bucket.first[i] < token]
                    found = found[~np.isin(bucket.first[found], smaller).any(axis=1)]
                if len(found):
                    yield np.full(len(found), bucket.cls[i]), bucket.cls[found]

    for x, y in _batched(rows()):
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])


def _whole_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, levels) -> DataFrame:
    """``cls, held``: the whole set, as bytes, of each wanted class, from the one document that stands for it."""
    ids = classes.join(wanted, "cls").select("rep", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=WORD_SLICE):
            sets = ranked_sets(column(part, "text"), levels.value)
            right = [i for i, (s, c) in enumerate(zip(sets, column(part, "cls").to_pylist())) if len(s) and np.uint64(_identity(s)).view(np.int64) == c]
            yield pa.RecordBatch.from_arrays(
                [column(part, "cls").take(pa.array(right, pa.int64())), pa.array([sets[i].tobytes() for i in right], pa.binary())], ["cls", "held"]
            )

    texts = docs.join(small(ids), docs["doc_id"] == ids["rep"]).select("cls", "text")
    return texts.mapInArrow(run, "cls long, held binary").dropDuplicates(["cls"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b`` of the pairs ``x, y`` whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for i, (p, q) in enumerate(zip(column(batch, "p"), column(batch, "q"))):
                one, two = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                if len(one) > len(two):
                    one, two = two, one
                common = int((two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one).sum())
                if 100 * common >= PERCENT * (len(one) + len(two) - common):
                    linked.append(i)
            take = pa.array(linked, pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, "x").take(take), column(batch, "y").take(take)], ["a", "b"])

    one = pairs.join(sets.select(F.col("cls").alias("y"), F.col("held").alias("q")), "y")
    both = one.join(sets.select(F.col("cls").alias("x"), F.col("held").alias("p")), "x")
    return both.select("x", "y", "p", "q").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_copies, row_key, root`` for every row; ``n_copies`` are the other
    rows of the same set, ``row_key`` is ``xxhash64`` of the text, ``root`` names the component also where
    rows of one doc_id are in several."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("row_key", row_key("text"))
    levels = spark.sparkContext.broadcast(corpus_levels(texts))
    members = keep(_sets(texts, levels), "sets")
    named = texts.filter("doc_id IS NOT NULL")
    classes = keep(
        members.filter("n > 0 AND doc_id IS NOT NULL").groupBy("cls").agg(
            F.min("grp").alias("grp"), F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("doc_id").alias("rep"),
            F.count(F.lit(1)).alias("_rows"),
        ),
        "classes",
    )
    about = classes.select("grp", "cls", "n", "bits")
    posted = _postings(named, levels).repartition("token").sortWithinPartitions("token", "sizes", "grp").mapInArrow(_shared, "token long, grp long")
    crowded = classes.groupBy("grp").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select(F.col("grp").alias("token"), "grp")
    expanded = posted.union(crowded).join(about, "grp").drop("grp")
    found = keep(
        expanded.repartition("token").sortWithinPartitions("token", "n", "cls").mapInArrow(_pivot_pairs, "kind int, x long, y long"),
        "pivots",
    )
    pairs = keep(found.filter("kind = 0").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "pairs")
    wanted = pairs.select(F.col("x").alias("cls")).union(pairs.select(F.col("y").alias("cls"))).distinct()
    sets = keep(_whole_sets(named, classes.select("cls", "rep"), wanted, levels), "held")
    links = keep(_verified(pairs, sets), "links")
    roots = components(links)
    rest = found.filter("kind = 1").select(F.col("x").alias("token"), F.col("y").alias("cls"))
    first = rest.groupBy("cls").agg(F.slice(F.sort_array(F.collect_list("token")), 1, FIRST).alias("first"))
    labelled = rest.join(about.drop("grp").join(first, "cls"), "cls").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "root", F.coalesce("root", "cls")
    )
    across = labelled.repartition("token").sortWithinPartitions("token", "n", "cls").mapInArrow(_cross_pairs, "x long, y long")
    across = across.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct().join(pairs, ["x", "y"], "left_anti")
    more = keep(_verified(keep(across, "across"), sets), "more")
    roots = components(links.union(more)) if more.limit(1).count() else roots
    rooted = classes.select("cls", "rep", "_rows").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "root", F.coalesce("root", "cls")
    )
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = rooted.join(least, "root").select("cls", "root", "component_id", (F.col("_rows") - 1).alias("n_copies"))
    linked = members.filter("n > 0 AND doc_id IS NOT NULL").join(labels, "cls")
    alone = members.filter("n = 0 OR doc_id IS NULL")
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_copies", "row_key", "root").union(
        alone.select("doc_id", "n", "doc_id", F.lit(0).cast("long"), "row_key", F.lit(None).cast("long"))
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every component: that of the smallest doc_id (of several, the least hash).

    Documents without words, and those without doc_id, link with nothing and all stay; a repeated row
    stays once.
    """
    found = keep(jaccard_components(docs), "components")
    first = F.min(F.struct("doc_id", "row_key")).alias("_first")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    stay = found.filter(~alone).groupBy("root").agg(first).select("_first.*").withColumn("_stays", F.lit(True))
    rows = found.groupBy("doc_id", "row_key").agg(F.count(F.lit(1)).alias("__cl_rows"), F.first(alone).alias("_alone"))
    table = rows.join(stay, ["doc_id", "row_key"], "left").filter("_alone OR _stays").select("doc_id", F.col("row_key").alias("__cl_key"), "__cl_rows")
    return rows_with(docs.withColumn("__cl_key", row_key(text_of())), table).select(docs.columns)
