"""Mixing sources to target weights by a low-discrepancy schedule (operator 7).

Slot t of the schedule is a point of the golden-ratio sequence; the cumulative target shares map it to a
source, so every stretch of slots holds each source close to its share. The slots of a source are ranked,
and rank r takes block r of the source's words, shuffled by a keyed hash and cut into blocks that differ by
one word at most; past the last block the next pass begins. A source ends with the word that meets its
target, inside a block if need be: slots beyond it are left out, and sources that were dealt too few get
the rest after the last slot.

Everything is DataFrame work. Positions in a source are sums over (source, hash bucket) first and over
one bucket then, ranks of slots come from a range partition: no source meets in one task.

Cases: NULL and empty texts have size 0 and are never taken; NULL is a source of its own, the last one;
equal rows share their hash and follow each other; without any word all targets are 0. Reruns agree, as
nothing depends on the order of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.llm.shared import WORD, keep, row_key, rows_with, text_of
from corpuslens.operators.skew import rank_in_group

WEIGHTS = (1, 2, 3)
REPEATS = 3
#: Words of a block: at most BLOCK_WORDS, and so few that there are SLOTS of them at least.
BLOCK_WORDS, SLOTS = 512, 1 << 17
SEED = 7
BUCKETS = 4096
CELLS = 1024

_GOLDEN = (math.sqrt(5) - 1) / 2
_FAR = (65536 * _GOLDEN) % 1.0


def n_words(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``source, source_size, weight, target`` of every source, in code point order with NULL last.

    Targets share all words by weight; one that would pass ``repeats`` times its source stops there, and
    what it leaves is shared again among the others, until none stops anew.
    """
    held = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_last", F.col("source").isNull())
    ranked = rank_in_group(held, [], ["_last", "source"], "_rank")
    table = keep(
        ranked.select(
            "source", "source_size", "_rank",
            F.array(*map(F.lit, weights))[(F.col("_rank") % len(weights)).cast("int")].alias("weight"),
        ),
        "sources",
    )
    cap = F.col("source_size") * repeats
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, stopped = 0.0, -1
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        row = table.agg(
            F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
        ).first()
        if row[0] == stopped or not row[2]:
            break
        stopped, level = row[0], (total - row[1]) / row[2]
    return table.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def block_length(total: int) -> int:
    return max(1, min(BLOCK_WORDS, total // SLOTS))


def _blocks(length: int) -> tuple[Column, Column, Column]:
    """Of a source: how many blocks, words of a short one, and how many blocks (the first) have one word more."""
    blocks = F.ceil(F.col("source_size") / length)
    short = F.floor(F.col("source_size") / blocks)
    return blocks, short, F.col("source_size") - short * blocks


def block_start(block: Column, length: int) -> Column:
    _, short, longer = _blocks(length)
    return block * short + F.least(block, longer)


def block_at(word: Column, length: int) -> Column:
    """The block that holds the word at a place of the source."""
    _, short, longer = _blocks(length)
    head = longer * (short + 1)
    return F.when(word < head, F.floor(word / (short + 1))).otherwise(longer + F.floor((word - head) / short))


def schedule(targets: DataFrame, length: int) -> DataFrame:
    """``slot, source_rank, rank, pass, block, upto``: which block of which source each slot takes, and the
    place in the source where what it takes ends."""
    spark = targets.sparkSession
    blocks = _blocks(length)[0]
    words = F.round("target").cast("long")
    rest = words % F.col("source_size")
    shares = targets.filter("target > 0").select(
        "_rank", "source_size", (F.col("target") * blocks / F.col("source_size")).alias("_share"), words.alias("_words"),
        (F.floor(words / F.col("source_size")) * blocks + F.when(rest > 0, block_at(rest - 1, length) + 1).otherwise(0)).alias("_slots"),
    )
    total = shares.agg(F.coalesce(F.sum("_share"), F.lit(0.0))).first()[0]
    slots = math.ceil(total)
    ordered = Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)  # one small row per source
    upto = F.sum("_share").over(ordered) / F.lit(total or 1.0)
    last = F.lead("_rank").over(Window.orderBy("_rank")).isNull()
    spans = shares.withColumn("_hi", F.when(last, F.lit(2.0)).otherwise(upto)).withColumn(
        "_lo", F.coalesce(F.lag("_hi").over(Window.orderBy("_rank")), F.lit(0.0))
    )
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1)).cast("int")
    spans = spans.withColumn("_cell", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))))
    far, near = F.floor(F.col("slot") / 65536), F.col("slot") % 65536
    point = (far * F.lit(_FAR)) % 1.0 + (near * F.lit(_GOLDEN)) % 1.0 + 0.5
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("_u", point % 1.0).withColumn("_cell", cell(F.col("_u")))
    dealt = points.join(spans, "_cell").filter("_lo <= _u AND _u < _hi").select(
        "slot", F.col("_rank").alias("source_rank"), "source_size", "_words", "_slots"
    )
    ranked = rank_in_group(dealt, ["source_rank"], ["slot"], "rank")
    held = ranked.groupBy("source_rank").agg(F.count(F.lit(1)).alias("_held"))
    short = shares.join(held, F.col("_rank") == F.col("source_rank"), "left").withColumn("_held", F.coalesce("_held", F.lit(0))).filter("_held < _slots")
    before = F.coalesce(F.sum(F.col("_slots") - F.col("_held")).over(Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    added = short.withColumn("_before", before).withColumn("rank", F.explode(F.sequence("_held", F.col("_slots") - 1)))
    columns = ["slot", "source_rank", "source_size", "_words", "_slots", "rank"]
    added = added.withColumn("slot", F.col("_before") + F.col("rank") - F.col("_held") + slots).withColumn("source_rank", F.col("_rank"))
    whole = ranked.filter("rank < _slots").select(columns).union(added.select(columns))
    passed, block = F.floor(F.col("rank") / blocks), F.col("rank") % blocks
    upto = F.least(block_start(block + 1, length), F.col("_words") - passed * F.col("source_size"))
    return whole.select("slot", "source_rank", "rank", passed.alias("pass"), block.alias("block"), upto.alias("upto"))


def place(sizes: DataFrame, seed: int = SEED) -> DataFrame:
    """``sizes`` with ``start``: words of the source's other documents that come before, in shuffled order."""
    spread = sizes.withColumn("_bucket", F.pmod("_hash", F.lit(BUCKETS)))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_at"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        spread.groupBy("source", "_bucket").agg(F.sum("size").alias("_held"))
        .withColumn("_before", F.coalesce(F.sum("_held").over(earlier), F.lit(0)))
        .select(F.col("source").alias("_source"), F.col("_bucket").alias("_at"), "_before")
    )
    inner = Window.partitionBy("source", "_bucket").orderBy("_hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return (
        spread.join(heads, same)
        .withColumn("start", F.col("_before") + F.sum("size").over(inner) - F.col("size"))
        .drop("_source", "_at", "_before", "_bucket")
    )


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, row_key, size, source_size, target, takes, taken`` for every row; ``takes[p]`` are the words
    that pass p takes from the start of the document."""
    sizes = keep(
        docs.select(
            "doc_id", "source", n_words().alias("size"), row_key(text_of()).alias("row_key"),
            F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "text").alias("_hash"),
        ),
        "sizes",
    )
    targets = source_targets(sizes)
    total = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    length = block_length(total)
    ranks = targets.select(F.col("source").alias("_source"), F.col("_rank").alias("source_rank"), "source_size", "target")
    placed = keep(
        place(sizes, seed).join(ranks, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "placed"
    )
    slots = schedule(targets, length).select("source_rank", "block", "pass", "upto")
    cut = placed.filter("size > 0").select(
        "doc_id", "source_rank", "start", "size",
        "source_size", F.explode(F.sequence(block_at(F.col("start"), length), block_at(F.col("start") + F.col("size") - 1, length))).alias("block"),
    ).withColumn("_from", F.greatest("start", block_start(F.col("block"), length)))
    inside = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), F.col("upto")) - F.col("_from"))
    took = cut.join(slots, ["source_rank", "block"]).groupBy("source_rank", "start", "size").agg(
        *(F.coalesce(F.sum(F.when(F.col("pass") == p, inside)), F.lit(0)).alias(f"_p{p}") for p in range(REPEATS))
    )
    # a document of some size is named by where it starts in its source
    mixed = placed.join(took, ["source_rank", "start", "size"], "left")
    takes = F.array(*(F.coalesce(f"_p{p}", F.lit(0)).cast("long") for p in range(REPEATS)))
    return mixed.withColumn("takes", takes).select(
        "doc_id", "row_key", "size", "source_size", "target", "takes",
        F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x).alias("taken"),
    )


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each pass that takes words of a document. A
    document of which a pass takes a part only has its first words there, joined by one space."""
    takes = mix(docs, seed).filter("taken > 0").groupBy("doc_id", F.col("row_key").alias("__cl_key")).agg(
        F.count(F.lit(1)).alias("__cl_rows"), F.flatten(F.collect_list("takes")).alias("__cl_takes"), F.first("size").alias("__cl_size")
    )
    rows = rows_with(docs.withColumn("__cl_key", row_key(text_of())), keep(takes, "takes"))
    passes = rows.withColumn("__cl_take", F.explode(F.filter("__cl_takes", lambda n: n > 0)))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), F.lit(1), F.col("__cl_take").cast("int")), " ")
    text = F.when(F.col("__cl_take") < F.col("__cl_size"), part).otherwise(F.col("text"))
    return passes.withColumn("text", text).select(docs.columns)
