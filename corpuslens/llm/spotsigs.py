"""SpotSigs document fingerprints (operator 10).

A spot is a common word (an anchor) with the chain of the next ``CHAIN`` content words behind it; a
document's fingerprint is the set of its spots' hashes, written as one string. Sets are partitioned by
length: two sets can reach a Jaccard similarity t only if the shorter is at least t times the longer, so
only equal or neighbouring partitions are compared, and in them only sets that share one of their rarest
spots. DataFrame functions only.

Cases: NULL counts as empty; a text without a whole spot has one signature, the hash of its words (none
if it has no word); two empty sets are alike (1), an empty and another are not (0). A single document is
followed by itself. Rows of equal doc_id follow each other in an order fixed by their texts; NULL doc_id
comes last; repeated rows each stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.llm.shared import keep, text_of
from corpuslens.operators.skew import rank_in_group

CHAIN = 3
SIMILAR = 0.8
#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was were with which "
    "aber als auf aus bei das dem den der des die ein eine er es im ist mit nicht sich sie und von zu "
    "au aux ce dans elle est et il la le les mais ne par pas pour que qui sur un une "
    "al con del el ella en las lo los más no para pero por se sin su como"
).split()

_TOKEN = r"[\p{L}\p{N}]+"
_MIN = -(1 << 63)


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the sorted set of the spots of column ``text``, an array of ints."""
    held = df.withColumn("_w", F.regexp_extract_all(F.lower(F.col(text)), F.lit(_TOKEN), 0))
    anchor = lambda i: F.get("_w", i).isin(*ANCHORS)
    at = F.when(F.size("_w") > 0, F.sequence(F.lit(0), F.size("_w") - 1)).otherwise(F.array().cast("array<int>"))
    held = held.withColumn("_stop", F.filter(at, anchor)).withColumn("_content", F.filter("_w", lambda w: ~w.isin(*ANCHORS)))
    # the k-th anchor stands behind k others, so behind i - k content words
    chain = lambda i, k: [F.get("_content", i - k + step) for step in range(CHAIN)]
    spots = F.transform(
        F.filter("_stop", lambda i, k: i - k + CHAIN <= F.size("_content")),
        lambda i, k: F.hash(F.get("_w", i), *chain(i, k)),
    )
    held = held.withColumn("_spots", F.sort_array(F.array_distinct(spots)))
    whole = F.when(F.size("_w") > 0, F.array(F.hash(F.array_join("_w", " ")))).otherwise(F.array().cast("array<int>"))
    return held.withColumn(out, F.when(F.size("_spots") > 0, F.col("_spots")).otherwise(whole)).drop(
        "_w", "_stop", "_content", "_spots"
    )


def as_string(signatures: str) -> Column:
    return F.array_join(F.transform(signatures, lambda x: F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))))), "-")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two sets of signatures; sets of which one is empty need no comparison."""
    shared = F.size(F.array_intersect(a, b))
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return F.when(large == 0, F.lit(1.0)).when(small == 0, F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def band(length: Column, similar: float = SIMILAR) -> Column:
    """The partition of a set by its length; sets further apart than one band cannot be similar."""
    return F.floor(F.log(F.greatest(length, F.lit(1)).cast("double")) / F.lit(-math.log(similar)) + F.lit(1e-9)).cast("int")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``a, b, likeness``: pairs of different fingerprints with likeness of at least ``similar``, each named
    by the smallest doc_id that has it. Documents of one fingerprint are of one class and stay so.

    A set of n signatures posts its ``n - ceil(similar * n) + 1`` rarest ones, under its own band and the
    next: pairs that share none of these cannot be similar. Sets whose lengths forbid it are never paired.
    """
    named = with_signatures(docs.filter("doc_id IS NOT NULL").select("doc_id", text_of().alias("_text")), "_text", "_sig")
    sets = keep(named.filter(F.size("_sig") > 0).groupBy("_sig").agg(F.min("doc_id").alias("id")), "sets")
    use = sets.select(F.explode("_sig").alias("_s")).groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    posts = sets.select("id", F.size("_sig").alias("n"), F.explode("_sig").alias("_s")).join(use, "_s")
    rare = F.transform(F.sort_array(F.collect_list(F.struct("_n", "_s"))), lambda x: x["_s"])
    ranked = posts.groupBy("id", "n").agg(rare.alias("_rare"))
    prefix = F.slice("_rare", F.lit(1), F.col("n") - F.ceil(F.lit(similar) * F.col("n") - F.lit(1e-9)).cast("int") + 1)
    index = keep(ranked.select("id", "n", band(F.col("n"), similar).alias("band"), F.explode(prefix).alias("_s")), "index")
    left = index.select(F.col("id").alias("a"), F.col("n").alias("na"), "band", "_s").withColumn(
        "band", F.explode(F.array("band", F.col("band") + 1))
    )
    right = index.select(F.col("id").alias("b"), F.col("n").alias("nb"), "band", "_s")
    fits = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = left.join(right, ["band", "_s"]).filter(fits & (F.col("na") >= F.lit(similar) * F.col("nb") - 1e-9)).select("a", "b").distinct()
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("_sig").alias("_x")), "a")
    both = one.join(sets.select(F.col("id").alias("b"), F.col("_sig").alias("_y")), "b")
    found = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness("_x", "_y").alias("likeness"))
    return found.filter(F.col("likeness") >= similar)


def successors(docs: DataFrame) -> DataFrame:
    """``_id, _key, n_chars, _turn, _copies, _next_id, _next_key``: each different row and the one that follows
    in descending doc_id; the last is followed by the first. Of repeated rows all but the last are followed
    by themselves (``_turn`` 1). Holds no text."""
    rows = docs.groupBy("_id", "_key", "n_chars").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_down", F.bitwise_not("_id"))
    ranked = keep(rank_in_group(rows, [], ["_down", "_key"], "_rank").drop("_down"), "ranks")
    total = max(ranked.count(), 1)
    after = ranked.select(
        F.col("_id").alias("_next_id"), F.col("_key").alias("_next_key"),
        F.pmod(F.col("_rank") - 1, F.lit(total).cast("long")).alias("_rank"),
    )
    names = ["_id", "_key", "n_chars", "_turn", "_copies", "_next_id", "_next_key"]
    last = ranked.join(after, "_rank").select("*", F.lit(0).alias("_turn"), F.lit(1).cast("long").alias("_copies")).select(names)
    others = ranked.filter("_rows > 1").select(
        "_id", "_key", "n_chars", F.lit(1).alias("_turn"), (F.col("_rows") - 1).alias("_copies"),
        F.col("_id").alias("_next_id"), F.col("_key").alias("_next_key"),
    )
    return last.union(others)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    The text is shuffled once; the following row sends only its beginning and its signatures.
    """
    texts = docs.select("doc_id", text_of().alias("text")).select(
        "doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_MIN)).alias("_id"), F.xxhash64("text").alias("_key")
    )
    links = keep(successors(texts.withColumn("n_chars", F.length("text").cast("long")).drop("text")), "links")
    if links.filter("_turn = 1").limit(1).count():
        texts = texts.dropDuplicates(["_id", "_key"])
    signed = with_signatures(texts, "text", "_sig").select("_id", "_key", "text", "_sig").repartition("_id", "_key")
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    sent = signed.join(
        links.select(F.col("_next_id").alias("_id"), F.col("_next_key").alias("_key"), F.col("_id").alias("_to"), F.col("_key").alias("_to_key"), "n_chars", "_turn"),
        ["_id", "_key"],
    ).select(
        F.col("_turn").alias("_sent_turn"), F.col("_to").alias("_id"), F.col("_to_key").alias("_key"), F.col("_sig").alias("_next_sig"), F.left("text", cut).alias("_head")
    )
    # turns are compared aside from the keys, so that the text stays where the first join has put it
    own = signed.join(links.drop("_next_id", "_next_key"), ["_id", "_key"]).join(sent, ["_id", "_key"]).filter("_turn - _sent_turn = 0")
    edited = own.withColumn("_edited", F.concat(F.left("text", F.col("n_chars").cast("int") - cut), "_head")).drop("text", "_head", "_sent_turn")
    signed_again = with_signatures(edited, "_edited", "_edited_sig")
    out = signed_again.select(
        F.when(F.col("_id") != _MIN, F.col("_id")).alias("doc_id"), "n_chars", "_copies",
        F.sha2("_edited", 256).alias("edited_sha256"), as_string("_sig").alias("fingerprint"),
        as_string("_edited_sig").alias("edited_fingerprint"), likeness("_sig", "_edited_sig").alias("near_edited"),
        likeness("_sig", "_next_sig").alias("near_next"),
    )
    return out.withColumn("_copies", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).drop("_copies")
