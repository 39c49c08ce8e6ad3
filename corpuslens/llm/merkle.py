"""A Merkle manifest of a table, with a proof and its check for every row (operator 11).

A leaf is the hash of a row's fields. The leaves of a group (a language) stand in key order; while more
than one node remains, every two neighbours become their hash (a last one alone becomes the hash of
itself). What remains is the group's subroot; subroots, in order of the group (NULL first), give the root
in the same way.

Cogrouped subtree exchange: ``2^LEVELS`` neighbours form a superblock. Going up, each superblock sends on
nothing but its top node, until one node is left. Coming down, a superblock's own nodes are cogrouped with
the outer nodes its proofs need, which is one short row, and one ``applyInPandas`` call reduces the
superblock again, joins the inner and the outer part of each proof and folds the (perhaps changed) leaf
along it. A group of any size so lies in tasks of at most ``2^LEVELS`` leaves; texts are read once and
never shuffled; a table of N rows needs ``log N / LEVELS`` rounds.

Cases: a NULL field is hashed as ``-``, which no value can equal. NULL keys come first; rows of one key are
ordered by their leaf, and equal rows are interchangeable, each with a proof of its own. An empty table has no
root and gives no rows. A very long text is hashed where it is read. Columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.llm.shared import keep, small
from corpuslens.operators.skew import rank_in_group

#: A superblock holds 2^LEVELS neighbours, some 1 MB.
LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODES = "group string, pos long, n long, digest string"
_OUTER = "group string, pos long, path array<string>, subroot string, root string"


def field(value: Column) -> Column:
    """Length and value as text, so that no two lists of fields are written alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def above(left: str, right: str = "") -> str:
    return sha256((left + right).encode()).hexdigest()


def layers(nodes: list[str], n: int, levels: int) -> list[list[str]]:
    """A superblock from its nodes to its top: ``levels`` steps, or as many as all ``n`` nodes of the group take."""
    found = [nodes]
    for _ in range(min(levels, max(n - 1, 0).bit_length())):
        nodes = [above(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        found.append(nodes)
    return found


def path_of(held: list[list[str]], at: int) -> list[str]:
    """What the node at ``at`` meets on its way up: a sibling on the left or right, or none (``-``)."""
    path = []
    for nodes in held[:-1]:
        other = at ^ 1
        path.append("-" if other >= len(nodes) else ("R" if other > at else "L") + nodes[other])
        at >>= 1
    return path


def fold(node: str, path: Sequence[str]) -> str:
    for step in path:
        node = above(node) if step == "-" else above(node, step[1:]) if step[0] == "R" else above(step[1:], node)
    return node


def proof_of(path: Sequence[str]) -> str:
    return above("".join(step[1:] for step in path if step != "-"))


def _block(levels: int) -> Column:
    return F.shiftright("pos", levels)


def _tops(nodes: DataFrame, levels: int) -> DataFrame:
    """The top node of every superblock, as nodes of the next round."""

    def reduce(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        n, first = int(block["n"].iloc[0]), int(block["pos"].iloc[0])
        top = layers(block["digest"].tolist(), n, levels)[-1][0]
        return pd.DataFrame({"group": [block["group"].iloc[0]], "pos": [first >> levels], "n": [-(-n >> levels)], "digest": [top]})

    return nodes.select("group", "pos", "n", "digest").groupBy("group", _block(levels)).applyInPandas(reduce, _NODES)


def _rounds(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """``nodes`` and the tops of each round, up to the one with a single node a group."""
    found = [nodes]
    while (found[-1].agg(F.max("n")).first()[0] or 0) > 1:
        found.append(keep(_tops(found[-1], levels), "tops"))
    return found


def _down(nodes: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """The outer part of every node's proof, from that of its superblock."""

    def join(block: pd.DataFrame, above_it: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        held = layers(block["digest"].tolist(), int(block["n"].iloc[0]), levels)
        row = above_it.iloc[0]
        return pd.DataFrame(
            {
                "group": block["group"].tolist(), "pos": block["pos"].tolist(),
                "path": [[*path_of(held, i), *row["path"]] for i in range(len(block))],
                "subroot": row["subroot"], "root": row["root"],
            }
        )

    left = nodes.select("group", "pos", "n", "digest").groupBy("group", _block(levels).alias("block"))
    return left.cogroup(outer.groupBy("group", F.col("pos").alias("block"))).applyInPandas(join, _OUTER)


def _proofs(leaves: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """Local reduction, joined proofs and their folding, superblock by superblock."""

    def finish(block: pd.DataFrame, above_it: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        digests, row = block["digest"].tolist(), above_it.iloc[0]
        held, outside = layers(digests, int(block["n"].iloc[0]), levels), list(row["path"])
        paths = [[*path_of(held, i), *outside] for i in range(len(digests))]
        return pd.DataFrame(
            {
                "key": block["key"].tolist(), "leaf": digests, "subroot": row["subroot"], "root": row["root"],
                "proof_sha256": [proof_of(p) for p in paths],
                "folded_root": [fold(changed or leaf, p) for leaf, changed, p in zip(digests, block["changed"], paths)],
            }
        )

    left = leaves.groupBy("group", _block(levels).alias("block"))
    return left.cogroup(outer.groupBy("group", F.col("pos").alias("block"))).applyInPandas(
        finish, "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    )


def manifest(
    table: DataFrame,
    fields: Sequence[str] = FIELDS,
    group: str = "lang",
    key: str = "doc_id",
    changed: dict[str, Column] | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row.

    ``changed`` gives other values of some fields: the leaf of these is what is folded along the proof of the
    original, and ``verified`` tells whether it still leads to the root. ``key`` is one of the integer types.
    """
    own = leaf_of([F.col(f) for f in fields])
    other = leaf_of([(changed or {}).get(f, F.col(f)) for f in fields])
    leaves = keep(
        table.select(
            F.col(key).alias("key"),
            # NULL first, then bytewise
            F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("group"),
            own.alias("digest"), other.alias("_other"),
        )
        .withColumn("changed", F.when(F.col("_other") != F.col("digest"), F.col("_other")))
        .drop("_other")
        # equal rows have no order of their own: dealt out by where they were read
        .withColumn("tie", F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id())),
        "leaves",
    )
    sizes = leaves.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    placed = (
        rank_in_group(leaves, ["group"], ["key", "digest", "tie"], "pos")
        .join(small(sizes), "group")
        .select(F.col("key").cast("string").alias("key"), "group", "pos", "n", "digest", "changed")
    )
    placed = keep(placed, "placed")

    inner = _rounds(placed, levels)
    subroots = inner[-1].select("group", F.col("digest").alias("subroot"))
    count = subroots.count()
    tops = keep(
        rank_in_group(subroots.withColumn("all", F.lit("")), ["all"], ["group"], "pos").select(
            F.col("all").alias("group"), "pos", F.lit(count).cast("long").alias("n"), F.col("subroot").alias("digest"), F.col("group").alias("of")
        ),
        "subroots",
    )
    upper = _rounds(tops, levels)

    none = F.array().cast("array<string>")
    outer = upper[-1].select("group", "pos", none.alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(upper[:-1]):
        outer = _down(nodes, outer, levels)
    outer = outer.select(F.col("pos").alias("_pos"), "path", "root").join(tops, F.col("_pos") == F.col("pos"))
    outer = outer.select(F.col("of").alias("group"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")
    for nodes in reversed(inner[1:-1]):
        outer = _down(nodes, outer, levels)
    found = _proofs(placed, outer, levels)
    kind = table.schema[key].dataType
    return found.select(
        F.col("key").cast(kind).alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
