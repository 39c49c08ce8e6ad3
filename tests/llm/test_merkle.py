import random
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from corpuslens.llm.merkle import leaf_of, manifest

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def climb(levels, at):
    for nodes in levels[:-1]:
        other = at ^ 1
        yield (nodes[other] if other < len(nodes) else None), other < at
        at >>= 1


def brute(rows, tampered):
    """What every row gets, one by one."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    order = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    trees = {g: tree([leaf(r) for r in sorted(groups[g], key=order)]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    for g in names:
        for at, row in enumerate(sorted(groups[g], key=order)):
            path = [*climb(trees[g], at), *climb(top, names.index(g))]
            node = leaf(tampered(row))
            for other, left in path:
                node = h(node) if other is None else h(other, node) if left else h(node, other)
            yield (row[0], leaf(row), trees[g][-1][0], top[-1][0], h(*(o for o, _ in path if o)), node, node == top[-1][0])


def tamper(row):
    hit = row[0] is not None and row[3] is not None and crc32(str(row[0]).encode()) % 7 == 0
    return (*row[:3], row[3] + 1, row[4]) if hit else row


def check(spark, rows, levels, parts=3):
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], COLUMNS + ", pos string, n long, `group` string").repartition(parts)
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    found = manifest(table, changed=more, levels=levels)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: (r[0] is not None, r)
    flat = lambda rows: sorted(([str(v) for v in r] for r in rows))
    assert flat(found.collect()) == flat(brute(rows, tamper))


def some(n, seed=1):
    draw = random.Random(seed)
    langs = [None, "", "de", "é", "zz", "-"]
    return [(i * 3 - n, draw.choice(["a", None, ""]), draw.choice(langs[: 1 + seed % 6]), draw.choice([None, i, 10**12]), draw.choice([f"t{i}", "ä☃", None, ""])) for i in range(n)]


@pytest.mark.parametrize("n, levels, seed", [(1, 2, 0), (2, 1, 0), (23, 1, 5), (64, 2, 0), (65, 2, 0), (90, 3, 3), (40, 12, 5)])
def test_every_row_as_by_hand(spark, n, levels, seed):
    check(spark, some(n, seed), levels)


def test_a_hot_group_and_many_single_ones(spark):
    rows = some(70, 0) + [(1000 + i, "s", f"lang{i}", 1, "x") for i in range(19)]
    check(spark, rows, 2)


def test_repeated_rows_null_keys_and_long_texts(spark):
    rows = [(7, "s", "en", 1, "a")] * 9 + [(7, "s", "en", 2, "a"), (None, "s", "en", 2, "a"), (None, "s", None, 2, "b"), (None, "s", None, 2, "b")]
    check(spark, rows + [(8, "s", "en", 3, "word " * 400_000)], 2)


def test_empty_table(spark):
    assert manifest(spark.createDataFrame([], COLUMNS)).collect() == []


def test_fields_are_told_apart(spark):
    row = spark.createDataFrame([("1:a", None, "", "-")], "a string, b string, c string, d string")
    hashed = lambda *names: row.select(leaf_of([F.col(n) for n in names])).first()[0]
    assert len({hashed("b"), hashed("c"), hashed("d"), hashed("b", "c"), hashed("c", "b")}) == 5


def test_other_fields_group_and_key(spark):
    table = spark.createDataFrame([(1, "x", 5), (2, "y", 5), (3, "z", 6)], "k int, v string, g int")
    found = manifest(table, fields=("v",), group="g", key="k", levels=1)
    assert found.schema["k"].dataType.simpleString() == "int" and all(r["verified"] for r in found.collect())
