import random

import pytest
from pyspark.sql import functions as F

from corpuslens.llm import mixing
from corpuslens.llm.mixing import mix, schedule, source_targets


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, start string, block int").repartition(3)


def rows_of(sizes, seed=1):
    rng, rows, i = random.Random(seed), [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join("w" for _ in range(rng.randint(1, 60))), source, "x", 1))
            i += 1
    return rows


def water(sizes, total, weights):
    target, open_, left = {}, dict(sizes), total
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if 3 * sizes[s] < level * weights[s]]
        if not full:
            return target | {s: level * weights[s] for s in open_}
        for s in full:
            target[s] = 3 * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_targets_and_what_is_taken(spark):
    rows = rows_of({"a": 3, "b": 60, "ä": 200, "z": 5, None: 7}) + [(900, None, "a", "x", 1), (901, "", None, "x", 1), (902, " ", "q", "x", 1)]
    rows += [rows[5]] * 3
    found = mix(table(spark, rows)).collect()
    assert len(found) == len(rows)
    size, taken, target = {}, {}, {}
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], r[2])
    for r in found:
        s = by_id[r.doc_id]
        size[s] = size.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r.size and sum(r.takes) == r.taken and all(t <= r.size for t in r.takes)
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    expected = water(size, sum(size.values()), {s: i % 3 + 1 for i, s in enumerate(order)})
    for s in order:
        assert target[s] == pytest.approx(expected[s])
        assert abs(taken[s] - target[s]) <= max(3, 0.01 * target[s]), s
    again = mix(table(spark, rows[::-1])).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))


def test_schedule_holds_shares_in_every_stretch(spark):
    sizes = table(spark, rows_of({"a": 300, "b": 300, "c": 300})).select("doc_id", "source", F.size(F.split("text", " ")).cast("long").alias("size"))
    slots = sorted(schedule(source_targets(sizes), 4).collect(), key=lambda r: r.slot)
    for lo in range(0, len(slots) - 600, 600):
        part = [r.source_rank for r in slots[lo : lo + 600]]
        assert [abs(part.count(k) / 600 - (k + 1) / 6) < 0.02 for k in range(3)] == [True] * 3
    assert sorted(r.rank for r in slots if r.source_rank == 2) == list(range(sum(r.source_rank == 2 for r in slots)))


def test_small_sources_meet_their_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "block_length", lambda total: 512)
    rows = rows_of({"a": 4, "b": 10, "c": 20, "d": 35, "e": 60, "f": 63, "g": 12})
    found = mix(table(spark, rows)).collect()
    by_id = {r[0]: r[2] for r in rows}
    for s in "abcdefg":
        mine = [r for r in found if by_id[r.doc_id] == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.5, s
    assert all(t <= r.size for r in found for t in r.takes)


def test_empty_tables(spark):
    assert mix(table(spark, [])).collect() == []
    found = mix(table(spark, [(1, None, None, "x", 1), (1, "", "a", "x", 1)])).collect()
    assert sorted((r.size, r.target, r.taken) for r in found) == [(0, 0.0, 0)] * 2
