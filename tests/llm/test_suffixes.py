import hashlib
import random

import pytest

from corpuslens.llm import suffixes
from corpuslens.llm.suffixes import common, dedup_suffixes, deep_shallow
from tests.llm.conftest import filler


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1
    out = []
    for (d, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(table, length, depth):
    found = dedup_suffixes(table, length, depth).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=repr)


def cases():
    rng = random.Random(6)
    passage = " ".join(filler(1, 90))
    rows = [(i, " ".join(filler(10 + i, 20)) + passage[i % 7 * 9 : 420 + i * 5] + " ".join(filler(40 + i, 9))) for i in range(14)]
    for i in range(12):  # near copies
        words = filler(99, 120)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(120)] = f"edit{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(words)))
    rows += [(200 + i, "".join(rng.choice("ab") for _ in range(rng.randint(1, 60)))) for i in range(25)]
    rows += [(300, "a" * 900), (301, "ab" * 300), (302, "x" * 399), (303, "x" * 400), (304, "y" * 401), (305, "é" * 300), (306, None), (307, ""), (308, passage * 3)]
    rows += [(None, passage[:450]), (400, rows[0][1]), (400, rows[0][1]), (400, "q" * 30), (401, "short copy"), (402, "short copy"), (None, None)]
    return rows


@pytest.mark.parametrize("length, depth", [(400, 32), (12, 4), (9, 8)])
def test_brute_force(docs, length, depth):
    assert result(docs(cases()), length, depth) == brute(cases(), length)


@pytest.mark.parametrize("length, depth, limit", [(400, 32, 3), (12, 4, 5), (9, 8, 2)])
def test_hot_heads_meet_in_no_task(docs, monkeypatch, length, depth, limit):
    alike, ordinary = suffixes.repeated_ranges, suffixes._split

    def ranges(lefts, rights, *more):
        if len(more[2]) > limit:
            raise MemoryError(f"{len(more[2])} anchors of one head in one task")
        return alike(lefts, rights, *more)

    used = []
    monkeypatch.setattr(suffixes, "repeated_ranges", ranges)
    monkeypatch.setattr(suffixes, "_split", lambda *args: used.append(1) or ordinary(*args))
    found = dedup_suffixes(docs(cases()), length, depth, limit).collect()
    assert used and sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=repr) == brute(cases(), length)


def test_texts_of_one_hash_are_told_apart(docs):
    from pyspark.sql import functions as F

    found = dedup_suffixes(docs(cases()), 400, 32, hashed=F.pmod(F.length("text"), F.lit(3)).cast("long")).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=repr) == brute(cases(), 400)


def test_sorting_is_sorting():
    rng = random.Random(2)
    for _ in range(60):
        strings = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 40))]
        groups = deep_shallow(strings, rng.choice([1, 3, 4, 5, 8]))
        order = [i for g, _ in groups for i in g]
        assert [strings[i] for i in order] == sorted(strings)
        for members, shared in groups:
            for a, b, n in zip(members, members[1:], shared[1:]):
                assert n == common(strings[a], strings[b])


def test_empty_table_and_bad_depth(spark):
    assert dedup_suffixes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        dedup_suffixes(spark.createDataFrame([], "doc_id long, text string"), 10, 10)


def rounds():
    """Texts that go round, some shorter than it takes to repeat LENGTH bytes, whole or inside other words."""
    ring = "".join(f"Anlyou{i % 3} " for i in range(200))
    texts = ["Ti " * 700, ("Ti " * 700)[1:402], "i Ti T" + "Ti " * 140 + "other words", "nded " * 81, "nded " * 80, ring[3:], ring[:405] + "end", ring[24:424]]
    texts += [" ".join(filler(600 + i, 30)) + "Ti " * (130 + i) + " ".join(filler(700 + i, 9)) for i in range(8)]
    return [(i, text) for i, text in enumerate(texts)]


def test_texts_that_go_round(docs):
    assert result(docs(rounds()), 400, 32) == brute(rounds(), 400)
    assert result(docs(rounds()), 12, 4) == brute(rounds(), 12)


def test_a_text_that_goes_round_has_few_anchors(docs):
    base = suffixes.text_ids(docs([(1, "Ti " * 3000 + "end")]))
    assert suffixes._anchors(base, 400, 32).count() < 60


def test_short_passages_bring_no_bytes_together(docs, monkeypatch):
    passages = [" ".join(filler(5 + i, 30))[:190] for i in range(9)]
    rows = [(i, "".join(" ".join(filler(1000 * i + k, 30)) + p for k, p in enumerate(passages))) for i in range(20)]
    alike, sent = suffixes._contexts, []
    monkeypatch.setattr(suffixes, "_contexts", lambda *args: sent.append(alike(*args)) or sent[-1])
    assert result(docs(rows), 400, 32) == brute(rows, 400)
    assert sum(table.count() for table in sent) <= 20  # at most the first and last row of each task of the sort


@pytest.mark.parametrize("length, depth, limit", [(400, 32, 4096), (12, 4, 20)])
def test_equal_contexts_in_several_tasks(docs, spark, length, depth, limit):
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "11"}
    before = {name: spark.conf.get(name) for name in changed}
    rows = cases() + [(500 + i, t) for i, t in rounds()]
    for name, value in changed.items():
        spark.conf.set(name, value)
    try:
        found = dedup_suffixes(docs(rows), length, depth, limit).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=repr) == brute(rows, length)
