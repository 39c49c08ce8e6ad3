import hashlib
import random
import re

import pytest

from corpuslens.llm.spotsigs import ANCHORS, CHAIN, fingerprints, near_duplicates


def spots(text):
    words = re.findall(r"[^\W_]+", text.lower())
    found = set()
    for i, w in enumerate(words):
        if w in ANCHORS:
            chain = [x for x in words[i + 1 :] if x not in ANCHORS][:CHAIN]
            if len(chain) == CHAIN:
                found.add((w, *chain))
    return found or ({tuple(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def texts(seed=4, n=60):
    rng = random.Random(seed)
    make = lambda k: " ".join(rng.choice([*ANCHORS[:12], *("w%d" % rng.randrange(60) for _ in range(20))]) for _ in range(k))
    return [make(rng.choice([1, 3, 12, 40, 90])) for _ in range(n)]


ROWS = [*enumerate(texts()), (100, None), (101, ""), (102, "!!!"), (103, "The"), (104, "É über die Straße und 9 Wörter mehr"), (105, "x" * 50_000), (-5, "the a b c d"), (7, "of p q r s t"), (None, "of p q r s")]


def check(rows, found):
    order = sorted(((d is None, -(d or 0)), t or "", d) for d, t in rows)
    # rows of one doc_id may stand in either order; give those no check
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    for i, (_, text, d) in enumerate(order):
        after = order[(i + 1) % len(order)]
        if sum(o[2] == d for o in order) > 1 or sum(o[2] == after[2] for o in order) > 1:
            continue
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[1][:cut]
        (r,) = by[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest()), d
        assert r.near_edited == pytest.approx(jaccard(spots(text), spots(edited))), (d, text, edited)
        assert r.near_next == pytest.approx(jaccard(spots(text), spots(after[1])))
        assert len(r.fingerprint.split("-")) == max(1, len(spots(text)))


def table(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, fingerprint string, n_chars int").repartition(4)


def test_brute_force(spark):
    check(ROWS, fingerprints(table(spark, ROWS)).collect())


def test_equal_texts_and_repeated_rows(spark):
    rows = [(1, "the a b c d e"), (2, "the a b c d e"), (3, "of x y z"), (3, "of x y z"), (3, "of x y z"), (4, "")]
    found = fingerprints(table(spark, rows)).collect()
    assert len(found) == 6
    assert len({r.fingerprint for r in found if r.doc_id in (1, 2)}) == 1
    three = sorted(r.near_next for r in found if r.doc_id == 3)
    assert three == [0.0, 1.0, 1.0]  # two are followed by their own copy, the last by document 2
    assert {r.near_next for r in found if r.doc_id == 2} == {1.0}


def test_single_and_none(spark):
    (only,) = fingerprints(table(spark, [(5, "the a b c d e f g h")])).collect()
    assert only.near_next == 1.0
    assert fingerprints(table(spark, [])).collect() == []


def test_near_duplicates(spark):
    rng = random.Random(9)
    base = [t for t in texts(11, 30) if len(t) > 60]
    rows = list(enumerate(base)) + [(100 + i, None) for i in range(2)]
    for k in range(60):
        words = rng.choice(base).split()
        words[rng.randrange(len(words))] = "edit%d" % k
        rows.append((200 + k, " ".join(words)))
    rows += [(300, base[0]), (300, base[0])]
    classes = {}
    for d, t in rows:
        if spots(t or ""):
            classes[frozenset(spots(t or ""))] = min(d, classes.get(frozenset(spots(t or "")), d))
    expected = {tuple(sorted((a, b))) for x, a in classes.items() for y, b in classes.items() if a < b and jaccard(x, y) >= 0.8}
    found = near_duplicates(table(spark, rows)).collect()
    assert {(r.a, r.b) for r in found} == expected and len(found) == len(expected) > 20
