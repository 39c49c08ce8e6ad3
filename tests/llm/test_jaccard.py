import random

import numpy as np
import pytest

from corpuslens.llm import jaccard
from corpuslens.llm.components import components
from corpuslens.llm.jaccard import jaccard_components
from tests.llm.conftest import filler


def shingle_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) > 4 else frozenset([tuple(words)] if words else [])


def brute(rows):
    rows = list(rows)
    sets = [shingle_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and None not in (rows[i][0], rows[j][0]) and 100 * len(a & b) >= 80 * len(a | b):
                top[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((repr(d), len(sets[i]), repr(least.get(root(i)))) for i, (d, _) in enumerate(rows))


def result(table):
    return sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in jaccard_components(table).collect())


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


def cases():
    rng = random.Random(8)
    passage = filler(7, 40)
    rows = []
    for f in range(6):  # families around the threshold, of several sizes
        words = filler(50 + f, rng.choice([12, 40, 120, 300]))
        rows += [(len(rows) + k, edited(rng, words, rng.choice([0, 1, 2, 3, 5]))) for k in range(14)]
    rows += [(200 + k, " ".join(filler(300 + k, 8) + passage)) for k in range(20)]
    rows += [(230 + k, " ".join(passage[: 30 + k])) for k in range(10)]
    rows += [(300, "a b c d"), (301, "A B\tc\nd"), (302, "a b c"), (303, ""), (304, None), (305, " \n"), (306, ""), (307, "x " * 400), (308, "x " * 50), (309, "É a b c d e"), (310, "é a b c d e")]
    rows += [(None, rows[0][1]), (320, rows[5][1]), (320, rows[5][1]), (5, rows[30][1])]
    rng.shuffle(rows)
    return rows


def test_brute_force(docs):
    rows = cases()
    assert result(docs(rows)) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_chains(docs, seed):
    rng = random.Random(seed)
    rows, words = [], filler(seed, 60)
    for k in range(120):  # each a few words away from one before
        rows.append((rng.randrange(10_000), " ".join(words)))
        words = edited(rng, rng.choice(rows)[1].split(), rng.choice([1, 1, 2])).split()
    rows = list({d: (d, t) for d, t in rows}.values())
    assert result(docs(rows)) == brute(rows)


def test_order_of_shingles_changes_nothing(docs, monkeypatch):
    rows = cases()
    monkeypatch.setattr(jaccard, "corpus_levels", lambda texts: np.random.default_rng(1).integers(0, 8, 1 << jaccard.PLACES).astype(np.uint8))
    assert result(docs(rows)) == brute(rows)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(500, i) for i in range(501, 560)]
    rng.shuffle(edges)
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    table = spark.createDataFrame(edges, "a long, b long")
    for at_once in (1000, 60, 7):
        found = {r.node: r.root for r in components(table, at_once).collect()}
        assert found == {x: root(x) for x in top if root(x) != x}
    assert components(table.limit(0)).collect() == []


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
