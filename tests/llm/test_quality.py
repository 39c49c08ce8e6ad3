import math
import random

import pytest
from pyspark.sql import functions as F

from corpuslens.llm.quality import FOLDS, LEAST_PLACES, QUANTILE, SMOOTHING, STEP, fold, judge, places, with_words
from tests.llm.conftest import filler

WHITE = b" \t\n\x0b\f\r"


def base(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed)


def tables(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        words = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 80))]
        if i % 6 == 0:
            words = [w + rng.choice("#$%") for w in words]
        if i % 7 == 0:
            words = words[:9] * 4 + words
        rows.append((i, " ".join(w + rng.choice(["", "", "\n", "\t"]) for w in words)))
    rows += [(60, None), (61, ""), (62, " \n"), (63, "x " * 500), (64, "é ü😀 " * 30), (65, "a\n\na\n \na b\r\nc"), (66, " ".join(filler(1, 3000)))]
    rows += [(0, rows[0][1]), (None, "a b c"), (67, " ".join(filler(2, 8) + filler(3, 22) + filler(2, 8))), (68, "  a b " * 12)]
    docs = spark.createDataFrame([(*r, 7, "q") for r in rows], "doc_id long, text string, n_words int, score string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(0, 60, 2)] + [(3, None, 1), (None, 1, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_base_measures(spark):
    rows, docs, labels = tables(spark)
    found = judge(docs, labels).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(repr((r.doc_id, *(r[c] for c in columns))) for r in found) == sorted(repr((d, *base(t))) for d, t in rows)
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id is not None}
    steps = sorted(math.floor(r.score / STEP) for r in found if r.doc_id in good and not r.base_failed)
    least = round(steps[math.floor(QUANTILE * len(steps))] * STEP, 9)
    assert all(r.kept == (not r.base_failed and r.score >= least) for r in found)
    assert {r.kept for r in found if not r.base_failed} == {True, False}
    assert all(r.kept == (not r.base_failed and r.score >= 0.25) for r in judge(docs, labels, 0.25).collect())


def test_scores_by_hand(spark):
    rows, docs, labels = tables(spark)
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id is not None}
    hashed = with_words(docs.select("doc_id", "text")).select("doc_id", fold().alias("f"), F.concat("_h1", "_h2").alias("h")).collect()
    size = places(docs)
    assert size >= LEAST_PLACES
    everything, target = {}, [{} for _ in range(FOLDS)]
    for r in hashed:
        for h in r.h:
            p = h % size
            everything[p] = everything.get(p, 0) + 1
            for f in range(FOLDS):
                target[f][p] = target[f].get(p, 0) + (r.doc_id in good and r.f != f)
    n, m = sum(everything.values()), [sum(t.values()) for t in target]
    assert all(m)

    def weight(f, p):
        return math.log((target[f][p] / m[f] + SMOOTHING * everything[p] / n) / (1 + SMOOTHING) / (everything[p] / n))

    expected = sorted((repr(r.doc_id), round(sum(weight(r.f, h % size) for h in r.h) / len(r.h), 6) if r.h else 0.0) for r in hashed)
    found = sorted((repr(r.doc_id), round(r.score, 6)) for r in judge(docs, labels).collect())
    for a, b in zip(found, expected, strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=2e-6)


def test_places_grow_with_the_corpus(spark):
    text = F.lit("x" * 100_000)
    held = lambda n: places(spark.range(n).select(text.alias("text")))
    assert held(0) == LEAST_PLACES
    assert [held(n) for n in (100, 400, 1600)] == [1 << 14, 1 << 15, 1 << 16]


def test_a_text_is_not_measured_by_itself(spark):
    """Of two trusted texts in one fold neither is in the target of its fold: all score 0."""
    texts = [" ".join(filler(i, 40)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    mine = [r.doc_id for r in with_words(docs).filter(fold() == 0).collect()]
    labels = spark.createDataFrame([(i, 1) for i in mine], "doc_id long, quality int")
    score = {r.doc_id: r.score for r in judge(docs, labels).collect()}
    assert {score[i] for i in mine} == {0.0} and all(score[i] < 0 for i in score if i not in mine)


def test_without_labels_or_documents(spark):
    _, docs, labels = tables(spark)
    assert {r.score for r in judge(docs, labels.limit(0)).collect()} == {0.0}
    assert judge(docs.limit(0), labels).collect() == []
