import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpus_pipeline import STAGES, run
from corpuslens.llm.pieces import encode
from corpuslens.llm.tokens import read_model
from corpuslens.llm.toxicity import score
from tests.llm.conftest import filler
from tests.llm.test_jaccard import shingle_set
from tests.llm.test_substrings import brute

BAD = ["grubber", "snivel", "mugwump"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, start int"


def corpus():
    rng, rows, labels = random.Random(12), [], []
    for i in range(300):
        words = filler(1000 + i, rng.randint(20, 120))
        toxic = i % 5 == 0
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append([i, " ".join(words), f"s{i % 4}"])
        labels.append((i, 1, int(toxic)))
    passage = " ".join(filler(5, 70))
    for i in range(300, 310):  # a passage in otherwise different texts
        rows.append([i, f"{' '.join(filler(2000 + i, 60))} {passage} {' '.join(filler(3000 + i, 60))}", f"s{i % 4}"])
    for i in range(310, 330):  # near copies
        words = filler(9, 200)
        words[rng.randrange(200)] = f"edit{i}"
        rows.append([i, " ".join(words), "s1"])
    rows += [[330, None, "s1"], [331, "", "s0"], [332, " \n", None], [333, "short", None], [None, "no id at all", "s2"], [334, passage, "s3"]]
    rows += [rows[1], rows[1], [335, rows[2][1], "s2"], [2, "other text of one id", "s2"], [336, "tab\tand\n\nlines " * 3, "s2"]]
    return [(d, t, "en", s, len(t) if t is not None else None, "x", 1) for d, t, s in rows], labels


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/out{k}")
        docs = spark.read.parquet(f"{folder}/out{k}")
        out.append(docs)
    return folder, rows, [[tuple(r) for r in d.collect()] for d in out], out


def texts(rows):
    return sorted(repr(r[:2]) for r in rows)


def test_columns_stay(stages, spark):
    for docs in stages[3][:-1]:
        assert docs.schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()


def test_toxic_documents_go(stages):
    _, rows, out, _ = stages
    clean = [r for r in rows if not any(w in (r[1] or "") for w in BAD)]
    assert texts(out[0]) == texts(clean)


def test_one_of_each_group_stays(stages):
    _, _, out, _ = stages
    sets = [(r, shingle_set(r[1])) for r in out[0]]
    kept = []
    for r, s in sorted(sets, key=lambda x: (x[0][0] is None, x[0][0] or 0, x[0][1] or "")):
        if not s or r[0] is None or not any(100 * len(s & t) >= 80 * len(s | t) for _, t in kept if t):
            kept.append((r, s))
    # families of this fixture are all within reach of their first document
    assert texts(out[1]) == texts([r for r, _ in kept])


def test_repeated_passages_go(stages):
    _, _, out, _ = stages
    expected = brute([r[:2] for r in out[1]], 50)
    gone = {(d, n): k for d, n, k, _ in expected}
    lost = sorted(repr(d) for d, n, k, _ in expected if k and k == n)
    assert len(out[2]) == len(out[1]) - len(lost) and lost == ["334"]
    before = {(r[0], r[1]): r for r in out[1]}
    for r in out[2]:
        if (r[0], r[1]) in before:
            assert before[r[0], r[1]] == r
        else:
            assert r[4] == len(r[1]) and any(k for (d, _), k in gone.items() if d == r[0])


def test_mix(stages):
    _, _, out, _ = stages
    size = lambda t: len((t or "").split())
    have, took = {}, {}
    for r in out[2]:
        have[r[3]] = have.get(r[3], 0) + size(r[1])
    for r in out[3]:
        took[r[3]] = took.get(r[3], 0) + size(r[1])
    names = sorted(s for s in have if s is not None) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, open_, target = sum(have.values()), set(names), {}
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = [s for s in open_ if 3 * have[s] <= level * weight[s]]
        if not full:
            break
        target.update({s: 3 * have[s] for s in full})
        open_ -= set(full)
    target.update({s: level * weight[s] for s in open_})
    assert all(abs(took.get(s, 0) - target[s]) <= max(3, 0.01 * target[s]) for s in names)
    whole = {r[1] for r in out[2]}
    cut = [r for r in out[3] if r[1] not in whole]
    assert all(any(" ".join((t or "").split()).startswith(r[1]) for t in whole) for r in cut) and len(cut) <= 3 * len(names)


def test_pieces(stages):
    _, _, out, _ = stages
    assert len(out[4]) == len(out[3]) and all(r[-1] and r[2] == len(r[3]) for r in out[4])


def test_run_is_the_stages(stages, spark):
    folder, _, out, _ = stages
    assert sorted(map(repr, run(spark, folder).collect())) == sorted(repr(r) for r in stages[3][-1].collect())
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_tables(stages, spark, tmp_path):
    folder = stages[0]
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in STAGES:
        assert stage(spark, empty, folder).collect() == []


def test_texts_go_to_tasks_once(spark):
    """Python gets a text that goes along once, takes NULL for empty and leaves it NULL."""
    model = read_model(public_tokenizers.path(corpus_pipeline.PIECES))
    rows = [(1, "the of and"), (2, None), (3, ""), (4, " Snivel é▁ \n")]
    strings = spark.createDataFrame(rows, "doc_id long, text string")
    binary = strings.withColumn("text", F.col("text").cast("binary"))
    found = []
    for docs, copies in ((strings, 0), (binary, 1)):
        scored = score(docs, np.array([5, 1 << 20]), np.array([0.5, -0.5]), docs.columns)
        encoded = encode(docs, model, docs.columns, decoded=True)
        for made in (scored, encoded):
            assert made.schema["text"] == docs.schema["text"]
            assert made._jdf.queryExecution().analyzed().toString().count(" AS __cl_text") == copies
        found.append([sorted((r[0], *r[2:]) for r in made.collect()) for made in (scored, encoded)])
        assert sorted((r.doc_id, r.text) for r in encoded.collect()) == sorted((r.doc_id, r.text) for r in docs.collect())
    assert found[0] == found[1]
    assert [r[2] for r in found[0][1]] == [t or "" for _, t in rows] and found[0][1][1][1] == []
