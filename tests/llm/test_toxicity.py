import random
import zlib

import numpy as np
import pyarrow as pa

from corpuslens.llm.toxicity import Ftrl, features, sigmoid, toxicity


def make(spark, n=1200):
    rng = random.Random(5)
    bad = ["grubber", "snivel", "mugwump"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad).capitalize() + rng.choice(",.!"))
        docs.append((i, " ".join(words), "x"))
        if i % 2:
            labels.append((i, 0, int(toxic)))
    docs += [(n, None, "x"), (n + 1, "", "x"), (None, "Snivel!", "x"), (7, docs[7][1], "x")]
    labels += [(3, 1, None), (None, 1, 1), (n + 50, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_and_holds_out(spark):
    docs, labels = make(spark)
    found = toxicity(docs, labels).collect()
    assert len(found) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and sum(r.predicted != truth[r.doc_id] for r in held) <= 2
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert {r.predicted for r in found if r.doc_id is None} == {1}
    assert sorted(map(repr, toxicity(docs.repartition(5), labels).collect())) == sorted(map(repr, found))


def test_held_out_labels_teach_nothing(spark):
    docs, labels = make(spark)
    flipped = labels.selectExpr("doc_id", "quality", "IF(crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2, 1 - toxic, toxic) AS toxic")
    assert sorted(map(repr, toxicity(docs, labels).collect())) == sorted(map(repr, toxicity(docs, flipped).collect()))


def test_no_labels_and_no_documents(spark):
    docs, labels = make(spark, 20)
    assert {r.score for r in toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity(docs.limit(0), labels).collect() == []


def test_features_by_hand():
    rows, places = features(pa.array(["a b c", "B, c!", None, "", "a b c"]), 20)
    per = [sorted(places[rows == i]) for i in range(5)]
    assert [len(p) for p in per] == [6, 3, 0, 0, 6] and per[0] == per[4] and set(per[1]) < set(per[0])


def test_ftrl_against_one_coordinate_at_a_time():
    model, z, n = Ftrl(4, 0.5, 1.0, 0.1, 1.0), np.zeros(4), np.zeros(4)
    weight = lambda i: 0.0 if abs(z[i]) <= 0.1 else -(z[i] - np.sign(z[i]) * 0.1) / ((1 + n[i] ** 0.5) / 0.5 + 1.0)
    for at, y in (([0, 1], 1.0), ([1, 2], 0.0), ([0, 3], 1.0), ([0, 1, 2, 3], 0.0)) * 5:
        model.learn(np.array(at), y)
        g = sigmoid(sum(weight(i) for i in at)) - y
        for i in at:
            w = weight(i)
            s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5
            z[i] += g - s * w
            n[i] += g * g
    assert np.allclose(model.weights(), [weight(i) for i in range(4)])
