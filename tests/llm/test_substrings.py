import hashlib
import random

from corpuslens.llm.substrings import dedup_substrings, repeated_starts
from tests.llm.conftest import filler


def brute(rows, length):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - length + 1):
            if d is not None:
                k = tuple(w[i : i + length])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i : i + length])] < d:
                gone.update(range(i, i + length))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(table, length):
    found = dedup_substrings(table, length).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    return sorted((tuple(r) for r in found), key=repr)


def cases():
    rng = random.Random(3)
    passage = filler(1, 70)
    rows = [(i, " ".join(filler(100 + i, 30) + passage[i % 5 :] + filler(200 + i, 20))) for i in range(12)]
    rows += [(20 + i, " ".join(rng.choice("ab") for _ in range(200))) for i in range(6)]
    rows += [(30, "a " * 300), (31, "a\tb\n" * 100), (32, "a b " * 80), (33, " ".join(passage[:49])), (34, " ".join(passage[:50]))]
    rows += [(40, None), (41, ""), (42, " \n\t"), (None, " ".join(passage)), (43, "é x " * 60), (44, "é x " * 61)]
    rows += [(50, " ".join(filler(9, 80))), (50, " ".join(filler(9, 80))), (50, " ".join(passage)), (51, " ".join(filler(9, 80)))]
    return rows


def test_brute_force(docs):
    rows = cases()
    for length in (10, 50):
        assert result(docs(rows), length) == brute(rows, length)


def test_hot_windows_take_the_other_way_to_the_same_end(docs):
    rows = cases()
    calm = repeated_starts(docs(rows), 10).collect()
    hot = repeated_starts(docs(rows), 10, hot=1).collect()
    flat = lambda found: sorted((r.doc_id, r.row_key, s["start"] + b) for r in found for s in r.starts for b in range(64) if s["mask"] >> b & 1)
    assert flat(calm) == flat(hot)


def test_empty_table(docs, spark):
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).collect() == []
