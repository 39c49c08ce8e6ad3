import random

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import chunks

PY = "\n".join(["", "a", "b", "c", "", "d", "e", "f", "g", "", "h", "i", "j"])


def spans(df, *more):
    rows = df.orderBy("rel_path", "chunk_no").collect()
    return [tuple(r[c] for c in ("chunk_no", "start_line", "end_line", *more)) for r in rows]


def test_sample_file(files):
    got = chunks.chunk_significant(files([("s.py", PY)]), 5)
    assert spans(got, "reported_end_line", "n_sig", "eof") == [
        (0, 1, 7, 6, 5, False), (1, 7, 12, 11, 5, False), (2, 12, 13, 12, 2, True),
    ]


def test_plain_empty_and_single(files):
    got = chunks.chunk_significant(files([("a.py", "x\n" * 13)]), 5)
    assert spans(got) == [(0, 1, 5), (1, 5, 9), (2, 9, 13)]
    assert chunks.chunk_significant(files([("a.py", "")]), 5).count() == 0
    kept = chunks.chunk_significant(files([("a.py", "")]), 5, keep_empty=True).collect()
    assert [(r["chunk_no"], r["total_lines"]) for r in kept] == [(None, 0)]
    assert spans(chunks.chunk_significant(files([("a.py", "x")]), 5), "reported_end_line") == [(0, 1, 1, 0)]


def test_chunk_size_one_shares_nothing(files):
    with pytest.raises(ValueError):
        chunks.chunk_significant(files([("a.py", "x")]), 1)
    assert spans(chunks.chunk_significant(files([("a.py", "x\ny")]), 1, overlap=0)) == [(0, 1, 1), (1, 2, 2)]


def walk_file(flags, size, overlap):
    """One chunk after the other, line by line: the slow way the closed form must equal."""
    out, start, n = [], 0, len(flags)
    while start < n:
        at, seen = start, 0
        while seen < size and at < n:
            seen += flags[at]
            at += 1
        out.append((len(out), start + 1, at, seen))
        if at >= n:
            break
        start = at - overlap
    return out


@pytest.mark.parametrize("overlap", [0, 1])
@pytest.mark.parametrize("size", [2, 3, 5])
def test_bounds_equal_line_by_line(files, size, overlap):
    rng = random.Random(size * 10 + overlap)
    flags = [[rng.random() < 0.6 for _ in range(rng.randint(1, 40))] for _ in range(300)]
    texts = ["".join(("x" if f else " ") + "\n" for f in flag) for flag in flags]
    got = chunks.chunk_significant(files([(f"{i:04d}.py", t) for i, t in enumerate(texts)]), size, overlap)
    found = {}
    for r in got.orderBy("rel_path", "chunk_no").collect():
        found.setdefault(int(r["rel_path"][:4]), []).append((r["chunk_no"], r["start_line"], r["end_line"], r["n_sig"]))
        lines = texts[int(r["rel_path"][:4])].splitlines(True)
        assert r["content"] == "".join(lines[r["start_line"] - 1 : r["end_line"]])
        assert r["eof"] == (r["end_line"] == len(lines))
    assert found == {i: walk_file(flag, size, overlap) for i, flag in enumerate(flags)}


def test_fixed(files):
    got = chunks.chunk_fixed(files([("a.py", "x\ny\nz")]), 2)
    assert spans(got, "eof", "content") == [(0, 1, 2, False, "x\ny\n"), (1, 3, 3, True, "z")]
    assert spans(chunks.chunk_fixed(files([("a.py", "x\ny\nz")]), 2, start=2), "eof") == [(0, 2, 3, True)]
    assert chunks.chunk_fixed(files([("a.py", "x")]), 2, start=5).count() == 0


def test_lines_and_counts(files):
    df = files([("a.cs", "x\n\n// c\ny"), ("b.py", "\n\n"), ("c.py", "")])
    got = [(r["rel_path"], r["line_no"], r["is_sig"], r["sig_so_far"]) for r in chunks.lines(df).orderBy("rel_path", "line_no").collect()]
    assert got == [
        ("a.cs", 1, True, 1), ("a.cs", 2, False, 1), ("a.cs", 3, False, 1), ("a.cs", 4, True, 2),
        ("b.py", 1, False, 0), ("b.py", 2, False, 0),
    ]
    counts = {r["rel_path"]: (r["total_lines"], r["significant_lines"], r["progress_lines"]) for r in chunks.line_counts(df).collect()}
    assert counts == {"a.cs": (4, 2, 2), "b.py": (2, 0, 2), "c.py": (0, 0, 0)}


def test_structural_after_two_chunks(spark):
    df = spark.createDataFrame([(True, 1), (True, 2), (False, 5)], "oversized_file boolean, chunk_no int")
    assert [r["structural_only"] for r in chunks.mark_structural(df).collect()] == [False, True, False]


def test_chunking_shuffles_nothing(spark, files):
    plan = chunks.chunk_significant(files([("a.py", "x")]), 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_same_at_any_partitioning(files):
    df = files([(f"{i}.py", PY * (i % 5)) for i in range(40)])
    total = lambda parts: chunks.chunk_significant(df.repartition(parts), 5).agg(
        F.sum(F.xxhash64("rel_path", "chunk_no", "content").cast("decimal(38,0)"))
    ).first()[0]
    assert total(1) == total(8)
