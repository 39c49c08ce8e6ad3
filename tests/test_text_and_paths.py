from pyspark.sql import functions as F

from corpuslens.functions import ignore, paths, text
from corpuslens.operators import chunks
from corpuslens.sources.files import decode_text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_split_lines(spark):
    lines = lambda s: one(spark, text.drop_open_end(text.split_parts(F.lit(s))))
    assert lines("a\r\nb\rc\n") == ["a", "b", "c"]
    assert lines("a") == ["a"]
    assert lines("") == []
    assert lines("\n") == [""]


def test_decode_never_fails(spark):
    got = spark.createDataFrame([(b"a\xffb",), ("é".encode(),), (b"",)], "b binary").select(decode_text(F.col("b")))
    assert [r[0] for r in got.collect()] == ["a\ufffdb", "é", ""]


def test_significant(spark):
    cases = [
        (".cs", "   // x", False), (".cs", "/// <summary>", False), (".CS", "//x", False),
        (".cs", "int a; // x", True), (".py", "# x", True), (".py", "//x", True),
        (".py", " \t", False), (".js", "\u00a0\u2003", False), (".cs", "\t//x", False), (".cs", "\x1c", False),
    ]
    df = spark.createDataFrame(cases, "e string, l string, want boolean")
    assert all(r[0] == r[1] for r in df.select("want", text.is_significant(F.col("l"), F.col("e"))).collect())


def test_paths(spark):
    ext = {"a.py": ".py", ".gitignore": "", "x.tar.gz": ".gz", "noext": "", "..a.b": ".b", "d.e/f": "", "d/.env": ""}
    df = spark.createDataFrame(list(ext.items()), "p string, want string")
    assert all(r[0] == r[1] for r in df.select("want", paths.extension(F.col("p"))).collect())
    rel = lambda p, root="/r": one(spark, paths.relative_path(F.lit(p), F.lit(root)))
    assert rel("/r/a/b.py") == "a/b.py"
    assert rel("/r/a/b.py", "/r/") == "a/b.py"
    assert rel("/elsewhere/b.py") == "b.py"
    assert rel("\\r\\a\\b.py", "\\r") == "a/b.py"
    assert one(spark, paths.safe_id(F.lit("a/b\\c.d e"))) == "a_b_c_d_e"


def test_names(spark):
    assert one(spark, paths.class_name(F.lit("Foo : does x: y"))) == "Foo"
    assert one(spark, paths.function_name(F.lit("run(a): does x"))) == "run"
    assert one(spark, paths.function_name(F.lit("run"))) == "run"
    for item, want in {"import os": "os", "from x import y": "x", "os": "os", "a b": "b"}.items():
        assert one(spark, paths.module_name(F.lit(item))) == want


def test_context_and_oversize(spark):
    for name, want in {"qwen2.5-coder:14b": 32768, "LLAMA3:8b": 8192, "foo": 8192, "llama2": 4096}.items():
        assert one(spark, chunks.context_length(F.lit(name))) == want
    df = spark.createDataFrame([(26212,), (26215,), (26216,)], "size_bytes bigint")
    got = chunks.mark_oversized(df, 8192).collect()
    assert [(r["estimated_tokens"], r["oversized_file"]) for r in got] == [(6553, False), (6553, False), (6554, True)]


IGNORE = [
    (["*.py"], {"a.py": 1, "d/a.py": 1, "a.pyc": 0, "a.py/x": 1}),
    (["/a.py"], {"a.py": 1, "d/a.py": 0}),
    (["build/"], {"build": 0, "build/x": 1, "d/build/x/y": 1, "rebuild/x": 0}),
    (["build"], {"build": 1, "build/x": 1, "d/build": 1, "d/build/x": 1, "build.py": 0}),
    (["doc/*.txt"], {"doc/a.txt": 1, "doc/b/a.txt": 0, "x/doc/a.txt": 0}),
    (["**/foo"], {"foo": 1, "a/b/foo": 1, "a/foo/x": 1, "afoo": 0}),
    (["a/**/b"], {"a/b": 1, "a/x/b": 1, "a/x/y/b": 1, "ab": 0, "z/a/b": 0}),
    (["a/**"], {"a/b": 1, "a/b/c": 1, "a": 0}),
    (["*.log", "!keep.log"], {"x.log": 1, "keep.log": 0, "d/keep.log": 0}),
    (["!keep.log", "*.log"], {"keep.log": 1}),
    (["# note", "", "\\#real", "\\!bang"], {"# note": 0, "#real": 1, "!bang": 1}),
    (["a?c", "[x-z]1", "[!a]2"], {"abc": 1, "a/c": 0, "y1": 1, "a1": 0, "b2": 1, "a2": 0}),
    (["a.c"], {"a.c": 1, "abc": 0}),
    (["trail  "], {"trail": 1}),
    (["/"], {"x": 0}),
    (["**"], {"x": 1, "a/b": 1}),
]


def test_ignore_patterns(spark):
    for patterns, cases in IGNORE:
        df = spark.createDataFrame([(p, bool(w)) for p, w in cases.items()], "p string, want boolean")
        runs = ignore.runs_of(F.lit("\n".join(patterns)))
        got = df.select("p", "want", ignore.matches(F.col("p"), patterns), ignore.matches_runs(F.col("p"), runs))
        for p, want, literal, column in got.collect():
            assert (literal, column) == (want, want), (patterns, p)
