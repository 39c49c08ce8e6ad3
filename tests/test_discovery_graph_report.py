from pyspark.sql import functions as F

from corpuslens.operators import discovery, graph, report, rollup

TREE = [("sample.py", ""), ("Sample.cs", ""), ("node_modules/excluded.js", ""), ("excluded.txt", "")]


def found(df):
    return [r["rel_path"] for r in df.orderBy("file_path").collect()]


def test_discover(files):
    df = files(TREE)
    assert found(discovery.discover(df)) == ["Sample.cs", "sample.py"]
    assert found(discovery.discover(df, recursive=True)) == ["Sample.cs", "sample.py"]
    assert found(discovery.discover(df, include=["*.txt"])) == ["excluded.txt"]
    assert found(discovery.discover(df, exclude=["s*.py"])) == ["Sample.cs"]
    deep = files([("Build/x.py", ""), ("src/build.py", ""), ("src/Properties/a.cs", ""), ("src/a.PY", ""), ("b.", "")])
    assert found(discovery.discover(deep, recursive=True)) == ["src/a.PY", "src/build.py"]


def test_ignore_files_of_two_corpora(files):
    one = files([(".gitignore", "*.py\n!keep.py\n"), ("a.py", ""), ("keep.py", ""), ("d/x.cs", "")], "c1")
    two = files([(".gitignore", "d/\n"), ("a.py", ""), ("d/x.cs", "")], "c2")
    three = files([("a.py", "")], "c3")
    df = one.unionByName(two).unionByName(three)
    got = discovery.discover(df, rules=discovery.ignore_files(df), recursive=True)
    assert sorted((r["corpus_id"], r["rel_path"]) for r in got.collect()) == [
        ("c1", "d/x.cs"), ("c1", "keep.py"), ("c2", "a.py"), ("c3", "a.py"),
    ]


def test_resume(files):
    df = files([("a.py", ""), ("b.py", "")])
    listed = files([("b.py", ""), ("gone.py", "")])
    assert found(discovery.remaining(df, df.limit(0))) == ["a.py", "b.py"]
    assert found(discovery.resumable(listed, df)) == ["b.py"]
    assert found(discovery.vanished(listed, df)) == ["gone.py"]


GRAPH = [
    ("cli.py", "import util\nimport util\nimport os"), ("pkg/util.py", "from cli import main"), ("a/dup.py", ""),
    ("b/dup.py", ""), ("pkg/x.py", "import dup\nimport x"),
]


def test_graph(files):
    df = files(GRAPH)
    edges = graph.import_edges(df)
    assert sorted((r["src_rel_path"], r["dst_rel_path"], r["match_kind"]) for r in edges.collect()) == [
        ("cli.py", "pkg/util.py", "basename"), ("pkg/util.py", "cli.py", "exact"), ("pkg/x.py", "pkg/x.py", "basename"),
    ]
    nodes = graph.graph_nodes(df)
    assert [(r["node_id"], r["label"], r["is_entry"]) for r in nodes.orderBy("node_no").collect()] == [
        ("f_0", "a/dup.py", False), ("f_1", "b/dup.py", False), ("f_2", "cli.py", True), ("f_3", "util.py", False),
        ("f_4", "x.py", False),
    ]
    lines = graph.graph_lines(nodes, edges).orderBy("part", "src_no", "dst_no").collect()
    assert [r["line"] for r in lines] == [
        "graph TD", "  classDef entryPoint fill:#f96,stroke:#333,stroke-width:2px;", '  f_0["a/dup.py"]',
        '  f_1["b/dup.py"]', '  f_2["cli.py"]:::entryPoint', '  f_3["util.py"]', '  f_4["x.py"]', "  f_2 --> f_3",
        "  f_3 --> f_2", "  f_4 --> f_4",
    ]


def test_entry_falls_back_to_first_of_the_name(files):
    nodes = graph.graph_nodes(files([("b/cli.py", ""), ("a/cli.py", ""), ("m.py", "")]))
    assert [r["rel_path"] for r in nodes.filter("is_entry").collect()] == ["a/cli.py"]
    assert graph.graph_lines(graph.graph_nodes(files([("m.py", "")])), graph.import_edges(files([("m.py", "")]))).count() == 2


def test_unicode_module_names(files):
    edges = graph.import_edges(files([("a.py", "import école"), ("d/école.py", "")]))
    assert [r["dst_rel_path"] for r in edges.collect()] == ["d/école.py"]


def test_report(spark):
    rows = [
        ("c", "d/a.py", "a.py", "<think>t</think># T:\nx\n# T", ["B", "A", "A"], [], ["import os"], None),
        ("c", "b.py", "b.py", None, None, None, None, "boom"),
    ]
    df = spark.createDataFrame(
        rows, "corpus_id string, rel_path string, filename string, summary string, classes array<string>, "
        "functions array<string>, dependencies array<string>, error string",
    )
    got = {r["rel_path"]: r["report"] for r in report.file_report(df).collect()}
    assert got["d/a.py"] == (
        "## 📄 d/a.py\n\n## T\nx\n\n### a.py - **Classes**\n\n- A\n- B\n\n\n### a.py - **Dependencies/Imports**\n\n"
        "- import os\n\n\n---"
    )
    assert got["b.py"] == "\n## 📄 b.py\n\n**Error**: boom\n\n---\n"


def test_section(spark):
    df = spark.createDataFrame([(["C1", "C2", "C3", "C1"],), ([],), (None,)], "x array<string>")
    got = [tuple(r[0]) for r in df.select(rollup.section(F.col("x"))).collect()]
    assert got == [(["C1", "C2", "C3"], True), ([], False), ([], False)]


def test_report_index_and_lines_on_disk(files, tmp_path):
    df = files([("b.py", ""), ("a.py", "")])
    index = report.report_index(df)
    report.write_lines(index, ["part", "rel_path"], str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out" / "corpus_id=c").glob("part-*")))
    assert text == "## Files Remaining to Study\n- `a.py`\n- `b.py`\n"
    assert report.report_index(df.limit(0)).count() == 0


def test_file_list_pages(files):
    df = files([(f"{i:03d}.py", "") for i in range(120)])
    got = rollup.file_list_pages(df).orderBy("chunk").collect()
    assert [(r["id"], r["count"]) for r in got] == [("files_chunk_0", 50), ("files_chunk_1", 50), ("files_chunk_2", 20)]
    assert got[2]["document"].split("\n")[0] == "/r/100.py"
