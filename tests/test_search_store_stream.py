import pytest
from pyspark.sql import functions as F

from corpuslens.functions.vectors import embed
from corpuslens.operators import lookup, rollup, search
from corpuslens.plans import analyze
from corpuslens.sources import store as stores
from corpuslens.streaming import incremental

KEYS = "collection string, corpus_id string, rel_path string, id string, embedding array<float>"


def records(spark, vectors, collection="functions"):
    rows = [(collection, "c", f"p{i:04d}", f"{i:04d}", v) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, KEYS)


def queries(spark, vectors):
    return spark.createDataFrame(list(enumerate(vectors)), "query_id int, embedding array<float>")


def test_scores(spark):
    held = records(spark, [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]])
    got = search.find_similar(held, queries(spark, [[1.0, 0.0]]), 3, content=False).orderBy("rank").collect()
    assert [(r["id"], r["relevance_score"]) for r in got] == [("0000", 1.0), ("0001", 0.0), ("0002", -1.0)]


def test_caps(spark):
    held = records(spark, [[1.0, float(i)] for i in range(25)])
    asked = queries(spark, [[1.0, 0.0]])
    assert search.search(held, asked, 30, content=False).count() == 25
    assert search.search(held, asked, 30, per_collection_cap=20, content=False).count() == 20
    assert search.search(held, asked, 30, per_collection_cap=30, content=False).count() == 25
    assert search.find_similar(held, asked, 30, content=False).count() == 25
    assert search.search(held, asked, 30, "unknown", content=False).count() == 0
    assert search.search_by_type(held, asked, "unknown", content=False).count() == 0
    assert search.search_by_type(held, asked, "function", content=False).count() == 10
    assert search.find_similar(held, asked, 3, "dependencies", content=False).count() == 0
    assert search.search(held, asked.limit(0), content=False).count() == 0


def brute(vectors, asked, k):
    import numpy as np

    out = {}
    for i, q in enumerate(asked):
        gaps = ((np.array(vectors) - np.array(q)) ** 2).sum(axis=1).round(9)
        out[i] = sorted((d, f"{j:04d}") for j, d in enumerate(gaps))[:k]
    return {i: [j for _, j in hits] for i, hits in out.items()}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_exact_with_copies_on_every_way(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (600, 4)).astype(float)
    vectors[100:300] = vectors[0]  # a third are copies
    asked = np.vstack([rng.normal(size=(30, 4)), vectors[:1]]).astype(np.float32).astype(float)
    want = brute(vectors.tolist(), asked.tolist(), 7)
    held, wanted = records(spark, vectors.tolist()), queries(spark, asked.tolist())
    assert found(search.knn(held, wanted, 7)) == want
    assert found(search.knn(held.repartition(5), wanted, 7)) == want
    assert found(search.knn(held, wanted, 7, block=4)) == want
    centres = search.fit_cells(held, 8)
    search.assign_cells(held, centres).write.partitionBy("cell").parquet(str(tmp_path / "cells"))
    assert found(search.knn_cells(spark.read.parquet(str(tmp_path / "cells")), centres, wanted, 7, probe=1)) == want
    cells = spark.read.parquet(str(tmp_path / "cells"))
    assert found(search.knn_cells(cells, centres, wanted, 7, probe=1, block=4)) == want  # queries sent to cells
    assert found(search.knn_cells(cells, centres, wanted, 700, probe=2, block=4)) == brute(vectors.tolist(), asked.tolist(), 700)


def test_many_queries_go_to_few_cells(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    middles = np.eye(6) * 50
    place = lambda n: [[float(x) for x in row] for row in (middles[np.arange(n) % 6] + rng.normal(size=(n, 6))).astype(np.float32)]
    held = records(spark, place(600)).withColumn("collection", F.when(F.col("id") < "0300", "classes").otherwise("functions"))
    cells = search.assign_cells(held, middles).unionByName(
        records(spark, [[1.0] * 6]).withColumns({"cell": F.lit(search.LOOSE), "cell_distance": F.lit(None).cast("double")})
    )
    radii = {(r["collection"], r["cell"]): r["radius"] for r in search.cell_radii(cells.filter("cell >= 0")).collect()}
    index, asked = search.Cells(cells, middles.tolist(), radii), queries(spark, place(60))
    pick = lambda df: sorted(tuple(r[c] for c in ("query_id", "collection", "id", "distance", "rank")) for r in df.collect())
    assert pick(search.knn_index(index, asked, 5, probe=1, block=8)) == pick(search.knn(cells, asked, 5))
    # one cell and the loose records each; the second round finds nothing that could be nearer
    assert search._to_cells(index, asked, 1).groupBy("query_id").count().filter("count <> 2").count() == 0
    bounded = asked.withColumn("worst", F.array(F.lit(400.0), F.lit(400.0)))
    assert search._to_cells(index, bounded, 1).count() == 0
    unbounded = asked.withColumn("worst", F.array(F.lit(400.0), F.lit(None).cast("double")))
    assert search._to_cells(index, unbounded, 1).count() == 60 * 5


def test_index_of_a_store_is_exact_and_reads_cells(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(5)
    middles = rng.normal(size=(12, 4)) * 20
    points = lambda n, seed: (middles[np.arange(n) % 12] + np.random.default_rng(seed).normal(size=(n, 4))).astype(np.float32)
    store, kinds = str(tmp_path / "store"), ("file_summaries", "classes")

    def write(numbers, seed, label=None):
        vectors = points(600, seed).tolist()
        rows = [(c, "c", f"{i:04d}", f"{i:04d}", "d", [float(x) for x in vectors[i]], f"n{i % 2}") for i in numbers for c in kinds]
        df = spark.createDataFrame(rows, "collection string, corpus_id string, rel_path string, id string, document string, embedding array<float>, name string")
        for column in ("file_path", "filename", "extension", "type", "error_message"):
            df = df.withColumn(column, F.lit("x"))
        df = df.withColumn("total_lines", F.lit(1).cast("long")).withColumns({c: F.lit(False) for c in ("has_error", "oversized_file")})
        return stores.write_records(df, store, label)

    asked = queries(spark, [[float(x) for x in row] for row in points(3, 9)])

    def same(**options):
        held, index = stores.read_collections(spark, store), stores.read_index(spark, store)
        pick = lambda df: sorted((r["query_id"], r["collection"], r["rank"], r["id"], r["relevance_score"]) for r in df.collect())
        want = pick(search.search(held, asked, 9, **options))
        assert len(want) > 0 and pick(search.search(held, asked, 9, index=index, **options)) == want

    write(range(400), 1)
    assert stores.read_index(spark, store) is None and stores.build_index(spark, store, cells=12) == 12
    same()
    write(range(300, 600), 2, "again")  # placed as it is written, replaces a hundred files
    same()
    same(collection="classes", filters={"class_name": "n1"})
    write(range(250, 450), 3, "again")  # the same label: the cells of the old batch go
    same()
    index = stores.read_index(spark, store)
    assert {cell for _, cell in index.radii} <= set(range(12))
    reached = search.knn_index(index, asked, 3)
    assert reached.count() == 18
    # 3 queries near 3 of 12 middles: at most half of the rows are read, by filters that reach the scan
    first = index.rows.filter(search.in_cells({("classes", 1), ("classes", 2), ("classes", 7)}))
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = first._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = [line for line in plan.split("PushedFilters: ") if "cell" in line.split("ReadSchema")[0]]
    assert any("EqualTo(cell,7)" in line and "GreaterThanOrEqual(cell,1)" in line for line in pushed), plan
    near = lambda rows: rows.filter("collection = 'classes'").count()
    assert near(first) < near(index.rows) / 2
    # a generation whose writer broke off before its cells: searched in full
    name = write([7, 900 - 400], 4)
    stores._unplace(spark, store, [name])
    assert stores.read_index(spark, store).rows.filter(F.col("cell") == search.LOOSE).count() == 4
    same()
    stores.compact(spark, store)
    assert stores.read_index(spark, store).rows.filter(F.col("cell") == search.LOOSE).count() == 0
    same()


def test_filters_of_cells(spark):
    held = spark.range(40).select(F.lit("a").alias("collection"), (F.col("id") - 1).cast("int").alias("cell"))
    cells = lambda pairs, *more: [r["cell"] for r in held.filter(search.in_cells(pairs, *more)).orderBy("cell").collect()]
    assert cells([]) == [-1] and cells([("b", 3)]) == [-1]
    assert cells([("a", n) for n in (1, 2, 3, 9, 20)]) == [-1, 1, 2, 3, 9, 20]
    # too few ranges: cells between pass too, none is lost
    assert cells([("a", n) for n in (1, 3, 5, 30)], 2) == [-1, 1, 2, 3, *range(5, 31)]


def test_embedders(spark):
    df = spark.createDataFrame([("a b a",), ("A. b, a",), ("",), (None,)], "t string")
    vectors = [r["embedding"] for r in embed(df, "t", dim=16).collect()]
    assert vectors[0] == vectors[1] and vectors[2] == vectors[3] == [0.0] * 16
    assert abs(sum(x * x for x in vectors[0]) - 1) < 1e-6
    lengths = embed(df, "t", lambda: lambda texts: [[len(t), 1.0] for t in texts]).collect()
    assert [r["embedding"] for r in lengths] == [[5.0, 1.0], [7.0, 1.0], [0.0, 1.0], [0.0, 1.0]]


@pytest.fixture
def stored(spark, files, tmp_path):
    store = str(tmp_path / "store")
    df = files([("a.py", "class X\nclass Y\nimport os\n"), ("d/b.py", "class Z\ndef f\n")])
    analyze.analyze_corpora(df, store, recursive=True, dim=16)
    return store


def shown(df):
    return sorted((r["collection"], r["rel_path"], r["document"]) for r in df.collect() if r["collection"] != "file_summaries")


def test_store_upsert_replay_and_compaction(spark, files, stored):
    first = shown(stores.read_collections(spark, stored))
    assert ("classes", "a.py", "Y") in first and ("functions", "d/b.py", "f()") in first
    newer = files([("a.py", "class X\n")])
    write = lambda: analyze.analyze_corpora(newer, stored, resume=False, dim=16, label="again")
    write()
    want = [("classes", "a.py", "X"), ("classes", "d/b.py", "Z"), ("functions", "d/b.py", "f()")]
    assert shown(stores.read_collections(spark, stored)) == want
    write()
    assert shown(stores.read_collections(spark, stored)) == want
    stores.compact(spark, stored)
    assert shown(stores.read_collections(spark, stored)) == want
    stores.write_records(rollup.to_records(analyze.analyze_files(files([("n.py", "class N\n")]))), stored)
    assert shown(stores.read_collections(spark, stored)) == sorted([*want, ("classes", "n.py", "N")])
    assert shown(stores.read_collections(spark, stored, ["functions"])) == [("functions", "d/b.py", "f()")]


def test_resume_redoes_changed_files_only(spark, files, stored):
    seen = spark.sparkContext.accumulator(0)

    def provider():
        def client(prompts, timeout):
            seen.add(sum("```" in p for p in prompts))
            return ['{"description": "d", "classes": ["Asked"], "functions": []}' for _ in prompts]

        return client

    df = files([("a.py", "class Changed\n"), ("d/b.py", "class Z\ndef f\n"), ("new.py", "class New\n")])
    analyze.analyze_corpora(df, stored, provider, dim=16, recursive=True)
    classes = {(r[1], r[2]) for r in shown(stores.read_collections(spark, stored)) if r[0] == "classes"}
    assert classes == {("a.py", "Asked"), ("d/b.py", "Z"), ("new.py", "Asked")} and seen.value == 2


def test_labels_are_whole_and_old_places_are_not_written(spark, files, tmp_path):
    store = str(tmp_path / "s")
    record = lambda name, text: rollup.to_records(analyze.analyze_files(files([(name, f"class {text}\n")])))
    first = stores.write_records(record("a.py", "A1"), store, "1")
    assert stores.write_records(record("b.py", "B1"), store, "stream.1") != first
    assert stores.write_records(record("a.py", "A1"), store, "1") == first
    stores.compact(spark, store)
    stores.write_records(record("c.py", "C1"), store)
    assert stores.write_records(record("a.py", "A2"), store, "1") != first
    want = [("classes", "a.py", "A2"), ("classes", "b.py", "B1"), ("classes", "c.py", "C1")]
    assert shown(stores.read_collections(spark, store)) == want
    stores.compact(spark, store)
    stores.compact(spark, store)
    assert shown(stores.read_collections(spark, store)) == want
    with pytest.raises(ValueError):
        stores.write_records(record("a.py", "A3"), store, "base")


def test_a_store_folds_itself_and_drops_what_was_folded(spark, files, tmp_path):
    store = str(tmp_path / "s")
    record = lambda k, text: rollup.to_records(analyze.analyze_files(files([(f"{k}.py", f"class {text}\n")])))
    for k in range(9):
        stores.write_records(record(k, f"C{k}"), store, compact_after=3)
    assert shown(stores.read_collections(spark, store)) == [("classes", f"{k}.py", f"C{k}") for k in range(9)]
    live = stores._generations(spark, store)
    assert len(live) <= 6 and any("@base" in n for n in live)
    assert sorted(n for n in live if "@base" in n) == sorted(p.name for p in (tmp_path / "s" / "folded").iterdir())
    # a later write of an old file counts although folds have been written since, and survives the next folds
    stores.write_records(record(0, "New"), store, compact_after=None)
    for k in range(9, 13):
        stores.write_records(record(k, f"C{k}"), store, compact_after=3)
    want = [("classes", "0.py", "New"), *(("classes", f"{k}.py", f"C{k}") for k in range(1, 13))]
    assert shown(stores.read_collections(spark, store)) == sorted(want)
    stores.compact(spark, store)
    assert shown(stores.read_collections(spark, store)) == sorted(want) and len(stores._generations(spark, store)) == 1


def test_a_fold_stands_where_its_last_member_stood(spark, files, tmp_path):
    """Equal versions: the later generation counts, also against a fold that was written after it."""
    from pyspark.sql import functions as F

    store = str(tmp_path / "s")
    same = F.lit("2020-01-01 00:00:00").cast("timestamp")
    record = lambda text: rollup.to_records(analyze.analyze_files(files([("a.py", f"class {text}\n")]))).withColumn("modified_at", same)
    for text in ("A", "B", "C"):
        stores.write_records(record(text), store, compact_after=None)
    names = stores._generations(spark, store)
    stores._fold(spark, store, names[:2])
    assert [n.partition(".")[0] for n in stores._generations(spark, store)] == ["gen=000000000001", "gen=000000000002"]
    assert shown(stores.read_collections(spark, store)) == [("classes", "a.py", "C")]


def rewritten(sizes, fan=8):
    """Bytes that folds read when generations of these sizes come one by one, and how many stand at most."""
    held, read, most = [], 0, 0
    for size in sizes:
        held.append(size)
        while found := stores.due(held, fan):
            a, b = found
            read += sum(held[a:b])
            held[a:b] = [sum(held[a:b])]
        most = max(most, len(held))
    return read, most


def test_rewriting_grows_as_n_log_n():
    import math
    import random

    draw = random.Random(4)
    for n in (200, 2_000, 20_000):
        for sizes in ([10_000] * n, [draw.randint(5_000, 40_000) for _ in range(n)]):
            read, most = rewritten(sizes)
            assert read <= sum(sizes) * (math.log(n, 8) + 1)
            assert most <= 2 * 8 * (math.log(n, 8) + 2)


def test_small_batches_do_not_move_a_large_generation():
    read, _ = rewritten([10**12] + [10_000] * 5_000)
    assert read < 10**9
    read, _ = rewritten([10_000, 10**9] * 40)  # small ones between large ones go with them
    assert read <= 40 * 10**9 * 3


def test_missing_store(spark, tmp_path):
    with pytest.raises(ValueError):
        stores.read_collections(spark, str(tmp_path / "nothing"))


def test_search_and_lookups_on_the_store(spark, stored):
    held = stores.read_collections(spark, stored)
    asked = spark.createDataFrame([(1, "X")], "query_id int, text string")
    best = search.search(held, asked, 1, "classes", dim=16).first()
    assert (best["document"], best["name"], round(best["relevance_score"], 6)) == ("X", "X", 1.0)
    only = search.search(held, asked, filters={"extension": ".py", "has_error": "false"}, dim=16)
    assert {r["collection"] for r in only.collect()} == {"file_summaries"}
    named = search.search(held, asked, filters={"class_name": "Y"}, dim=16).collect()
    assert [r["document"] for r in named] == ["Y"]
    assert search.search(held, asked, filters={"no_such": 1}, dim=16).count() == 0
    assert search.search(held, asked, filters={"total_lines": "abc"}, dim=16).count() == 0
    paths = spark.createDataFrame([("c", "/r/d/b.py"), ("c", "/q/a.py"), ("c", "b.py")], "corpus_id string, path string")
    got = {r["path"]: (r["rel_path"], r["found_by"]) for r in lookup.file_summary(held, paths).collect()}
    assert got == {"/r/d/b.py": ("d/b.py", 1), "/q/a.py": ("a.py", 2)}
    exact = lookup.file_details(held, spark.createDataFrame([("c", "d/b.py")], "corpus_id string, path string"))
    assert sorted(r["section"] for r in exact.collect()) == ["classes", "functions", "summary"]
    by_name = lookup.file_details(held, spark.createDataFrame([("c", "q/b.py")], "corpus_id string, path string"), by="filename")
    assert by_name.count() == 3
    known = lookup.file_details(held, spark.createDataFrame([("c", "/r/d/b.py")], "corpus_id string, path string"), by="filename")
    assert sorted(r["section"] for r in known.collect()) == ["classes", "functions", "summary"]
    listed = {r["rel_path"]: (r["total_lines"], r["has_error"]) for r in lookup.list_files(held).collect()}
    assert listed == {"a.py": (3, False), "d/b.py": (2, False)}


def test_metadata_filter_prunes_and_pushes(spark, stored):
    chosen = search.metadata_filter(
        search.choose_collections(stores.read_collections(spark, stored), "classes"), {"name": "X"}
    )
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(name,X)" in plan and "PartitionFilters: [isnotnull(collection" in plan.replace("\n", " ")


def test_project_rows(spark, files):
    info = rollup.project_info(files([("a.py", ""), ("b.py", "")]), F.lit("/r"))
    row = info.first()
    assert (row["file_count"], row["completed"], row["completion_date"]) == (2, False, None)
    done = rollup.finish_run(info).first()
    assert done["completed"] and done["completion_date"] is not None
    assert lookup.project_info(info, "other").count() == 0


def test_stream_resumes_and_replaces(spark, files, tmp_path):
    folder, store, checkpoint = (str(tmp_path / n) for n in ("in", "store", "checkpoint"))

    def arrive(rows, day):
        stamped = files(rows).withColumn("modified_at", F.lit(f"2024-01-{day:02d}").cast("timestamp"))
        stamped.coalesce(1).write.mode("append").parquet(folder)
        return stamped.schema

    def run(schema):
        stream = spark.readStream.schema(schema).parquet(folder)
        incremental.analyze_stream(stream, checkpoint, incremental.store_sink(store, dim=8)).awaitTermination()
        return shown(stores.read_collections(spark, store))

    schema = arrive([("a.py", "class Old\n"), ("b.py", "class B\n")], 1)
    arrive([("a.py", "class New\n")], 2)
    assert run(schema) == [("classes", "a.py", "New"), ("classes", "b.py", "B")]
    arrive([("b.py", "x\n"), ("c.py", "class C\n")], 3)
    assert run(schema) == [("classes", "a.py", "New"), ("classes", "c.py", "C")]
    assert run(schema) == [("classes", "a.py", "New"), ("classes", "c.py", "C")]
    info, stats = incremental.finish(spark, store, rollup.project_info(files([("a.py", "")]), F.lit("/r")))
    assert info.first()["completed"] and {r["collection"]: r["records"] for r in stats.collect()} == {
        "file_summaries": 3, "classes": 2,
    }


def test_run_keeps_project_rows_and_file_lists(spark, files, stored):
    info = lookup.project_info(stores.read_table(spark, stored, stores.PROJECTS), "c").first()
    assert (info["source_dir"], info["file_count"], info["completed"]) == ("/r", 2, True)
    pages = stores.read_table(spark, stored, stores.FILE_LISTS).collect()
    assert [(r["id"], r["document"], r["count"]) for r in pages] == [("files_chunk_0", "/r/a.py\n/r/d/b.py", 2)]
    analyze.analyze_corpora(files([("z.py", "class Z\n")], "other"), stored, dim=16)
    both = {r["corpus_id"]: r["file_count"] for r in stores.read_table(spark, stored, stores.PROJECTS).collect()}
    assert both == {"c": 2, "other": 1}


def test_several_sinks_and_an_own_analyzer(spark, files, tmp_path):
    rows = analyze.analyze_files(
        files([("a.py", "x\n"), ("b.py", "")]),
        analyzer=lambda chunks: chunks.drop("content", "prompt").select(
            "*", F.lit(None).cast("string").alias("error"), F.array(F.lit("Own")).alias("classes"),
            F.array(F.lit("f()")).alias("functions"), F.array(F.lit("os")).alias("dependencies"),
        ),
    )
    store = str(tmp_path / "s")
    sink = incremental.all_of(incremental.store_sink(store, dim=4), incremental.report_sink(store))
    sink(rows, "x.0")
    sink(rows, "x.0")
    assert shown(stores.read_collections(spark, store)) == [
        ("classes", "a.py", "Own"), ("dependencies", "a.py", "os"), ("functions", "a.py", "f()"),
    ]
    reports = spark.read.parquet(f"{store}/reports")
    assert reports.count() == 2 and reports.filter("report LIKE '%- Own%'").count() == 1


def scans(df):
    """The file scans of a plan, as text."""
    import re

    return re.findall(r"FileScan parquet.*", df._jdf.queryExecution().executedPlan().toString())


def test_documents_are_fetched_by_key(spark, files, tmp_path):
    """The second phase reads the collections and paths of the hits alone."""
    store = str(tmp_path / "s")
    many = files([(f"f{k:03d}.py", f"class Name{k}\n") for k in range(60)])
    analyze.analyze_corpora(many, store, dim=1024)
    asked = spark.createDataFrame([(1, "Name7"), (2, "Name41")], "query_id int, text string")
    found = search.search(stores.read_collections(spark, store), asked, 2, "classes", dim=1024)
    (documents,) = [s for s in scans(found) if "document" in s.partition("ReadSchema")[2]]
    assert "embedding" not in documents.partition("ReadSchema")[2]
    assert "rel_path" in documents.partition("PushedFilters")[2] and "PartitionFilters: [collection" in documents.replace("isnotnull(collection#", "collection#").replace("(collection", "collection")
    rows = {(r["query_id"], r["rank"]): r["document"] for r in found.collect()}
    assert (rows[1, 1], rows[2, 1]) == ("Name7", "Name41") and len(rows) == 4
    none = search.search(stores.read_collections(spark, store), asked, 2, "no such", dim=1024)
    assert none.count() == 0


def test_ranges_around_many_hits(spark, monkeypatch):
    """More hits than ranges: neighbours share one, nothing is lost."""
    rows = [("classes", f"c{k % 3}", f"p{k:03d}", f"i{k}", f"text {k}") for k in range(90)]
    records = spark.createDataFrame(rows, "collection string, corpus_id string, rel_path string, id string, document string")
    hits = records.filter("rel_path > 'p010' AND id <> 'i50'").drop("document")
    for ranges in (256, 5, 2):
        monkeypatch.setattr(search, "RANGES", ranges)
        assert search._around(records, hits).join(hits, ["collection", *search.KEYS], "left_semi").count() == hits.count() == 78
    assert search._around(records, hits.limit(0)).count() == 0


def test_each_query_in_its_own_corpus(spark, monkeypatch):
    import random

    draw = random.Random(2)
    rows = [("k" + str(i % 2), draw.choice(["hot"] * 5 + ["a", "b", None]), f"p{i}", f"{i:04d}", [float(draw.randint(0, 3)) for _ in range(4)]) for i in range(400)]
    records = spark.createDataFrame(rows, "collection string, corpus_id string, rel_path string, id string, embedding array<float>").repartition(5)
    asked = [(i, draw.choice(["hot", "a", "b", "nowhere", None]), [float(draw.randint(0, 3)) for _ in range(4)]) for i in range(60)]
    queries = spark.createDataFrame(asked, "query_id int, corpus_id string, embedding array<float>")
    expected = set()
    for i, corpus, point in asked:
        for kind in ("k0", "k1"):
            near = sorted((sum((x - y) ** 2 for x, y in zip(r[4], point)), r[1], r[2], r[3]) for r in rows if corpus is not None and r[1] == corpus and r[0] == kind)
            expected |= {(i, kind, corpus, r[3], rank) for rank, r in enumerate(near[:7], 1)}
    shown_ = lambda found: {(r["query_id"], r["collection"], r["corpus_id"], r["id"], r["rank"]) for r in found.collect()}
    assert shown_(search.knn(records, queries, 7)) == expected
    monkeypatch.setattr(search, "RECORDS_PER_GROUP", 50)  # the hot corpus in pieces
    assert shown_(search.knn(records, queries, 7, block=8)) == expected
    assert search.knn(records, queries.filter("corpus_id IS NULL"), 7).count() == 0
