"""Work that has to grow with the input, and no faster."""

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import model, search, skew
from corpuslens.plans import analyze
from corpuslens.sources import store as stores
from workload import queries as q


class Stop(Exception):
    pass


@pytest.fixture
def tables(spark, tmp_path):
    rows = [(i, f"Text {i}. More of it, and more.", "en", "web") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_each_wave_reads_its_own_prompts(spark, tmp_path, monkeypatch):
    seen, real = [], model.infer

    def infer(part, provider, **options):
        seen.append((part.inputFiles(), options))
        return real(part, provider, **options)

    monkeypatch.setattr(model, "infer", infer)
    names = [f"p{i}" for i in range(60)]
    asked = spark.createDataFrame([(n, n) for n in names], "prompt_hash string, prompt string")
    got = analyze.answer(asked, str(tmp_path), lambda: lambda texts, timeout: [t.upper() for t in texts], wave=6, tasks=4, calls_per_second=1000.0)
    assert {r["prompt_hash"]: r["response"] for r in got.collect()} == {n: n.upper() for n in names}
    files = [f for held, _ in seen for f in held]
    assert len(files) == len(set(files)) >= len(seen) > 1 and all(held for held, _ in seen)
    assert {o["tasks"] for _, o in seen} == {1} and {o["calls_per_second"] for _, o in seen} == {250.0}


def test_a_wave_neither_lists_the_store_nor_shuffles(spark, tmp_path, monkeypatch):
    plans, listed, infer, folders = [], [], model.infer, stores._folders

    def planned(part, provider, **options):
        answers = infer(part, provider, **options)
        plans.append(answers._jdf.queryExecution().executedPlan().toString())
        return answers

    monkeypatch.setattr(model, "infer", planned)
    monkeypatch.setattr(stores, "_folders", lambda *a: listed.append(1) or folders(*a))
    monkeypatch.setattr(stores, "fold_responses", lambda *a, **o: None)
    names = [f"p{i}" for i in range(300)]
    asked = spark.createDataFrame([(n, n) for n in names * 2], "prompt_hash string, prompt string")
    got = analyze.answer(asked, str(tmp_path), lambda: lambda texts, timeout: [t.upper() for t in texts], wave=10, tasks=4)
    assert {r["prompt_hash"]: r["response"] for r in got.collect()} == {n: n.upper() for n in names}
    assert len(plans) > 20 and not any("Exchange" in plan for plan in plans)
    assert len(listed) < len(plans) / 2
    parts = folders(spark, f"{tmp_path}/{stores.RESPONSES}")  # each wave is a part of its own, at a place of its own
    assert len(parts) == len(plans) == len({name.partition(".")[0] for name in parts})


def test_waves_of_several_tasks_answer_all(spark, tmp_path):
    names = [f"p{i}" for i in range(40)]
    asked = spark.createDataFrame([(n, n) for n in names], "prompt_hash string, prompt string")
    got = analyze.answer(asked, str(tmp_path), lambda: lambda texts, timeout: list(texts), wave=20, tasks=5)
    assert sorted(r["response"] for r in got.collect()) == sorted(names)


def test_waves_ask_what_failed_and_nothing_else(spark, tmp_path):
    names = [f"p{i}" for i in range(60)]
    asked = spark.createDataFrame([(n, n) for n in names] + [(None, None)] * 2, "prompt_hash string, prompt string")
    bad = lambda: lambda texts, timeout: [ValueError("bad") if t is None or t.endswith("3") else "first" for t in texts]
    analyze.answer(asked, str(tmp_path), bad, wave=7)
    got = analyze.answer(asked, str(tmp_path), lambda: lambda texts, timeout: ["again"] * len(texts), wave=2)
    assert {r["prompt_hash"]: r["response"] for r in got.collect()} == {n: "again" if n.endswith("3") else "first" for n in names}


def test_prompts_are_dealt_out_in_the_shuffle_that_drops_their_copies(spark):
    asked = spark.range(100).select(F.col("id").cast("string").alias("prompt_hash"), F.lit("x").alias("prompt"))
    deal = {"_wave": F.pmod(F.xxhash64("prompt_hash"), F.lit(5)).cast("int")}
    dealt = model.pending_prompts(asked.union(asked), None, deal)
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert dealt.count() == 100 and dealt.select("prompt_hash").distinct().count() == 100
    good = asked.limit(30).select("prompt_hash", F.lit(None).cast("string").alias("error"))
    failed = asked.select("prompt_hash", F.lit("no").alias("error"))
    assert model.pending_prompts(asked, good.union(failed), deal).count() == 70


def test_the_time_is_told_anew_once_a_second(monkeypatch):
    clock, at = analyze.Clock(), [10.0]
    monkeypatch.setattr(analyze.time, "monotonic", lambda: at[0])
    first = clock.now()
    at[0] = 10.9
    assert clock.now() is first
    at[0] = 11.0
    assert clock.now() is not first and clock.now() >= first


def test_a_failing_wave_keeps_what_was_stored(spark, tmp_path):
    def provider():
        raise RuntimeError("no client")

    asked = spark.createDataFrame([(f"p{i}", "x") for i in range(20)], "prompt_hash string, prompt string")
    good = asked.filter("prompt_hash < 'p15'")
    analyze.answer(good, str(tmp_path), lambda: lambda texts, timeout: list(texts), wave=3)
    with pytest.raises(Exception):
        analyze.answer(asked, str(tmp_path), provider, wave=2)
    assert stores.read_responses(spark, str(tmp_path)).count() == good.count()


def test_a_larger_scan_is_spread_into_more_pieces(spark, tmp_path, monkeypatch):
    spark.range(5000).coalesce(1).write.parquet(f"{tmp_path}/t")
    held = spark.read.parquet(f"{tmp_path}/t")
    assert skew.spread(held, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(skew, "PIECE_BYTES", 1000, raising=False)
    more = skew.spread(held, "id")
    assert more.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert more.count() == 5000


def test_arriving_files_come_in_few_batches_of_many_files(spark, tables):
    files = q.codefiles(spark, tables)
    twice = files.unionByName(files)
    batches = []
    stream = q.arriving(twice, 4)
    stream.writeStream.foreachBatch(lambda df, i: batches.append([r["doc_id"] for r in df.select("doc_id").collect()])).option(
        "checkpointLocation", q.work_folder(spark, "stream")
    ).trigger(availableNow=True).start().awaitTermination()
    assert 1 < len(batches) <= 4
    assert sorted(i for b in batches for i in b) == sorted([*range(40), *range(40)])
    assert sum(len(set(b)) for b in batches) == 40  # both rows of a document in one batch


def test_late_versions_are_written_by_many_tasks(spark, tables, monkeypatch):
    monkeypatch.setattr(q, "work_folder", lambda spark, name: f"{tables}/{name}")

    def stop(*args, **options):
        raise Stop

    monkeypatch.setattr(q.incremental, "analyze_stream", stop)
    with pytest.raises(Stop):
        q.late_old_version(spark, tables)
    assert len(spark.read.parquet(f"{tables}/arriving").inputFiles()) > 1


def test_reports_of_a_replay_come_from_one_analysis(spark, tables, monkeypatch):
    calls, real = [], q.analysed
    monkeypatch.setattr(q, "analysed", lambda *a, **o: calls.append(1) or real(*a, **o))
    assert q.report_sink_rows(spark, tables).count() == 40
    assert len(calls) == 1


def test_records_of_cells_are_embedded_once(spark, tables, monkeypatch):
    def fit(records, cells):
        assert "LogicalRDD" in records._jdf.queryExecution().optimizedPlan().toString()
        raise Stop

    monkeypatch.setattr(q.search, "fit_cells", fit)
    with pytest.raises(Stop):
        q.similar_many_by_cells(spark, tables)


def test_a_generation_is_assigned_to_cells_once(spark, tmp_path, monkeypatch):
    rows = [("functions", "c", f"p{i:03d}", f"{i:03d}", [float(i % 5), 1.0]) for i in range(200)]
    held = spark.createDataFrame(rows, "collection string, corpus_id string, rel_path string, id string, embedding array<float>")
    for column in ("document", "file_path", "filename", "extension", "name", "type", "error_message"):
        held = held.withColumn(column, F.lit("x"))
    for column, kind in (("total_lines", "bigint"), ("has_error", "boolean"), ("oversized_file", "boolean")):
        held = held.withColumn(column, F.lit(None).cast(kind))
    stores.write_records(held, str(tmp_path))
    passed, real = spark.sparkContext.accumulator(0), stores.assign_cells

    def counted(records, centres):
        cut = real(records, centres)

        def count(batches):
            for batch in batches:
                passed.add(batch.num_rows)
                yield batch

        return cut.mapInArrow(count, cut.schema)

    monkeypatch.setattr(stores, "assign_cells", counted)
    assert stores.build_index(spark, str(tmp_path), 3) == 3
    assert passed.value == 200


def test_spans_are_halved(spark):
    spans = [("b", "d"), ("f", "f"), ("h", "k"), ("m", "m"), ("p", "r")]
    values = [None, "", *"abcdefghijklmnopqrstuvwxyz", "dd", "fz"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r[0] for r in df.filter(search._within(F.col("v"), spans)).collect()}
    assert got == {v for v in values if v is not None and any(low <= v <= high for low, high in spans)}


def test_records_are_written_without_a_sort(spark):
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    with stores._unsorted(spark):
        assert int(spark.conf.get(name)) >= 4
    assert spark.conf.get(name) == before
