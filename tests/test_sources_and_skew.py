import os

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import discovery
from corpuslens.operators.skew import lookup_join, rank_in_group
from corpuslens.sources import files as sources


@pytest.fixture
def tree(tmp_path):
    for name, content in {
        "a.py": b"x\xff\n", "__init__.py": b"i", ".gitignore": b"skip/\n", "d/b c.py": b"b", "skip/s.py": b"s",
        "node_modules/deep/n.js": b"n", "t.txt": b"t",
    }.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(tmp_path / "tree")


def test_links_to_folders_are_not_entered(spark, tree):
    os.symlink(tree, f"{tree}/loop")
    os.symlink(f"{tree}/a.py", f"{tree}/d/link.py")
    roots = spark.createDataFrame([("c", tree)], "corpus_id string, root string")
    got = sorted(r["rel_path"] for r in sources.walk(roots).collect())
    assert got == [".gitignore", "__init__.py", "a.py", "d/b c.py", "d/link.py", "skip/s.py", "t.txt"]


def test_null_keys_are_spread(spark):
    facts = spark.range(2000).select(F.when(F.col("id") < 10, F.col("id")).alias("k"), F.col("id").alias("v"))
    dim = spark.range(10).select(F.col("id").alias("k"), F.lit("x").alias("w"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = lookup_join(facts, dim, ["k"], ["v"], rows_per_split=100)
        held = joined.filter("k IS NULL").groupBy(F.spark_partition_id()).count().collect()
        assert joined.count() == 2000 and joined.filter("w = 'x'").count() == 10
        assert sum(r["count"] for r in held) == 1990 and max(r["count"] for r in held) < 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scan(spark, tree):
    got = {r["rel_path"]: (r["content"], r["size_bytes"], r["extension"]) for r in sources.scan(spark, tree, "c").collect()}
    assert got["a.py"] == ("x�\n", 3, ".py") and got["d/b c.py"] == ("b", 1, ".py")
    assert sorted(r["rel_path"] for r in sources.scan(spark, tree, "c", recursive=False, glob="*.py").collect()) == ["__init__.py", "a.py"]
    with pytest.raises(Exception):
        sources.scan(spark, tree + "/none", "c")


def test_walk_takes_every_name(spark, tree):
    roots = spark.createDataFrame([("c1", tree), ("c2", tree + "/d")], "corpus_id string, root string")
    listed = sources.walk(roots)
    assert sorted((r["corpus_id"], r["rel_path"]) for r in listed.collect()) == [
        ("c1", ".gitignore"), ("c1", "__init__.py"), ("c1", "a.py"), ("c1", "d/b c.py"), ("c1", "skip/s.py"),
        ("c1", "t.txt"), ("c2", "b c.py"),
    ]
    rules = discovery.ignore_files(sources.read_content(listed.filter(F.col("rel_path") == ".gitignore")))
    kept = sources.read_content(discovery.discover(listed, rules=rules, recursive=True))
    assert sorted((r["corpus_id"], r["rel_path"], r["content"]) for r in kept.collect()) == [
        ("c1", "__init__.py", "i"), ("c1", "a.py", "x�\n"), ("c1", "d/b c.py", "b"), ("c2", "b c.py", "b"),
    ]
    assert sorted(r["rel_path"] for r in sources.walk(roots.limit(1), recursive=False).collect()) == [
        ".gitignore", "__init__.py", "a.py", "t.txt",
    ]


def test_read_content_reports_lost_files(spark, tree):
    listed = spark.createDataFrame([("c", "x", tree + "/x")], "corpus_id string, rel_path string, file_path string")
    row = sources.read_content(listed).first()
    assert row["content"] is None and "x" in row["read_error"]


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, -1)
    yield
    spark.conf.set(name, before)


def test_small_dim_is_left_to_spark(spark):
    joined = lookup_join(spark.range(9).toDF("k"), spark.range(3).toDF("k"), ["k"], ["k"], "inner")
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_piece" not in plan and joined.count() == 3


@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
def test_lookup_join_equals_plain_join(spark, how, no_broadcast):
    facts = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    dim = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(lookup_join(facts, dim, ["k"], ["id"], how, rows_per_split=100)) == rows(facts.join(dim, "k", how))


def test_lookup_join_cuts_the_hot_key(spark, no_broadcast):
    facts = spark.range(10000).select(F.lit(1).alias("k"), "id")
    dim = spark.createDataFrame([(1, "x")], "k int, v string")
    joined = lookup_join(facts, dim, ["k"], ["id"], rows_per_split=500, costly=True)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_piece" in plan and joined.filter("v = 'x'").count() == 10000


def test_rank_in_group_equals_window(spark):
    df = spark.range(2000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.md5(F.col("id").cast("string")).alias("o"))
    got = rank_in_group(df, ["g"], ["o"], "at")
    from pyspark.sql import Window

    want = df.withColumn("at", F.row_number().over(Window.partitionBy("g").orderBy("o")).cast("bigint") - 1)
    assert got.select("g", "o", "at").exceptAll(want.select("g", "o", "at")).count() == 0 and got.count() == 2000


def test_a_listing_runs_through_and_resumes(spark, tree, tmp_path):
    from corpuslens.plans.analyze import analyze_corpora
    from corpuslens.sources import store as stores

    store = str(tmp_path / "store")
    roots = spark.createDataFrame([("c", tree)], "corpus_id string, root string")
    run = lambda: analyze_corpora(sources.walk(roots), store, obey_gitignore=True, recursive=True, dim=4)
    run()
    held = stores.read_collections(spark, store)
    assert sorted(r["rel_path"] for r in held.filter("collection = 'file_summaries'").collect()) == [
        "__init__.py", "a.py", "d/b c.py",
    ]
    (tmp_path / "tree" / "late.py").write_text("class Late\n")
    name = run()
    added = spark.read.parquet(f"{store}/records/{name}")
    assert sorted({r["rel_path"] for r in added.collect()}) == ["late.py"]
    assert stores.read_table(spark, store, stores.PROJECTS).first()["file_count"] == 4
