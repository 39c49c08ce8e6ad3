"""The registered queries: each operator over the whole of the given tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuslens import config
from corpuslens.functions import paths, replies
from corpuslens.functions.vectors import embed, squared_distance
from corpuslens.operators import chunks, discovery, graph, lookup, model, report, rollup, search
from corpuslens.operators.skew import checkpoint_dir, lookup_join, materialise, pieces, spread
from corpuslens.plans import analyze
from corpuslens.sources import store as stores
from corpuslens.sources.files import decode_text, from_table, read_content, walk
from corpuslens.streaming import incremental
from workload.adapter import codefiles, docfiles, table

FILE = ["corpus_id", "rel_path"]
DIM = 64
SIZE = 20
CONTEXT = 1024
INCLUDE = ["*.md", "src1*/**/*.js", "!doc_1*.md", "/doc_*"]
EXCLUDE = ["doc_2?.md", "fr/", "b[1-3]/**/doc_*[05].js"]
IGNORE = {
    "c0": "# made for c0\n*.md\n!doc_1*.md\nde/\n",
    "c1": "/src1*/\n*.txt\n\nnode_modules\n",
    "c2": "src?/**/doc_[1-4]*\n!*.py\n/doc_*\n",
}


def work_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def joined(name: str):
    return F.array_join(name, "|").alias(name)


def found_columns(files: DataFrame) -> DataFrame:
    return files.select(*FILE, "filename", "extension", "size_bytes")


def discover_files(spark, sf):
    return found_columns(discovery.discover(docfiles(spark, sf), recursive=True))


def discover_root(spark, sf):
    return found_columns(discovery.discover(docfiles(spark, sf)))


def discover_patterns(spark, sf):
    return found_columns(discovery.discover(docfiles(spark, sf), INCLUDE, EXCLUDE, recursive=True))


def gitignore_filter(spark, sf):
    files = docfiles(spark, sf).drop("content")
    text = F.create_map(*[F.lit(x) for pair in IGNORE.items() for x in pair])[F.col("corpus_id")]
    rules = files.select("corpus_id").distinct().select("corpus_id", text.alias("content"))
    return discovery.drop_ignored(files, rules).select(*FILE)


def files_from_pages(spark, sf):
    pages = spread(table(spark, sf, "pages"), "page_id")
    address = F.split(F.regexp_replace("url", "[?#].*", ""), "://")[1]
    files = from_table(
        pages.withColumn("_site", F.substring_index(address, "/", 1)).withColumn("_path", address),
        corpus_id=F.col("_site"),
        path=F.concat(F.lit("/"), F.col("_path"), F.lit("/"), F.col("page_id"), F.lit(".html")),
        root=F.concat(F.lit("/"), F.col("_site")),
        content=F.col("html"),
    )
    return files.select(
        "corpus_id", "rel_path", "filename", "extension", "size_bytes", paths.safe_id(F.col("file_path")).alias("id")
    )


def decoded_text(spark, sf):
    """Texts as one-byte-per-letter bytes: every accented letter is broken UTF-8 followed by plain text."""
    documents = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    spaced = F.regexp_replace(F.regexp_replace("text", "[^\\x00-\\xFF]", "?"), "([\\x80-\\xFF])", "$1.")
    broken = decode_text(F.encode(spaced, "ISO-8859-1"))
    return documents.select("doc_id", F.md5(broken).alias("text_md5"), F.length(broken).alias("letters"))


def line_counts(spark, sf):
    return chunks.line_counts(docfiles(spark, sf)).select(*FILE, "total_lines", "significant_lines", "progress_lines")


def running_significant(spark, sf):
    return chunks.lines(docfiles(spark, sf)).select(
        *FILE, "line_no", "is_sig", "sig_so_far", F.md5("line").alias("line_md5")
    )


def chunk_columns(cut: DataFrame, *more: str) -> DataFrame:
    return cut.select(*FILE, "chunk_no", "start_line", "end_line", "eof", *more, F.md5("content").alias("content_md5"))


def chunk_fixed(spark, sf):
    return chunk_columns(chunks.chunk_fixed(docfiles(spark, sf), 50))


def chunk_significant(spark, sf):
    return chunk_columns(chunks.chunk_significant(docfiles(spark, sf), 8), "reported_end_line", "n_sig", "total_lines")


def chunk_disjoint(spark, sf):
    return chunk_columns(
        chunks.chunk_significant(docfiles(spark, sf), 8, overlap=0), "reported_end_line", "n_sig", "total_lines"
    )


def chunks_per_file(spark, sf):
    """How many chunks and significant lines does each file give?"""
    files = discovery.discover(docfiles(spark, sf), recursive=True)
    cut = chunks.chunk_significant(files, SIZE, overlap=0, content=False)
    return cut.groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.sum("n_sig").alias("significant_lines"),
        F.max("total_lines").alias("total_lines"),
    )


def oversized_files(spark, sf):
    return chunks.mark_oversized(docfiles(spark, sf), CONTEXT).select(*FILE, "estimated_tokens", "oversized_file")


MODELS = (
    "llama3:8b", "LLAMA2:7b", "mistral", "mixtral:8x7b", "qwen:4b", "phi3:mini", "gemma:2b", "qwen2:7b",
    "qwen2.5-coder:14b", "codellama:13b", "vicuna", "wizardcoder", "foo", "other:1b",
)


def context_length_lookup(spark, sf):
    names = F.array(*[F.lit(m) for m in MODELS])
    used = table(spark, sf, "documents").select(F.get(names, F.col("doc_id") % len(MODELS)).alias("model"))
    return used.select("model", chunks.context_length(F.col("model")).alias("context_length")).groupBy(
        "model", "context_length"
    ).agg(F.count(F.lit(1)).alias("files"))


def prompt_columns(cut: DataFrame) -> DataFrame:
    return cut.select(*FILE, "chunk_no", "structural_only", F.length("prompt").alias("letters"), "prompt_hash")


def chunk_prompts(spark, sf):
    return prompt_columns(analyze.chunk_files(docfiles(spark, sf), SIZE, context=CONTEXT))


def chunk_prompts_classes_only(spark, sf):
    return prompt_columns(
        analyze.chunk_files(docfiles(spark, sf), SIZE, context=CONTEXT, functions=False, dependencies=False)
    )


def chunk_entities(spark, sf):
    return analyze.analyze_rules(codefiles(spark, sf), SIZE, context=CONTEXT).select(
        *FILE, "chunk_no", "description", joined("classes"), joined("functions"), joined("dependencies"), "parse_route"
    )


def analysed(spark, sf, **options) -> DataFrame:
    return analyze.analyze_files(codefiles(spark, sf), size=SIZE, context=CONTEXT, **options)


def file_rollup(spark, sf):
    return analysed(spark, sf).select(
        *FILE, "total_lines", "chunks_analyzed", "has_errors", "oversized_file",
        joined("classes"), joined("functions"), joined("dependencies"), "summary",
    )


def file_sections(spark, sf):
    """Sorted distinct items of each section; dependencies are switched off and stay NULL."""
    files = analysed(spark, sf, dependencies=False)
    shown = files.select(*FILE, rollup.section(F.col("classes")).alias("c"), F.col("dependencies"))
    return shown.select(
        *FILE,
        F.array_join("c.items", "|").alias("classes"),
        F.col("c.has_items").alias("has_classes"),
        F.col("dependencies").isNull().alias("dependencies_off"),
    )


def summary_prompts(spark, sf):
    rolled = analysed(spark, sf)
    return model.add_summary_prompts(rolled).select(*FILE, F.length("prompt").alias("letters"), "prompt_hash")


BAD, LATE, SLOW = 7, 11, 13


def counting_provider():
    """A stand-in for a model: tells the prompt's length; fails on some lengths, answers others late."""
    seen = set()

    def client(prompts, timeout):
        answers = []
        for prompt in prompts:
            size = len(prompt)
            if size % BAD == 0:
                answers.append(ValueError("bad prompt"))
            elif size % LATE == 0 or (size % SLOW == 0 and prompt not in seen):
                seen.add(prompt)
                answers.append(TimeoutError("late"))
            else:
                answers.append('{"description": "%d letters", "classes": [], "functions": []}' % size)
        return answers

    return client


def infer_responses(spark, sf):
    """Prompts through a cached provider with retries, replies back onto every chunk."""
    cut = materialise(
        analyze.chunk_files(docfiles(spark, sf), SIZE, context=CONTEXT).select(*FILE, "chunk_no", "prompt", "prompt_hash")
    )
    store = work_folder(spark, "responses")
    answers = analyze.answer(cut, store, counting_provider, pause=0.0)
    attached = rollup.attach_responses(cut.drop("prompt"), answers)
    done = model.normalise_replies(attached).join(answers.select("prompt_hash", "attempts"), "prompt_hash")
    return done.select(*FILE, "chunk_no", "description", "parse_route", "error", "attempts")


def healthy_provider():
    """The stand-in again, after its outage."""
    return lambda prompts, timeout: [
        '{"description": "again %d letters", "classes": [], "functions": []}' % len(prompt) for prompt in prompts
    ]


def retry_after_failure(spark, sf):
    """Prompts that failed are asked again in the next run; good answers are not."""
    cut = materialise(
        analyze.chunk_files(docfiles(spark, sf), SIZE, context=CONTEXT).select(*FILE, "chunk_no", "prompt", "prompt_hash")
    )
    store = work_folder(spark, "responses")
    analyze.answer(cut, store, counting_provider, wave=1000, pause=0.0)
    answers = analyze.answer(cut, store, healthy_provider)
    done = model.normalise_replies(rollup.attach_responses(cut.drop("prompt"), answers))
    return done.select(*FILE, "chunk_no", "description", "error")


def summing_provider():
    """Another stand-in: a class named by the prompt's length, or a summary; fails on some lengths."""

    def answer(prompt: str):
        if len(prompt) % BAD == 0:
            return ValueError("bad prompt")
        if prompt.startswith("Summarise"):
            return "\n Sum %d \n" % len(prompt)
        return '{"description": "d", "classes": ["K%d"], "functions": [], "dependencies": []}' % len(prompt)

    return lambda prompts, timeout: [answer(p) for p in prompts]


def letters_embedder():
    return lambda texts: [[float(len(t)), 1.0] for t in texts]


def model_run(spark, sf):
    """The whole run through a model and an own embedder: chunk replies, roll-up, summary replies, records, the
    store. Some files cannot be read, some prompts of either kind fail."""
    files = docfiles(spark, sf).withColumn("content", F.when(F.col("doc_id") % 9 != 0, F.col("content")))
    store = work_folder(spark, "store")
    done = analyze.analyze_files(files, summing_provider, store, size=SIZE, context=CONTEXT, pause=0.0)
    stores.write_records(analyze.collection_records(done, letters_embedder), store)
    held = stores.read_collections(spark, store)
    failed = search.metadata_filter(held, {"has_error": "true"}).select("collection", *FILE, F.lit(True).alias("_failed"))
    found = held.join(failed, ["collection", *FILE], "left")
    return found.select(
        "collection", *FILE, "document", "has_error", "error_message", F.coalesce("_failed", F.lit(False)).alias("found_by_filter"),
        F.col("embedding")[0].cast("int").alias("letters"),
    )


def reply_table(spark, sf) -> DataFrame:
    """Replies of every quality, made around the conversation texts."""
    said = spread(table(spark, sf, "conversations"), "conv_id").withColumn(
        "said", F.regexp_replace("text", r"[^\p{L}\p{N} ]", " ")
    )
    return said.selectExpr(
        "conv_id",
        "turn",
        r"""CASE WHEN role = 'system' THEN NULL
        WHEN turn % 4 = 0 THEN 'Here it is: {"description": "' || said || '", "classes": ["K' || conv_id || ': holds"], "dependencies": []} That is all.'
        WHEN turn % 4 = 1 THEN 'Sure.' || chr(10) || '```json' || chr(10) || '{"classes": ["**A' || conv_id || '**"], "description": "says: ' || said || '", "functions": ["f' || turn || '()": "does", "g() -> int": "gives"], "dependencies": ["k": "v", "os"]}' || chr(10) || '```' || chr(10) || 'Done.'
        WHEN turn % 4 = 2 THEN '{"description": "' || said || '", "classes": [}'
        ELSE said END AS response""",
        "CASE WHEN role = 'system' THEN 'Test error' END AS error",
    )


def reply_normalize(spark, sf):
    return model.normalise_replies(reply_table(spark, sf)).select(
        "conv_id", "turn", "description", joined("classes"), joined("functions"), joined("dependencies"), "parse_route"
    )


def reply_text(spark, sf):
    """Text of replies that have it in one field, in another, or in none (their string form)."""
    said = table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.struct(
            F.when(F.col("turn") % 3 == 0, F.col("text")).alias("content"),
            F.when(F.col("turn") % 3 == 1, F.upper("role")).alias("prediction"),
            F.col("role"),
        ).alias("reply"),
    )
    return said.select(
        "conv_id", "turn", replies.reply_text(F.col("reply"), "content", "prediction").alias("answer")
    )


def clean_summaries(spark, sf):
    """Summaries with thinking, fences and unruly headings, cleaned."""
    texts = spread(table(spark, sf, "conversations"), "conv_id").selectExpr(
        "conv_id", "turn",
        """CASE turn % 4
        WHEN 0 THEN '<think>' || text || '</think># Title:' || chr(10) || text || chr(10) || '# Title' || chr(10) || '## Title' || chr(10) || 'end:'
        WHEN 1 THEN '```markdown' || chr(10) || '# A' || conv_id || chr(10) || text || chr(10) || '```' || chr(10) || 'after'
        WHEN 2 THEN '```' || chr(10) || text
        ELSE '```' || role || '```' END AS summary""",
    )
    return texts.select("conv_id", "turn", replies.clean_summary(F.col("summary")).alias("summary"))


RECORD = ["collection", "corpus_id", "rel_path", "id", "document", "name", "type", "extension", "total_lines",
          "has_error", "oversized_file"]


def entity_records(spark, sf):
    return rollup.to_records(analysed(spark, sf)).select(*RECORD)


def file_list_pages(spark, sf):
    files = discovery.discover(docfiles(spark, sf).drop("content"), recursive=True)
    return rollup.file_list_pages(files).select("corpus_id", "chunk", "id", F.md5("document").alias("document_md5"), "count")


def project_info(spark, sf):
    files = docfiles(spark, sf).drop("content")
    info = rollup.project_info(files, F.concat(F.lit("/"), F.col("corpus_id")))
    finished = rollup.finish_run(info, files.filter(F.col("corpus_id") < "c2"))
    return finished.select("corpus_id", "source_dir", "file_count", "completed")


def labelled(spark, sf, files: DataFrame) -> DataFrame:
    return files.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


def again(files: DataFrame) -> DataFrame:
    """A second analysis of files: classes are gone, the summary is new."""
    return files.withColumn("classes", F.expr("array()").cast("array<string>")).withColumn(
        "summary", F.concat(F.lit("again: "), "summary")
    )


def upsert_records(spark, sf):
    files = materialise(analysed(spark, sf))
    old = rollup.to_records(files)
    new = rollup.to_records(again(labelled(spark, sf, files)))
    return rollup.upsert(old, new).select(*RECORD)


def stored_upsert(spark, sf):
    """The same through the store: two generations written, read as one, folded, read again."""
    store = work_folder(spark, "store")
    files = materialise(analysed(spark, sf))
    stores.write_records(rollup.to_records(files), store)
    stores.write_records(rollup.to_records(again(labelled(spark, sf, files))), store)
    stores.compact(spark, store)
    return stores.read_collections(spark, store).select(*RECORD)


def label_after_compact(spark, sf):
    """A label written again after its first generation was folded, and below a newer one."""
    store = work_folder(spark, "store")
    files = materialise(analysed(spark, sf))
    stores.write_records(rollup.to_records(files), store, "batch")
    stores.write_records(rollup.to_records(files.filter(F.col("corpus_id") == "c1")), store)
    stores.compact(spark, store)
    stores.write_records(rollup.to_records(files.filter(F.col("corpus_id") == "c2")), store)
    stores.write_records(rollup.to_records(again(labelled(spark, sf, files))), store, "batch")
    return stores.read_collections(spark, store).select(*RECORD)


def changed_files_redone(spark, sf):
    """A run over files of which the labelled ones have changed since the run before."""
    files = codefiles(spark, sf)
    store = work_folder(spark, "store")
    old = F.when(F.col("_labelled"), F.concat(F.lit("class Old\n"), "content")).otherwise(F.col("content"))
    marks = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("_labelled")).distinct()
    before = files.join(marks, "doc_id", "left").withColumn("content", old).drop("_labelled")
    for version in (before, files):
        analyze.analyze_corpora(version, store, size=SIZE, context=CONTEXT, include=["*"], recursive=True, dim=DIM)
    return stores.read_collections(spark, store).select(*RECORD)


def walk_tree(spark, sf):
    """Documents as files in folders, listed, filtered by their ignore files and read back. Every corpus also
    holds an ``__init__.py`` and a link that leads back to its root."""
    folder = work_folder(spark, "tree").removeprefix("file:")
    rules = spark.createDataFrame(list(IGNORE.items()), "corpus_id string, content string")
    files = docfiles(spark, sf).select("corpus_id", "rel_path", "content")
    extra = rules.select("corpus_id", F.lit(".gitignore").alias("rel_path"), "content").union(
        rules.select("corpus_id", F.lit("pkg/__init__.py"), F.lit("import os\n"))
    )

    def write(rows):
        for row in rows:
            path = f"{folder}/{row.corpus_id}/{row.rel_path}"
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8", newline="") as file:
                file.write(row.content)
            if row.rel_path == ".gitignore":
                os.symlink(os.path.dirname(path), f"{os.path.dirname(path)}/loop")

    files.union(extra).foreachPartition(write)
    roots = rules.select("corpus_id", F.concat(F.lit(f"{folder}/"), "corpus_id").alias("root"))
    listed = walk(roots)
    own = discovery.ignore_files(read_content(listed.filter(F.col("filename") == discovery.IGNORE_FILE)))
    found = read_content(discovery.discover(listed, rules=own, recursive=True))
    return found.select(*FILE, F.md5("content").alias("content_md5"))


def collection_stats(spark, sf):
    return rollup.collection_stats(rollup.to_records(analysed(spark, sf)))


def remaining_files(spark, sf):
    files = docfiles(spark, sf).drop("content")
    return discovery.remaining(files, labelled(spark, sf, files)).select(*FILE)


def resume_split(spark, sf):
    """Files listed as remaining, split into those still there and those gone."""
    files = docfiles(spark, sf).drop("content")
    listed = files.select("corpus_id", F.when(F.col("doc_id") % 3 == 0, F.concat("rel_path", F.lit(".old"))).otherwise(F.col("rel_path")).alias("rel_path"))
    there = discovery.resumable(listed, files).withColumn("exists", F.lit(True))
    return there.unionByName(discovery.vanished(listed, files).withColumn("exists", F.lit(False)))


def run_counts(spark, sf):
    files = docfiles(spark, sf).drop("content")
    return rollup.run_counts(files, labelled(spark, sf, files))


def vector_records(spark, sf) -> DataFrame:
    """The given vectors as collections, one per label."""
    return spread(table(spark, sf, "embeddings"), "vec_id").select(
        F.concat(F.lit("l"), "label").alias("collection"),
        F.lit("c0").alias("corpus_id"),
        F.concat(F.lit("v"), "vec_id").alias("rel_path"),
        F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("id"),
        "embedding",
    )


def centroids(records: DataFrame) -> DataFrame:
    """One query per label: the mean of its vectors."""
    means = records.select("collection", F.posexplode("embedding").alias("at", "x")).groupBy("collection", "at").agg(
        F.round(F.avg("x"), 6).cast("float").alias("x")
    )
    return means.groupBy("collection").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("embedding")
    ).select(F.col("collection").alias("query_id"), "embedding")


def hit_columns(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "collection", "id", F.col("rank"), (F.round("relevance_score", 6) + 0.0).alias("score"))


def scored(found: DataFrame) -> DataFrame:
    return hit_columns(found.withColumn("relevance_score", 1 - F.col("distance") / 2))


def knn_search(spark, sf):
    records = vector_records(spark, sf)
    return scored(search.knn(records, centroids(records), 10))


def knn_cells(spark, sf):
    """The same answers from a table cut into cells, reading only cells that matter."""
    records = vector_records(spark, sf)
    centres = search.fit_cells(records, 16)
    folder = work_folder(spark, "cells")
    search.assign_cells(records, centres).write.partitionBy("cell").parquet(folder)
    return scored(search.knn_cells(spark.read.parquet(folder), centres, centroids(records), 10))


def neighbour_distances(spark, sf):
    """Distance of every vector to the mean of its label, as a plain expression."""
    records = vector_records(spark, sf)
    means = centroids(records).select(F.col("query_id").alias("collection"), F.col("embedding").alias("mean"))
    return lookup_join(records, means, ["collection"], ["id"], "inner").select(
        "id", "collection", F.round(squared_distance(F.col("embedding"), F.col("mean")), 6).alias("distance")
    )


def text_records(spark, sf) -> DataFrame:
    """Whole documents as one collection of summaries."""
    return embed(
        docfiles(spark, sf).select(
            F.lit("file_summaries").alias("collection"), *FILE, paths.safe_id(F.col("file_path")).alias("id"),
            F.col("content").alias("document"), "extension", (F.col("doc_id") % 5 == 0).alias("has_error"),
        ),
        "document",
        dim=DIM,
    )


def snippets(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def similar_topn(spark, sf):
    return hit_columns(
        search.find_similar(text_records(spark, sf), snippets(spark, sf), 25, "file_summaries", dim=DIM, content=False)
    )


def similar_many_snippets(spark, sf):
    """As ``similar_topn`` on the way taken when there are too many queries to broadcast."""
    queries = embed(snippets(spark, sf), "text", dim=DIM)
    found = search.knn(text_records(spark, sf), queries, 25, block=16)
    return scored(found)


def similar_many_by_cells(spark, sf):
    """The same, each snippet sent to the cells that could hold one of its hits."""
    records = materialise(text_records(spark, sf).drop("document"))  # read three times, embedded once
    centres = search.fit_cells(records, 16)
    folder = work_folder(spark, "cells")
    search.assign_cells(records, centres).write.parquet(folder)
    queries = embed(snippets(spark, sf), "text", dim=DIM)
    return scored(search.knn_cells(spark.read.parquet(folder), centres, queries, 25, block=16))


def search_filtered(spark, sf):
    """Metadata filters: one given as text for a boolean column."""
    return hit_columns(
        search.search(
            text_records(spark, sf), snippets(spark, sf), 30, filters={"extension": ".py", "has_error": "false"},
            per_collection_cap=config.PER_COLLECTION_CAP, dim=DIM, content=False,
        )
    )


def search_uncapped(spark, sf):
    """As many of one collection as are asked for."""
    return hit_columns(search.search(text_records(spark, sf), snippets(spark, sf), 30, dim=DIM, content=False))


def own_corpus(queries: DataFrame) -> DataFrame:
    """Every query belongs to one corpus; one in ten to a corpus that is not there."""
    number = F.pmod(F.col("query_id"), F.lit(10))
    return queries.withColumn("corpus_id", F.concat(F.lit("c"), F.when(number == 9, 9).otherwise(number % 3).cast("string")))


def search_per_corpus(spark, sf):
    """A batch of queries, each in a corpus of its own: by broadcast, and in blocks as for very many queries."""
    queries = own_corpus(embed(snippets(spark, sf), "text", dim=DIM))
    few = search.search(text_records(spark, sf), queries, 12, dim=DIM, content=False).withColumn("way", F.lit("broadcast"))
    many = search.knn(text_records(spark, sf), queries, 12, block=16)
    many = many.withColumn("relevance_score", 1 - F.col("distance") / 2).withColumn("way", F.lit("blocks"))
    columns = ["way", "corpus_id", "query_id", "collection", "id", "rank", "relevance_score"]
    found = few.select(columns).unionByName(many.select(columns))
    return found.select(*columns[:-1], (F.round("relevance_score", 6) + 0.0).alias("score"))


def stored_collections(spark, sf) -> DataFrame:
    store = work_folder(spark, "store")
    stores.write_records(analyze.collection_records(analysed(spark, sf), dim=DIM), store)
    return stores.read_collections(spark, store)


def search_text(spark, sf):
    """All collections, best 30 of at most 20 each, with the documents found."""
    hits = search.search(stored_collections(spark, sf), snippets(spark, sf), 30, per_collection_cap=config.PER_COLLECTION_CAP, dim=DIM)
    return hits.select(
        "query_id", "collection", *FILE, "id", "rank", (F.round("relevance_score", 6) + 0.0).alias("score"), "document", "name"
    )


def search_indexed(spark, sf):
    """As ``search_text`` through the cells of the store, some files of which were written again later."""
    store = work_folder(spark, "store")
    records = materialise(analyze.collection_records(analysed(spark, sf), dim=DIM))
    stores.write_records(records, store)
    stores.build_index(spark, store, cells=24)
    stores.write_records(records.filter(F.pmod(F.xxhash64("rel_path"), F.lit(3)) == 0), store)
    hits = search.search(
        stores.read_collections(spark, store), snippets(spark, sf), 30, per_collection_cap=config.PER_COLLECTION_CAP, dim=DIM,
        index=stores.read_index(spark, store),
    )
    return hits.select(
        "query_id", "collection", *FILE, "id", "rank", (F.round("relevance_score", 6) + 0.0).alias("score"), "document", "name"
    )


def search_by_type(spark, sf):
    return hit_columns(
        search.search_by_type(
            stored_collections(spark, sf), snippets(spark, sf), "class", 10, dim=DIM, content=False
        )
    )


def asked_paths(files: DataFrame) -> DataFrame:
    """Paths asked in three forms, some of them unknown."""
    path = (
        F.when(F.col("doc_id") % 4 == 0, F.col("file_path"))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("/elsewhere/"), "filename"))
        .when(F.col("doc_id") % 4 == 2, F.translate("file_path", "/", "."))
        .otherwise(F.col("rel_path"))
    )
    return files.select("corpus_id", path.alias("path"))


def plain_records(files: DataFrame) -> DataFrame:
    """One summary and one class record per file, straight from the listing."""
    listed = files.select(
        "*", F.concat(F.lit("about "), "rel_path").alias("summary"), F.lit(None).cast("string").alias("error"),
        F.lit(False).alias("has_errors"), F.lit(False).alias("oversized_file"), F.lit(1).alias("total_lines"),
        F.array(F.concat(F.lit("K"), "doc_id", F.lit(": of "), "filename")).alias("classes"),
        F.expr("cast(array() AS array<string>)").alias("functions"), F.lit(None).cast("array<string>").alias("dependencies"),
    )
    return rollup.to_records(listed)


def file_summary(spark, sf):
    files = docfiles(spark, sf).drop("content")
    return lookup.file_summary(plain_records(files), asked_paths(files)).select(
        "corpus_id", "path", "found_by", "rel_path", "summary"
    )


def file_details(spark, sf):
    files = docfiles(spark, sf).drop("content")
    asked = files.select("corpus_id", F.when(F.col("doc_id") % 2 == 0, F.col("rel_path")).otherwise(F.col("filename")).alias("path"))
    return lookup.file_details(plain_records(files), asked).select(*FILE, "section", "id", "content", "name")


def file_details_by_name(spark, sf):
    files = docfiles(spark, sf).drop("content")
    asked = files.select("corpus_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x/"), "filename")).otherwise(F.lit("y")).alias("path"))
    return lookup.file_details(plain_records(files), asked, by="filename").select(*FILE, "section", "id", "content", "name")


def list_files(spark, sf):
    return lookup.list_files(plain_records(docfiles(spark, sf).drop("content")))


def basename_counts(spark, sf):
    return graph.basename_counts(docfiles(spark, sf).drop("content"))


def import_edges(spark, sf):
    return graph.import_edges(docfiles(spark, sf))


def with_entry(files: DataFrame) -> DataFrame:
    """Some files of every corpus but one are named as entry points."""
    renamed = F.when(
        (F.col("filename") == "doc_40.py") & (F.col("corpus_id") != "c1"), F.regexp_replace("rel_path", r"[^/]+\z", "cli.py")
    ).otherwise(F.col("rel_path"))
    moved = files.withColumn("rel_path", renamed)
    return moved.withColumn("filename", paths.filename(F.col("rel_path"))).withColumn(
        "file_path", F.concat(F.lit("/"), "corpus_id", F.lit("/"), "rel_path")
    )


def graph_nodes(spark, sf):
    return graph.graph_nodes(with_entry(docfiles(spark, sf).drop("content"))).drop("node_no")


def graph_lines(spark, sf):
    files = with_entry(docfiles(spark, sf))
    nodes = materialise(graph.graph_nodes(files.drop("content")))
    return graph.graph_lines(nodes, materialise(graph.import_edges(files)))


def file_report(spark, sf):
    return report.file_report(analysed(spark, sf))


def file_report_errors(spark, sf):
    """Reports where some files failed and functions are switched off."""
    files = codefiles(spark, sf).withColumn("content", F.when(F.col("doc_id") % 9 != 0, F.col("content")))
    return report.file_report(analyze.analyze_files(files, size=SIZE, context=CONTEXT, functions=False))


def report_index(spark, sf):
    files = docfiles(spark, sf).drop("content")
    return report.report_index(discovery.remaining(files, labelled(spark, sf, files)))


def arriving(files: DataFrame, batches: int) -> DataFrame:
    """Files as a stream of ``batches`` micro-batches, all rows of a document in one of them. Each batch comes in as
    many Parquet files as there are tasks to write them, so none is written or read by one task alone."""
    spark, folder = files.sparkSession, work_folder(files.sparkSession, "arriving")
    files.repartition(batches * pieces(files), "doc_id").write.parquet(folder)
    held = len(spark.read.schema(files.schema).parquet(folder).inputFiles())
    return spark.readStream.schema(files.schema).option("maxFilesPerTrigger", max(1, -(-held // batches))).parquet(folder)


def stream_equals_batch(spark, sf):
    """Files arriving in several micro-batches, each in an old and a new version, give the batch result."""
    store = work_folder(spark, "store")
    files = codefiles(spark, sf)
    new = files.withColumn("modified_at", F.lit("2024-01-02").cast("timestamp"))
    old = files.withColumn("modified_at", F.lit("2024-01-01").cast("timestamp")).withColumn(
        "content", F.concat(F.lit("class Old\n"), "content")
    )
    incremental.analyze_stream(
        arriving(new.unionByName(old), 4), work_folder(spark, "stream"), incremental.store_sink(store, dim=DIM), size=SIZE, context=CONTEXT
    ).awaitTermination()
    return stores.read_collections(spark, store).select(*RECORD)


def two_streams_one_store(spark, sf):
    """Two streams of their own checkpoints write their halves into one store."""
    store = work_folder(spark, "store")
    files = codefiles(spark, sf).withColumn("modified_at", F.lit("2024-01-02").cast("timestamp"))
    for half in range(2):
        incremental.analyze_stream(
            arriving(files.filter(F.col("doc_id") % 2 == half), 2), work_folder(spark, "stream"),
            incremental.store_sink(store, dim=DIM), size=SIZE, context=CONTEXT,
        ).awaitTermination()
    incremental.finish(spark, store, rollup.project_info(files, F.lit("/")))
    return stores.read_collections(spark, store).select(*RECORD)


def stream_finish(spark, sf):
    """What ``finish`` tells after a stream: corpora marked complete, and records per collection."""
    store = work_folder(spark, "store")
    files = codefiles(spark, sf)
    incremental.analyze_stream(
        arriving(files, 2), work_folder(spark, "stream"), incremental.store_sink(store, dim=DIM), order=None, size=SIZE, context=CONTEXT
    ).awaitTermination()
    info, held = incremental.finish(spark, store, rollup.project_info(files, F.lit("/r")))
    corpora = info.select(
        F.lit("corpus").alias("kind"), F.col("corpus_id").alias("name"), F.col("file_count").alias("n"), "completed",
        F.col("completion_date").isNotNull().alias("dated"),
    )
    records = held.select(
        F.lit("collection").alias("kind"), F.col("collection").alias("name"), F.col("records").alias("n"),
        F.lit(None).cast("boolean").alias("completed"), F.lit(None).cast("boolean").alias("dated"),
    )
    return corpora.unionByName(records)


def rejected_records(spark, sf):
    """Files whose path is blank or missing give no records and are told apart with a reason."""
    path = F.when(F.col("doc_id") % 14 == 0, F.lit("")).when(F.col("doc_id") % 7 != 0, F.col("file_path"))
    files = analysed(spark, sf).withColumn("file_path", path)
    kept = rollup.to_records(files).select(*RECORD, F.lit(None).cast("string").alias("reason"))
    rejected = rollup.rejected_files(files).select(
        F.lit("rejected").alias("collection"), *FILE, F.col("summary").alias("document"), F.col("extension"), "reason"
    )
    return kept.unionByName(rejected, allowMissingColumns=True)


def project_info_lookup(spark, sf):
    """The project row of one corpus, looked up in the store after a run over all of them."""
    store, files = work_folder(spark, "store"), docfiles(spark, sf).drop("content")
    stores.write_records(rollup.to_records(analysed(spark, sf)), store)
    analyze.start_run(files, store)
    analyze.end_run(spark, store, files.filter(F.col("corpus_id") == "c1"))
    info = stores.read_table(spark, store, stores.PROJECTS)
    found = lookup.project_info(info, "c1").unionByName(lookup.project_info(info, "c2")).unionByName(lookup.project_info(info, "none"))
    return found.select("corpus_id", "source_dir", "file_count", "completed")


def own_analyzer(spark, sf):
    """An analyzer of one's own in place of the rules: one class per chunk, named by its size."""
    def analyzer(cut: DataFrame) -> DataFrame:
        none = F.array().cast("array<string>")
        return cut.select(
            "*", F.lit(None).cast("string").alias("error"),
            F.when(F.col("chunk_no").isNotNull(), F.array(F.concat(F.lit("Size"), F.length("content")))).otherwise(none).alias("classes"),
            none.alias("functions"), F.array(F.lit("import own")).alias("dependencies"),
        ).drop("content", "prompt")

    done = analyze.analyze_files(docfiles(spark, sf), size=SIZE, context=CONTEXT, analyzer=analyzer)
    return rollup.to_records(done).filter("collection <> 'file_summaries'").select(
        "collection", *FILE, "document", "name", "type"
    )


def report_sink_rows(spark, sf):
    """Two sinks on one analysis, the report sink written twice under one name: each file's report once."""
    folder, store = work_folder(spark, "reports"), work_folder(spark, "store")
    sink = incremental.all_of(incremental.store_sink(store, dim=DIM), incremental.report_sink(folder))
    files = materialise(analysed(spark, sf))
    for part in range(2):
        for _ in range(2):
            sink(files.filter(F.col("doc_id") % 2 == part), f"x.{part}")
    return spark.read.parquet(f"{folder}/reports").select(*FILE, "report")


def late_old_version(spark, sf):
    """Old versions of all files arrive in a later micro-batch than the new ones, in a stream that goes on."""
    store, folder, checkpoint = (work_folder(spark, name) for name in ("store", "arriving", "stream"))
    files = codefiles(spark, sf)
    new = files.withColumn("modified_at", F.lit("2024-01-02").cast("timestamp"))
    old = files.withColumn("modified_at", F.lit("2024-01-01").cast("timestamp")).withColumn(
        "content", F.concat(F.lit("class Old\n"), "content")
    )
    for version in (new, old):
        version.write.mode("append").parquet(folder)  # without a limit, all that is new is one micro-batch
        incremental.analyze_stream(
            spark.readStream.schema(new.schema).parquet(folder), checkpoint, incremental.store_sink(store, dim=DIM), size=SIZE, context=CONTEXT
        ).awaitTermination()
    return stores.read_collections(spark, store).select(*RECORD)


QUERIES = {
    f.__name__: f
    for f in (
        chunks_per_file, discover_files, discover_root, discover_patterns, gitignore_filter, files_from_pages,
        decoded_text, line_counts, running_significant, chunk_fixed, chunk_significant, chunk_disjoint,
        oversized_files, context_length_lookup, chunk_prompts, chunk_prompts_classes_only, chunk_entities,
        file_rollup, file_sections, summary_prompts, infer_responses, reply_normalize, reply_text,
        clean_summaries, entity_records, file_list_pages, project_info, upsert_records, stored_upsert,
        collection_stats, remaining_files, resume_split, run_counts, knn_search, knn_cells,
        neighbour_distances, similar_topn, similar_many_snippets, similar_many_by_cells, search_filtered, search_text, search_indexed,
        search_by_type, file_summary, file_details, file_details_by_name, list_files, basename_counts,
        import_edges, graph_nodes, graph_lines, file_report, file_report_errors, report_index,
        search_per_corpus, stream_finish, rejected_records, project_info_lookup, own_analyzer, report_sink_rows,
        stream_equals_batch, retry_after_failure, label_after_compact, changed_files_redone, walk_tree,
        search_uncapped, model_run, two_streams_one_store, late_old_version,
    )
}
