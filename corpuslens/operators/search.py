"""Nearest-record search over collections.

Distances are exact. Records are read once and never shuffled: each task keeps, per query and
collection, only its k best, so what leaves a task does not grow with the records. The query vectors
go to the tasks as a broadcast while they are few (counted first); a larger query table is matched
block by block in a shuffle instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from corpuslens import config
from corpuslens.functions.vectors import DIMENSIONS, Embedder, embed, relevance
from corpuslens.operators.skew import lookup_join, materialise

KEYS = ["corpus_id", "rel_path", "id"]
QUERIES_PER_BLOCK = 1024
RECORDS_PER_GROUP = 100_000
QUERIES_PER_CELL = 16_384  # of one cell in a group: records are sent once more only beyond that
CELLS_AT_ONCE = 2_000_000  # distances held at once in a task: 16 MB
CANDIDATES_AT_ONCE = 50_000
MAX_BROADCAST_HITS = 100_000
RANGES = 256  # of paths in the filter that fetches what was found
DIGITS = 9
LOOSE = -1  # the cell of records that no cell holds yet: always searched
METADATA_NAMES = {"class_name": "name", "function_name": "name", "module_name": "name"}


class Cells(NamedTuple):
    """Records cut into cells. ``rows``: what ``knn`` takes and ``cell``; ``centres``: a vector for each cell;
    ``radii``: by collection and cell the distance of its farthest record, one entry for each that holds any."""

    rows: DataFrame
    centres: list
    radii: dict


def _thin(piece, rows, vectors, k: int):
    """``rows`` without copies that cannot matter: of one vector, only the k first by key can be hits.

    A hot group of copies would otherwise tie for every query.
    """
    import numpy as np
    import pyarrow as pa

    if len(rows) <= k:
        return rows
    bits = np.ascontiguousarray(vectors[rows]).view(np.uint32).astype(np.uint64)
    mixed = (bits * (2 * np.arange(bits.shape[1], dtype=np.uint64) + 0x9E3779B97F4A7C15)).sum(axis=1)
    _, which, count = np.unique(mixed, return_inverse=True, return_counts=True)
    if count.max() <= k:
        return rows
    keep = np.ones(len(rows), dtype=bool)
    for hot in np.nonzero(count > k)[0]:
        at = np.nonzero(which == hot)[0]
        if (bits[at] != bits[at[0]]).any():
            continue  # different vectors under one mix: left alone
        keys = piece.select(KEYS).take(pa.array(rows[at]))
        first = pa.Table.from_batches([keys]).append_column("at", pa.array(at)).sort_by([(c, "ascending") for c in KEYS])
        keep[at] = False
        keep[first.column("at").to_numpy()[:k]] = True
    return rows[keep]


def _best(batches: Iterator, query_ids: list, points, k: int, schema, corpora: list | None = None):
    """The k nearest rows per query and collection among ``batches`` of Arrow records. With ``corpora``, the
    corpus of each query, a query sees the records of its corpus alone.

    A matrix product finds candidates within rounding of the k-th best; candidates are then measured
    one by one to DIGITS decimals, and ties go by key, so the outcome does not depend on how rows are
    batched or summed.
    """
    import numpy as np
    import pyarrow as pa

    points_sq = (points * points).sum(axis=1)
    step = max(1, CELLS_AT_ONCE // len(query_ids))
    kept: dict = {}  # collection and corpus -> tables of candidates: query, distance and the record's key
    bound: dict = {}  # collection and corpus -> k-th best distance per query so far
    everything = np.arange(len(query_ids))
    of_corpus: dict = {}
    for at, corpus in enumerate(corpora or []):
        of_corpus.setdefault(corpus, []).append(at)
    of_corpus = {corpus: np.array(places) for corpus, places in of_corpus.items()}

    def parts(piece):
        """The rows of each collection (and corpus), and the queries that see them."""
        groups = piece.column("collection").dictionary_encode()
        codes = groups.indices.to_numpy(zero_copy_only=False)
        if corpora is not None:
            owners = piece.column("corpus_id").dictionary_encode()
            owner = owners.indices.to_numpy(zero_copy_only=False)
            wanted = {c: of_corpus[name] for c, name in enumerate(owners.dictionary.to_pylist()) if name in of_corpus}
        for code, group in enumerate(groups.dictionary.to_pylist()):
            if corpora is None:
                yield (group, None), np.nonzero(codes == code)[0], everything
                continue
            for c, places in wanted.items():
                rows = np.nonzero((codes == code) & (owner == c))[0]
                if len(rows):
                    yield (group, owners.dictionary[c].as_py()), rows, places

    def cut(group) -> pa.Table:
        """Candidates in order, at most k per query; the k-th best becomes the bound."""
        ordered = pa.concat_tables(kept[group]).sort_by([(c, "ascending") for c in ("query", "distance", *KEYS)])
        query = ordered.column("query").to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query)
        ordered = ordered.filter(pa.array(place < k))
        kept[group] = [ordered]
        last = place == k - 1
        bound[group][query[last]] = ordered.column("distance").to_numpy()[place[place < k] == k - 1]
        return ordered

    for batch in batches:
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            flat = piece.column("embedding").flatten().to_numpy(zero_copy_only=False)
            vectors = flat.reshape(piece.num_rows, -1).astype(np.float64)
            for group, rows, places in parts(piece):
                rows = _thin(piece, rows, flat.reshape(piece.num_rows, -1), k)
                part, seen, seen_sq = vectors[rows], points[places], points_sq[places]
                part_sq = (part * part).sum(axis=1)
                near = part_sq[:, None] + seen_sq[None, :] - 2.0 * (part @ seen.T)
                slack = 4e-9 * (1.0 + part_sq.max() + seen_sq.max())
                limit = bound.setdefault(group, np.full(len(places), np.inf))
                if len(rows) > k and not np.isfinite(limit).all():
                    limit = np.minimum(limit, np.partition(near, k - 1, axis=0)[k - 1])
                r, q = np.nonzero(near <= limit + slack)
                for start in range(0, len(r), CANDIDATES_AT_ONCE):
                    some, of = r[start : start + CANDIDATES_AT_ONCE], q[start : start + CANDIDATES_AT_ONCE]
                    gaps = part[some] - seen[of]
                    key = piece.select(KEYS).take(pa.array(rows[some]))
                    found = {
                        "query": pa.array(of, pa.int32()),
                        "distance": pa.array(np.round(np.einsum("ij,ij->i", gaps, gaps), DIGITS)),
                    }
                    kept.setdefault(group, []).append(pa.table({**found, **{c: key.column(c) for c in KEYS}}))
                    if sum(map(len, kept[group])) > 4 * k * len(places):
                        cut(group)
    for group in kept:
        found = cut(group)
        places = everything if corpora is None else of_corpus[group[1]]
        yield pa.RecordBatch.from_pydict(
            {
                "query_id": pa.array([query_ids[places[i]] for i in found["query"].to_pylist()], schema.field("query_id").type),
                "collection": pa.array([group[0]] * len(found), schema.field("collection").type),
                **{key: found[key].combine_chunks().cast(schema.field(key).type) for key in KEYS},
                "distance": found["distance"].combine_chunks(),
            },
            schema=schema,
        )


def first_queries(queries: DataFrame, block: int = QUERIES_PER_BLOCK) -> list:
    """At most ``block + 1`` query rows come to the driver: enough to know whether there are few."""
    columns = [c for c in ("query_id", "embedding", "corpus_id") if c in queries.columns]
    return queries.select(columns).filter(F.col("embedding").isNotNull()).limit(block + 1).collect()


def knn(
    records: DataFrame, queries: DataFrame, k: int, block: int = QUERIES_PER_BLOCK, few: list | None = None
) -> DataFrame:
    """The k nearest records of each collection for each query: squared L2, nearest first.

    ``records``: collection, corpus_id, rel_path, id, embedding. ``queries``: query_id, embedding, and a
    corpus_id if each is to see the records of its own corpus alone (NULL sees none).
    Gives query_id, collection, the record's key, distance and rank.
    """
    if k < 1:
        raise ValueError("k begins at 1")
    spark = records.sparkSession
    own = "corpus_id" in queries.columns
    records = records.select("collection", *KEYS, "embedding").filter(F.col("embedding").isNotNull())
    queries = queries.select("query_id", "embedding", *["corpus_id"] * own).filter(F.col("embedding").isNotNull())
    if own:
        queries = queries.filter("corpus_id IS NOT NULL")
    out, arrow_schema = _found_schema(records, queries)
    few = first_queries(queries, block) if few is None else few
    if own and len(few) <= block:
        few = [row for row in few if row["corpus_id"] is not None]
    if not few:
        return spark.createDataFrame([], out).withColumn("rank", F.lit(0))
    if len(few) <= block:
        import numpy as np

        corpora = [row["corpus_id"] for row in few] if own else None
        shared = spark.sparkContext.broadcast(
            ([row["query_id"] for row in few], np.array([row["embedding"] for row in few], dtype=np.float64), corpora)
        )
        if own:  # reaches the scan
            records = records.filter(F.col("corpus_id").isin(sorted(set(corpora))))

        def nearest(batches):
            query_ids, points, corpora = shared.value
            yield from _best(batches, query_ids, points, k, arrow_schema, corpora)

        found = records.mapInArrow(nearest, out)
    else:
        if own:
            queries = queries.withColumnRenamed("corpus_id", "_scope")
            records = records.withColumn("_scope", F.col("corpus_id"))
        found = _knn_blocks(records, queries, k, block, out, arrow_schema)
    # each task gave its k best at most: the combining step
    order = Window.partitionBy("query_id", "collection").orderBy("distance", *KEYS)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _found_schema(records: DataFrame, queries: DataFrame):
    """What the tasks of a search give, for Spark and for Arrow."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType(
        [
            queries.schema["query_id"],
            *[records.schema[c] for c in ("collection", *KEYS)],
            T.StructField("distance", T.DoubleType()),
        ]
    )
    return out, to_arrow_schema(out)


def _knn_blocks(records, queries, k, block, out, arrow_schema) -> DataFrame:
    """Many queries: blocks of queries meet pieces of the records. A group is one block and one piece, of one
    ``_scope`` (corpus or cell) where the queries name theirs; a hot scope has many pieces."""
    count = lambda n, size: F.ceil(F.count(F.lit(1)) / size).cast("int").alias(n)
    if "_scope" in queries.columns:
        scope = ["_scope"]
        sizes = materialise(
            queries.groupBy("_scope").agg(count("_in_blocks", block)).join(records.groupBy("_scope").agg(count("_in_pieces", RECORDS_PER_GROUP)), "_scope")
        )
        queries = lookup_join(queries, sizes, scope, ["query_id"], "inner")
        records = lookup_join(records, sizes, scope, KEYS, "inner")
    else:
        scope = []
        sizes = [F.lit(-(-queries.count() // block)).alias("_in_blocks"), F.lit(-(-records.count() // RECORDS_PER_GROUP) or 1).alias("_in_pieces")]
        queries, records = queries.select("*", *sizes), records.select("*", *sizes)
    left = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.col("_in_blocks")).cast("int")).withColumn(
        "_piece", F.explode(F.sequence(F.lit(0), F.col("_in_pieces") - 1))
    )
    right = records.withColumn("_piece", F.pmod(F.xxhash64("collection", *KEYS), F.col("_in_pieces")).cast("int")).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.col("_in_blocks") - 1))
    )

    def nearest(asked, held):
        import numpy as np
        import pyarrow as pa

        if not asked.num_rows or not held.num_rows:
            return arrow_schema.empty_table()
        ids = asked.column("query_id").to_pylist()
        points = asked.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        points = points.reshape(len(ids), -1).astype(np.float64)
        return pa.Table.from_batches(
            list(_best(iter(held.to_batches()), ids, points, k, arrow_schema)), arrow_schema
        )

    by = [*scope, "_block", "_piece"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(nearest, out)


def choose_collections(records: DataFrame, collection: str, allowed=config.COLLECTIONS) -> DataFrame:
    """``all`` or one name; an unknown name gives no rows. A partition filter on the stored table."""
    names = list(allowed) if collection == "all" else [collection] if collection in allowed else []
    return records.filter(F.col("collection").isin(names)) if names else records.filter(F.lit(False))


def metadata_filter(records: DataFrame, filters: Mapping[str, object] | None) -> DataFrame:
    """Equality on columns, values cast to the column's type; reaches the scan. Unknown keys, and values that
    the type cannot hold, match nothing."""
    for key, value in (filters or {}).items():
        name = METADATA_NAMES.get(key, key)
        if name not in records.columns:
            return records.filter(F.lit(False))
        records = records.filter(F.col(name) == F.lit(value).try_cast(records.schema[name].dataType))
    return records


def _query_vectors(queries: DataFrame, embedder: Embedder | None, dim: int) -> DataFrame:
    return queries if "embedding" in queries.columns else embed(queries, "text", embedder, dim=dim)


def search(
    collections: DataFrame,
    queries: DataFrame,
    n: int = 10,
    collection: str = "all",
    filters: Mapping[str, object] | None = None,
    per_collection_cap: int | None = None,
    embedder: Embedder | None = None,
    dim: int = DIMENSIONS,
    content: bool = True,
    index: Cells | None = None,
) -> DataFrame:
    """Best ``n`` records per query over the chosen collections, most relevant first.

    ``queries``: query_id with text or embedding, and a corpus_id if each is to search its own corpus alone.
    With a ``per_collection_cap`` (such as ``config.PER_COLLECTION_CAP``) each collection offers no more than that.
    With the ``index`` of the store only the cells that can hold a hit are read; the hits are the same.
    """
    pick = lambda held: metadata_filter(choose_collections(held, collection), filters)
    offered = n if per_collection_cap is None else min(n, per_collection_cap)
    index = index and index._replace(rows=pick(index.rows))
    return _top(pick(collections), _query_vectors(queries, embedder, dim), n, offered, content, index)


def _top(
    records: DataFrame, queries: DataFrame, n: int, per_collection: int, content: bool, index: Cells | None = None
) -> DataFrame:
    few = first_queries(queries)
    order = Window.partitionBy("query_id").orderBy("distance", "collection", *KEYS)
    near = knn(records, queries, per_collection, few=few) if index is None else knn_index(index, queries, per_collection, few=few)
    hits = (
        near.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .withColumn("relevance_score", relevance(F.col("distance")))
        .drop("distance")
    )
    if not content:
        return hits
    # Few queries have at most len(few) * n hits: broadcast, so that no document is shuffled, and their keys
    # reach the scan first: of what is stored, only row groups that can hold a hit are read.
    bounded = len(few) <= QUERIES_PER_BLOCK and len(few) * n <= MAX_BROADCAST_HITS
    records = records.drop("embedding")
    if bounded:
        hits = materialise(hits)
        records = _around(records, hits)
    return (F.broadcast(hits) if bounded else hits).join(records, ["collection", *KEYS])


def _around(records: DataFrame, hits: DataFrame) -> DataFrame:
    """Records whose keys may be among the hits: the collections, and as many ranges of corpus and path as fit a
    filter. Stored records lie in order of their files, so file and row group statistics prune by it."""
    keys = hits.select("collection", "corpus_id", "rel_path").distinct().orderBy("corpus_id", "rel_path").collect()
    if not keys:
        return records.filter(F.lit(False))
    by_corpus: dict = {}
    for row in keys:
        by_corpus.setdefault(row["corpus_id"], []).append(row["rel_path"])
    each = max(1, RANGES // len(by_corpus))
    near = F.lit(False)
    if len(by_corpus) > RANGES:
        near = F.col("corpus_id").isin(list(by_corpus))
    else:
        for corpus, held in by_corpus.items():
            if corpus is None or None in held:
                return records
            paths = sorted(set(held))
            size = -(-len(paths) // each)
            spans = [(paths[i], paths[min(i + size, len(paths)) - 1]) for i in range(0, len(paths), size)]
            within = _within(F.col("rel_path"), spans)
            near = near | ((F.col("corpus_id") == corpus) & within)
    return records.filter(F.col("collection").isin(sorted({row["collection"] for row in keys})) & near)


def _within(value: Column, spans: list) -> Column:
    """Whether a value lies in one of the ordered ``spans``. Halved at each step: a row meets few of them, and
    statistics prune as by a plain list."""
    if len(spans) == 1:
        low, high = spans[0]
        return (value == low) if low == high else value.between(low, high)
    middle = len(spans) // 2
    border = spans[middle][0]
    return ((value < border) & _within(value, spans[:middle])) | ((value >= border) & _within(value, spans[middle:]))


def search_by_type(collections: DataFrame, queries: DataFrame, type: str, n: int = 10, **options) -> DataFrame:
    """As ``search`` in the collection of one type; an unknown type gives no rows."""
    return search(collections, queries, n, config.TYPE_TO_COLLECTION.get(type, ""), **options)


def find_similar(
    collections: DataFrame,
    snippets: DataFrame,
    n: int = 5,
    collection: str = "functions",
    embedder: Embedder | None = None,
    dim: int = DIMENSIONS,
    content: bool = True,
    index: Cells | None = None,
) -> DataFrame:
    """The ``n`` nearest functions, classes or summaries per snippet; ``index`` as for ``search``."""
    pick = lambda held: choose_collections(held, "" if collection == "all" else collection, config.SIMILAR_COLLECTIONS)
    index = index and index._replace(rows=pick(index.rows))
    return _top(pick(collections), _query_vectors(snippets, embedder, dim), n, n, content, index)


def fit_cells(records: DataFrame, cells: int, seed: int = 7, per_cell: int = 256):
    """Cell centres from a sample of about ``per_cell`` rows per cell; they steer speed, never results."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = records.select("embedding").filter(F.col("embedding").isNotNull())
    share = min(1.0, cells * per_cell / max(vectors.count(), 1))
    sampled = vectors.sample(share, seed) if share < 1.0 else vectors
    model = KMeans(k=cells, seed=seed, maxIter=5, initMode="random").fit(sampled.select(array_to_vector("embedding").alias("features")))
    return model.clusterCenters()


def assign_cells(records: DataFrame, centres) -> DataFrame:
    """``cell`` and ``cell_distance`` (plain Euclidean) per record; write it partitioned by ``cell``."""
    import numpy as np

    shared = records.sparkSession.sparkContext.broadcast(np.array(centres, dtype=np.float64))
    schema = T.StructType(
        [*records.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("cell_distance", T.DoubleType())]
    )

    def place(batches):
        import numpy as np
        import pyarrow as pa

        points = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            vectors = flat.reshape(batch.num_rows, -1).astype(np.float64)
            near = (points * points).sum(axis=1)[None, :] - 2.0 * (vectors @ points.T)
            cell = near.argmin(axis=1)
            gap = np.sqrt(((vectors - points[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(gap)],
                names=[*batch.schema.names, "cell", "cell_distance"],
            )

    return records.filter(F.col("embedding").isNotNull()).mapInArrow(place, schema)


def cell_radii(cells: DataFrame) -> DataFrame:
    """``radius`` of each collection and cell of what ``assign_cells`` gives."""
    return cells.groupBy("collection", "cell").agg(F.max("cell_distance").alias("radius"))


def knn_cells(cells: DataFrame, centres, queries: DataFrame, k: int, probe: int = 4, block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """As ``knn_index`` on a table of cells whose radii are not kept beside it: they are read from the table."""
    radii = {(row["collection"], row["cell"]): row["radius"] for row in cell_radii(cells).collect()}  # a row a cell
    return knn_index(Cells(cells, centres, radii), queries, k, probe, block)


def in_cells(pairs: Iterable[tuple[str, int]], ranges: int = RANGES):
    """A filter for collections and cells that reaches the scan: equality and ranges. Cells between those asked
    for may pass it where the ranges run out."""
    by_collection: dict = {}
    for collection, cell in sorted(pairs):
        runs = by_collection.setdefault(collection, [])
        if runs and runs[-1][1] == cell - 1:
            runs[-1][1] = cell
        else:
            runs.append([cell, cell])
    each = max(1, ranges // max(len(by_collection), 1))
    wanted = F.col("cell") == LOOSE
    for collection, runs in by_collection.items():
        size = -(-len(runs) // each)
        spans = [(runs[i][0], runs[min(i + size, len(runs)) - 1][1]) for i in range(0, len(runs), size)]
        within = F.lit(False)
        for low, high in spans:
            within = within | ((F.col("cell") == low) if low == high else F.col("cell").between(low, high))
        wanted = wanted | ((F.col("collection") == collection) & within)
    return wanted


def knn_index(
    index: Cells, queries: DataFrame, k: int, probe: int = 4, block: int = QUERIES_PER_BLOCK, few: list | None = None
) -> DataFrame:
    """As ``knn``, reading only the cells that can hold a neighbour, each of them once. Exact.

    First the ``probe`` cells nearest to each query are searched in each collection, which bounds its k-th
    distance there. A cell whose nearest possible record (centre distance minus radius) lies beyond the bounds
    of all queries is left out of the second search; all others are searched. A query that found fewer than k in a
    collection has no bound there, and skips nothing.

    More than ``block`` queries go to the cells themselves, by the same bounds, each for itself: queries are
    repeated for each cell that they need, records are not repeated for queries.
    """
    import numpy as np

    few = first_queries(queries, block) if few is None else few
    if len(few) > block and index.radii and "corpus_id" not in queries.columns:
        return _knn_by_cell(index, queries, k, probe)
    if not few or len(few) > block or not index.radii:
        return knn(index.rows, queries, k, block, few)
    points = np.array([row["embedding"] for row in few], dtype=np.float64)
    middle = np.array(index.centres, dtype=np.float64)
    gap = np.sqrt(((points[:, None, :] - middle[None, :, :]) ** 2).sum(axis=2))
    names = sorted({name for name, _ in index.radii})
    held = {name: np.array(sorted(cell for other, cell in index.radii if other == name)) for name in names}
    first = set()
    for name, cells in held.items():
        nearest = np.argsort(gap[:, cells], axis=1, kind="stable")[:, :probe]
        first |= {(name, int(cell)) for cell in np.unique(cells[nearest])}
    tried = materialise(knn(index.rows.filter(in_cells(first)), queries, k, block, few))
    bounds = (
        tried.groupBy("query_id", "collection")
        .agg(F.count(F.lit(1)).alias("held"), F.max("distance").alias("worst"))
        .filter(F.col("held") >= k)
        .collect()  # at most one row per query and collection
    )
    worst = {(row["query_id"], row["collection"]): (row["worst"] + 1e-8) ** 0.5 + 1e-8 for row in bounds}
    needed = set()
    for name, cells in held.items():
        limit = np.array([worst.get((row["query_id"], name), np.inf) for row in few])
        lowest = np.maximum(gap[:, cells] - np.array([index.radii[name, int(cell)] for cell in cells]), 0.0)
        needed |= {(name, int(cell)) for cell in cells[(lowest <= limit[:, None]).any(axis=0)]}
    if not needed - first:
        return tried
    # what the ranges of the first filter let in besides is left out by the second, so no record counts twice
    rest = index.rows.filter(~in_cells(first) & in_cells(needed - first))
    order = Window.partitionBy("query_id", "collection").orderBy("distance", *KEYS)
    both = tried.unionByName(knn(rest, queries, k, block, few)).withColumn("rank", F.row_number().over(order))
    return both.filter(F.col("rank") <= k)


def _to_cells(index: Cells, queries: DataFrame, probe: int) -> DataFrame:
    """A row for each query and cell (``_scope``) it has to look at. Without ``worst``: the ``probe`` nearest cells
    of each collection, and what is in no cell. With ``worst``, the squared distance of the k-th hit by collection in
    order of their names (NULL where there are fewer): the other cells that could hold a nearer one."""
    import numpy as np
    from pyspark.sql.pandas.types import to_arrow_schema

    names = sorted({name for name, _ in index.radii})
    held = [sorted((cell, radius) for (other, cell), radius in index.radii.items() if other == name) for name in names]
    shared = queries.sparkSession.sparkContext.broadcast(
        (np.array(index.centres, dtype=np.float64), [(np.array([c for c, _ in h]), np.array([r for _, r in h])) for h in held])
    )
    again = "worst" in queries.columns
    out = T.StructType([queries.schema["query_id"], queries.schema["embedding"], T.StructField("_scope", T.IntegerType())])
    arrow_schema = to_arrow_schema(out)

    def spread(batches):
        import numpy as np
        import pyarrow as pa

        centres, held = shared.value
        rows = max(1, CELLS_AT_ONCE // len(centres))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                points = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                gap = np.empty((part.num_rows, len(centres)))
                for i, point in enumerate(points):
                    gap[i] = np.sqrt(((centres - point) ** 2).sum(axis=1))
                first = np.zeros(gap.shape, dtype=bool)
                for cells, _ in held:
                    np.put_along_axis(first, cells[np.argsort(gap[:, cells], axis=1, kind="stable")[:, :probe]], True, axis=1)
                wanted = first
                if again:
                    worst = part.column("worst").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                    limit = np.where(np.isnan(worst), np.inf, np.sqrt(worst + 1e-8) + 1e-8)
                    wanted = np.zeros(gap.shape, dtype=bool)
                    for which, (cells, radii) in enumerate(held):
                        wanted[:, cells] |= np.maximum(gap[:, cells] - radii, 0.0) <= limit[:, which : which + 1]
                    wanted &= ~first
                row, cell = np.nonzero(wanted)
                if not again:
                    row, cell = np.append(row, np.arange(part.num_rows)), np.append(cell, np.full(part.num_rows, LOOSE))
                told = part.select(["query_id", "embedding"])
                for start in range(0, len(row), CANDIDATES_AT_ONCE):
                    some = told.take(pa.array(row[start : start + CANDIDATES_AT_ONCE]))
                    yield pa.RecordBatch.from_arrays(
                        [*some.columns, pa.array(cell[start : start + CANDIDATES_AT_ONCE].astype(np.int32))], schema=arrow_schema
                    )

    return queries.mapInArrow(spread, out)


def _knn_by_cell(index: Cells, queries: DataFrame, k: int, probe: int) -> DataFrame:
    """Many queries: each is sent to its own cells, in two rounds as ``knn_index`` does for few."""
    if k < 1:
        raise ValueError("k begins at 1")
    queries = queries.select("query_id", "embedding").filter(F.col("embedding").isNotNull())
    records = index.rows.select("collection", *KEYS, "embedding", F.col("cell").alias("_scope")).filter(F.col("embedding").isNotNull())
    out, arrow_schema = _found_schema(records, queries)
    order = Window.partitionBy("query_id", "collection").orderBy("distance", *KEYS)
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    near = lambda asked: _knn_blocks(records, asked, k, QUERIES_PER_CELL, out, arrow_schema)
    tried = materialise(ranked(near(_to_cells(index, queries, probe))))
    names = sorted({name for name, _ in index.radii})
    last = lambda name: F.max(F.when((F.col("collection") == name) & (F.col("rank") == k), F.col("distance")))
    bounds = tried.groupBy("query_id").agg(F.array(*[last(name) for name in names]).alias("worst"))
    none = F.array(*[F.lit(None).cast("double") for _ in names])
    asked = queries.join(bounds, "query_id", "left").withColumn("worst", F.coalesce("worst", none))
    return ranked(tried.drop("rank").unionByName(near(_to_cells(index, asked, probe))))
