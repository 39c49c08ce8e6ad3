"""The stored tables: plain Parquet folders.

Records are written as generations. A generation holds whole files: all records of each file it
touches. Writing one costs what the batch costs, never what the store holds. Of a file stored more
than once the newest version counts: the latest ``modified_at``, or the time of writing where none is
known; of equal versions the later generation. Every generation has a name of its own, so writers never
meet in one folder. Spark puts ``_SUCCESS`` into a generation last, so a reader never sees half of one.

A ``label`` names a batch: writing it again replaces the generation of that very label, as long as that
is not folded yet.

Generations are folded in tiers. A tier holds generations whose bytes agree within a factor of ``FAN``; as
soon as ``FAN`` neighbours of a tier have gathered (smaller ones may lie between them), they become one
generation that stands where the last of them stood, so the order of versions stays. A byte moves up a tier
each time it is rewritten: N bytes written in small batches are rewritten log N times each, however long a
stream runs, and a large generation is never touched for the sake of small ones. ``compact`` folds all there
is. A folded generation lists what it holds, by name; generations written meanwhile stay beside it. What an
earlier fold had replaced is removed at the next one: a reader has that time to end.

``build_index`` cuts the vectors into cells, kept beside the generations in order of collection and cell, with
the radius of each cell. From then on a generation is placed as soon as it is written or folded; one whose
writer broke off in between is searched in full, so an index never hides a record.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime
from functools import lru_cache
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuslens import config
from corpuslens.operators.rollup import FILE
from corpuslens.operators.search import LOOSE, Cells, assign_cells, cell_radii, fit_cells
from corpuslens.operators.skew import materialise

RECORDS = "records"
FOLDED = "folded"
RESPONSES = "responses"
RESPONSES_FOLDED = "responses_folded"
PROJECTS = "project_info"
FILE_LISTS = "file_list"
BASE = "base"
CENTRES = "centres"
CELLS = "cells"
RADII = "radii"
SCHEMA = (
    "corpus_id string, rel_path string, id string, document string, embedding array<float>, "
    "file_path string, filename string, extension string, name string, type string, total_lines bigint, "
    "has_error boolean, oversized_file boolean, error_message string, content_key string, version timestamp"
)
RESPONSE_SCHEMA = "prompt_hash string, response string, error string, attempts int, asked_at timestamp"
#: Neighbours of one tier after which a writer folds them; also the factor between tiers.
FAN = 8
#: Records a cell holds on average, and the most cells: their centres and radii go through the driver.
RECORDS_PER_CELL = 20_000
MAX_CELLS = 4096
#: Prompt hashes that are sent to the readers of stored responses (some 6 MB); more are joined by shuffle.
ASKED_HASHES = 100_000


@lru_cache(maxsize=1)
def _path_class(jvm):
    """Looked up once: each part of a dotted name is sought as a class in every jar."""
    return jvm.org.apache.hadoop.fs.Path


def _hadoop(spark: SparkSession, path: str):
    where = _path_class(spark._jvm)(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of all folders below ``path``; driver metadata only."""
    where, files = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(where) if s.isDirectory()) if files.exists(where) else []


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished folders below ``path``; driver metadata only."""
    where, files = _hadoop(spark, path)
    if not files.exists(where):
        return []
    path_of = _path_class(spark._jvm)
    done = lambda p: files.exists(path_of(p, "_SUCCESS"))
    return sorted(p.getName() for p in (s.getPath() for s in files.listStatus(where) if s.isDirectory()) if done(p))


def _next(names: list[str], prefix: str) -> int:
    """The place behind all ``names``."""
    return 1 + max((int(n[len(prefix) + 1 :][:12]) for n in names), default=-1)


def _name(number: int, prefix: str, label: str | None = None) -> str:
    """A name at a place that nobody else has."""
    return f"{prefix}={number:012d}.{uuid.uuid4().hex}" + (f"@{quote(label, safe='')}" if label else "")


def _label(name: str) -> str:
    return name.partition("@")[2]


def _folded(spark: SparkSession, store: str, folder: str = FOLDED) -> dict[str, list[str]]:
    """Each finished fold and the names it holds together; names are driver metadata, a few for each fold."""
    bases = _folders(spark, f"{store}/{folder}")
    found: dict[str, list[str]] = {base: [] for base in bases}
    if bases:
        listed = spark.read.schema("base string, name string").parquet(*[f"{store}/{folder}/{b}" for b in bases])
        for row in listed.collect():
            found[row["base"]].append(row["name"])
    return found


def _live(names: list[str], folds: dict[str, list[str]]) -> list[str]:
    hidden = {n for held in folds.values() for n in held}
    return [n for n in names if n not in hidden and (n in folds or _label(n) != BASE)]


def _generations(spark: SparkSession, store: str, folder: str = RECORDS, folded: str = FOLDED) -> list[str]:
    """What counts, oldest first: folded generations, and those that no fold holds."""
    return _live(_folders(spark, f"{store}/{folder}"), _folded(spark, store, folded))


def _sizes(spark: SparkSession, store: str, names: list[str], folder: str = RECORDS) -> list[int]:
    """Bytes of each generation, from the file system."""
    found = []
    for name in names:
        where, files = _hadoop(spark, f"{store}/{folder}/{name}")
        found.append(files.getContentSummary(where).getLength())
    return found


def due(sizes: list[int], fan: int = FAN) -> tuple[int, int] | None:
    """The neighbours to fold next, as a range of places: of the lowest tier that has ``fan`` generations with
    nothing larger between them."""
    tiers = [int(math.log(max(size, 1), max(fan, 2)) + 1e-9) for size in sizes]
    for tier in sorted(set(tiers)):
        start = 0
        for end in range(len(tiers) + 1):
            if end == len(tiers) or tiers[end] > tier:
                if tiers[start:end].count(tier) >= max(fan, 2):
                    return start, end
                start = end + 1
    return None


@contextmanager
def _unsorted(spark: SparkSession) -> Iterator[None]:
    """A task keeps a file open for each collection; otherwise Spark sorts all its rows, vectors included, to have one."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, max(int(before), len(config.COLLECTIONS)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_records(records: DataFrame, store: str, label: str | None = None, compact_after: int | None = FAN) -> str:
    """Upsert: every file in ``records`` replaces its earlier records. Gives the generation's name.

    A ``label`` names the batch, one of its own for each source and batch: written again, it replaces what
    it wrote. So many generations of a tier as ``compact_after`` says are folded after the write.
    """
    spark = records.sparkSession
    if label and quote(label, safe="") == BASE:
        raise ValueError(f"{BASE} is no label")
    live = _generations(spark, store)
    before = [n for n in live if label and _label(n) == quote(label, safe="")]
    name = before[-1] if before else _name(_next(_folders(spark, f"{store}/{RECORDS}"), "gen"), "gen", label)
    for column, kind in (("embedding", "array<float>"), ("content_key", "string"), ("modified_at", "timestamp")):
        if column not in records.columns:
            records = records.withColumn(column, F.lit(None).cast(kind))
    columns = [part.split(" ")[0] for part in SCHEMA.split(", ")]
    if before:
        _unplace(spark, store, [name])  # the cells of what is replaced
    rows = records.withColumn("version", F.coalesce("modified_at", F.current_timestamp())).select("collection", *columns)
    with _unsorted(spark):
        rows.write.mode("overwrite").partitionBy("collection").parquet(f"{store}/{RECORDS}/{name}")
    _place(spark, store, name)
    if compact_after is not None and len(live) >= compact_after - 1:
        fold_tiers(spark, store, compact_after)
    return name


def _rows(spark: SparkSession, store: str, names: list[str]) -> DataFrame:
    root = f"{store}/{RECORDS}"
    reader = spark.read.schema(f"{SCHEMA}, collection string, gen string").option("basePath", root)
    return reader.parquet(*[f"{root}/{n}" for n in names])


def _current(rows: DataFrame, store: str, names: list[str]) -> DataFrame:
    """Of ``rows`` with the generation ``gen`` of each, those of the newest version of their file."""
    if len(names) > 1:
        spark = rows.sparkSession
        base = [max(zip(_sizes(spark, store, names), names))[1]]  # the largest needs no look at most of its files
        summaries = lambda picked: _rows(spark, store, picked).filter(F.col("collection") == "file_summaries").select(*FILE, "version", "gen")
        later = summaries([n for n in names if n not in base])
        # only files that a generation beside the base touches can have several versions
        held = later.unionByName(summaries(base).join(later.select(*FILE).distinct(), FILE, "left_semi"))
        newest = held.groupBy(*FILE).agg(F.max(F.struct("version", "gen"))["gen"].alias("_gen"))
        rows = rows.join(newest, FILE, "left").filter(F.col("_gen").isNull() | (F.col("gen") == F.col("_gen"))).drop("_gen")
    return rows.drop("gen")


def _read(spark: SparkSession, store: str, names: list[str], collections=None) -> DataFrame:
    wanted = list(collections or config.COLLECTIONS)
    return _current(_rows(spark, store, names).filter(F.col("collection").isin(wanted)), store, names)


def read_collections(spark: SparkSession, store: str, collections=None) -> DataFrame:
    """Current records; ``collection`` filters prune folders. A store without records is an error.

    Which versions count is an aggregate of the summary records of files touched since the last base;
    Spark broadcasts it if its size allows.
    """
    names = _generations(spark, store)
    if not names:
        raise ValueError(f"no collections in {store}")
    return _read(spark, store, names, collections)


def fold_tiers(spark: SparkSession, store: str, fan: int = FAN) -> list[int]:
    """Folds neighbours of like size until no tier is full; gives the bytes each fold has read."""
    read = []
    while True:
        names = _generations(spark, store)
        sizes = _sizes(spark, store, names)
        found = due(sizes, fan)
        if not found:
            return read
        read.append(sum(sizes[slice(*found)]))
        _fold(spark, store, names[slice(*found)])


def compact(spark: SparkSession, store: str) -> None:
    """Folds all current generations into one, and removes what earlier folds had replaced."""
    names = _generations(spark, store)
    if len(names) > 1:
        _fold(spark, store, names)


def _fold(spark: SparkSession, store: str, members: list[str]) -> None:
    """Makes one generation of neighbours. It is range-partitioned by file, so that file statistics prune
    look-ups by path, and takes the place of the last: of equal versions the later generation still counts."""
    earlier = _folded(spark, store)
    present = set(_folders(spark, f"{store}/{RECORDS}"))
    base = f"{members[-1].partition('.')[0]}.{uuid.uuid4().hex}@{BASE}"
    (
        _read(spark, store, members)
        .repartitionByRange("collection", "corpus_id", "rel_path", "id")
        .sortWithinPartitions("collection", "corpus_id", "rel_path", "id")
        .write.partitionBy("collection")
        .parquet(f"{store}/{RECORDS}/{base}")
    )
    _place(spark, store, base)
    gone = _list_fold(spark, store, RECORDS, FOLDED, base, members, earlier, present)
    _unplace(spark, store, gone)


def _list_fold(spark, store, folder, folded, name, members, earlier, present) -> list[str]:
    """Lists the ``members`` that the fold ``name`` now stands for; removes what ``earlier`` folds had replaced and
    gives its names."""
    gone = {n for held in earlier.values() for n in held} & present
    # a member that is a fold itself hides no longer what it held, so its names are taken over
    held = [*members, *(n for m in members for n in earlier.get(m, ()) if n in present)]
    spark.createDataFrame([(name, n) for n in held], "base string, name string").coalesce(1).write.parquet(f"{store}/{folded}/{name}")
    for where in [*(f"{folder}/{n}" for n in sorted(gone)), *(f"{folded}/{m}" for m in members if m in earlier)]:
        path, files = _hadoop(spark, f"{store}/{where}")
        files.delete(path, True)
    return sorted(gone)


def build_index(spark: SparkSession, store: str, cells: int | None = None) -> int:
    """Cuts the stored vectors into cells; gives their number, 0 for a store without vectors.

    Later generations are placed as they are written. Build again when the store has grown several times over:
    the cells then follow its size; results are the same before and after.
    """
    names = _generations(spark, store)
    if not names:
        return 0
    held = _rows(spark, store, names).filter(F.col("embedding").isNotNull())
    count = held.count()
    if not count:
        return 0
    cells = cells or min(MAX_CELLS, 1 + count // RECORDS_PER_CELL)
    centres = [[float(x) for x in centre] for centre in fit_cells(held, cells)]
    write_table(spark.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>").coalesce(1), store, CENTRES)
    for name in names:
        _place(spark, store, name)
    return len(centres)


def _centres(spark: SparkSession, store: str) -> tuple[str, list] | None:
    """The version of the index and its centres, at most ``MAX_CELLS`` unless more were asked for."""
    versions = _folders(spark, f"{store}/{CENTRES}")
    if not versions:
        return None
    return versions[-1], [row["centre"] for row in read_table(spark, store, CENTRES).orderBy("cell").collect()]


def _place(spark: SparkSession, store: str, name: str) -> None:
    """Writes the cells of a generation, and last their radii: what has radii is placed."""
    index = _centres(spark, store)
    if index is None:
        return
    version, centres = index
    rows = _rows(spark, store, [name]).drop("document", "content_key", "gen")
    where = lambda part: f"{store}/{part}/{version}/{name}"
    (
        materialise(assign_cells(rows, centres))  # the ranges are found in a pass of their own: cells are assigned once
        .repartitionByRange("collection", "cell", "corpus_id", "rel_path", "id")
        .sortWithinPartitions("collection", "cell", "corpus_id", "rel_path", "id")
        .write.mode("overwrite")
        .parquet(where(CELLS))
    )
    cell_radii(spark.read.parquet(where(CELLS))).coalesce(1).write.mode("overwrite").parquet(where(RADII))


def _unplace(spark: SparkSession, store: str, names: list[str]) -> None:
    """Removes the cells of generations, radii first."""
    for part in (RADII, CELLS):
        for version in _folders(spark, f"{store}/{CENTRES}") if names else ():
            for name in names:
                path, files = _hadoop(spark, f"{store}/{part}/{version}/{name}")
                files.delete(path, True)


def read_index(spark: SparkSession, store: str) -> Cells | None:
    """The cells of the current records, for ``search``; None where no index was built. Radii are those of all
    versions a cell has held: never too small."""
    index = _centres(spark, store)
    if index is None:
        return None
    version, centres = index
    names = _generations(spark, store)
    placed = sorted(set(names) & set(_folders(spark, f"{store}/{RADII}/{version}")))
    columns = ["collection", *(p.split(" ")[0] for p in SCHEMA.split(", ")), "gen", "cell"]
    columns = [c for c in columns if c not in ("document", "content_key")]
    loose = [n for n in names if n not in placed]
    parts, radii = [], {}
    if placed:
        read = lambda part, schema: spark.read.schema(f"{schema}, gen string").option("basePath", f"{store}/{part}/{version}").parquet(
            *[f"{store}/{part}/{version}/{n}" for n in placed]
        )
        parts.append(read(CELLS, f"{SCHEMA}, collection string, cell int").select(columns))
        for row in read(RADII, "collection string, cell int, radius double").collect():  # a row a generation and cell
            key = row["collection"], row["cell"]
            radii[key] = max(row["radius"], radii.get(key, 0.0))
    if loose:
        parts.append(_rows(spark, store, loose).withColumn("cell", F.lit(LOOSE)).select(columns))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return Cells(_current(rows, store, names), centres, radii)


def _latest(held: DataFrame) -> DataFrame:
    """The row that counts of each prompt: a good answer before any error, the latest of either. One shuffle."""
    rank = F.struct(F.col("error").isNull(), "asked_at", "error", "response")
    best = F.max_by(F.struct("response", "error", "attempts", "asked_at"), rank)
    return held.groupBy("prompt_hash").agg(best.alias("_best")).select("prompt_hash", "_best.*")


def _responses(spark: SparkSession, store: str, names: list[str]) -> DataFrame:
    return spark.read.schema(RESPONSE_SCHEMA).parquet(*[f"{store}/{RESPONSES}/{n}" for n in names])


def read_responses(spark: SparkSession, store: str, asked: DataFrame | None = None) -> DataFrame | None:
    """One row per prompt: a good answer if there is one, else the latest error.

    With ``asked`` (a ``prompt_hash`` in each row, none twice) only its prompts: the rest of the store is left out in
    the tasks that read it, before anything is shuffled, as long as at most ``ASKED_HASHES`` are asked for.
    """
    names = _generations(spark, store, RESPONSES, RESPONSES_FOLDED)
    if not names:
        return None
    held = _responses(spark, store, names)
    if asked is not None:
        hashes = asked.select("prompt_hash")
        few = hashes.limit(ASKED_HASHES + 1).count() <= ASKED_HASHES
        held = held.join(F.broadcast(hashes) if few else hashes, "prompt_hash", "left_semi")
    return _latest(held).drop("asked_at")


def next_response_part(spark: SparkSession, store: str) -> int:
    """The place behind all stored parts, for a writer of many: it need not list them for each."""
    return _next(_folders(spark, f"{store}/{RESPONSES}"), "part")


def write_responses(
    responses: DataFrame, store: str, fold_after: int | None = FAN, place: int | None = None, asked_at: datetime | None = None
) -> None:
    """Kept for good: a reply that was paid for is never asked for again. Failures are kept beside it and
    may be tried again. So many parts of a tier as ``fold_after`` says are folded after the write. ``asked_at`` is the
    time of the write unless it is told."""
    spark = responses.sparkSession
    name = _name(next_response_part(spark, store) if place is None else place, "part")
    stamp = F.current_timestamp() if asked_at is None else F.lit(asked_at)
    responses.withColumn("asked_at", stamp).write.parquet(f"{store}/{RESPONSES}/{name}")
    if fold_after is not None:
        fold_responses(spark, store, fold_after)


def fold_responses(spark: SparkSession, store: str, fan: int = FAN) -> None:
    """Folds neighbouring parts of like size in tiers, as records are, into the row that counts of each prompt. What
    an earlier fold had replaced is removed at the next."""
    while True:
        present = _folders(spark, f"{store}/{RESPONSES}")
        earlier = _folded(spark, store, RESPONSES_FOLDED)
        names = _live(present, earlier)
        found = due(_sizes(spark, store, names, RESPONSES), fan) if len(names) >= fan else None
        if not found:
            return
        members = names[slice(*found)]
        part = f"{members[-1].partition('.')[0]}.{uuid.uuid4().hex}@{BASE}"
        _latest(_responses(spark, store, members)).write.parquet(f"{store}/{RESPONSES}/{part}")
        _list_fold(spark, store, RESPONSES, RESPONSES_FOLDED, part, members, earlier, set(present))


def write_table(df: DataFrame, store: str, name: str) -> None:
    """A small table as a new version beside the old one, which may be what is being read."""
    number = _next(_folders(df.sparkSession, f"{store}/{name}"), "version")
    df.write.parquet(f"{store}/{name}/{_name(number, 'version')}")


def read_table(spark: SparkSession, store: str, name: str) -> DataFrame | None:
    """The newest finished version; None if there is none."""
    names = _folders(spark, f"{store}/{name}")
    return spark.read.parquet(f"{store}/{name}/{names[-1]}") if names else None
