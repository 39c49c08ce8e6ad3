"""Lines and chunks.

All of it happens inside the row that holds the file: no text is shuffled, and a corpus of any size
is one narrow stage. Files keep their columns except ``content``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.config import BYTES_PER_TOKEN, CHUNK_SIZE, CONTEXT_LENGTHS, CONTEXT_SHARE, \
    DEFAULT_CONTEXT_LENGTH, FULL_PROMPT_CHUNKS
from corpuslens.functions import text


def _with_lines(files: DataFrame) -> DataFrame:
    """``_lines``; ``_marks``, the line numbers of significant lines; ``_n``, the line count."""
    marked = lambda test: F.array_compact(F.transform("_lines", lambda line, i: F.when(test(line), i + 1)))
    return (
        files.withColumn("_parts", text.split_parts(F.col("content")))
        .withColumn("_closed", text.ends_with_newline(F.col("content")))
        .drop("content")
        .withColumn("_lines", text.drop_open_end(F.col("_parts")))
        .withColumn("_marks", F.when(text.has_comments(F.col("extension")), marked(text.is_code)).otherwise(marked(text.is_filled)))
        .withColumn("_n", F.size("_lines"))
        .withColumn("_s", F.size("_marks"))
    )


def line_counts(files: DataFrame) -> DataFrame:
    """Total and significant lines per file; progress counts only C# files by significance."""
    keep = [c for c in files.columns if c != "content"]
    return (
        _with_lines(files)
        .select(*keep, F.col("_n").alias("total_lines"), F.col("_s").alias("significant_lines"))
        .withColumn(
            "progress_lines",
            F.when(F.lower("extension") == ".cs", F.col("significant_lines")).otherwise(F.col("total_lines")),
        )
    )


def lines(files: DataFrame) -> DataFrame:
    """One row per line with the count of significant lines up to and including it.

    The running count needs no window: between two neighbouring marks it stands still, so it is
    each mark's index repeated over the gap to the next one.
    """
    keep = [c for c in files.columns if c != "content"]
    starts = F.concat(F.array(F.lit(1)), F.col("_marks"))
    ends = F.concat(F.col("_marks"), F.array(F.col("_n") + 1))
    running = F.flatten(
        F.transform(
            F.arrays_zip(starts.alias("a"), ends.alias("b")),
            lambda gap, i: F.array_repeat(i, gap["b"] - gap["a"]),
        )
    )
    return (
        _with_lines(files)
        .withColumn("_running", running)
        .select(*keep, F.posexplode(F.arrays_zip("_lines", "_running")).alias("_i", "_line"))
        .select(
            *keep,
            (F.col("_i") + 1).alias("line_no"),
            F.col("_line._lines").alias("line"),
            text.is_significant(F.col("_line._lines"), F.col("extension")).alias("is_sig"),
            F.col("_line._running").alias("sig_so_far"),
        )
    )


def _content(start: Column, end: Column) -> Column:
    body = F.array_join(F.slice("_lines", start, end - start + 1), "\n")
    return F.concat(body, F.when((end < F.col("_n")) | F.col("_closed"), F.lit("\n")).otherwise(F.lit("")))


def _cut(files: DataFrame, count: Column, span, keep_empty: bool = False, content: bool = True) -> DataFrame:
    """Explode ``count`` chunks per file; ``span(k)`` gives start, end and, if known, significant lines.

    ``keep_empty`` gives a file without chunks one row whose chunk columns are NULL.
    """
    keep = [c for c in files.columns if not c.startswith("_")]

    def chunk(k):
        start, end, n_sig = span(k)
        fields = [k.alias("chunk_no"), start.alias("start_line"), end.alias("end_line")]
        if n_sig is not None:
            fields.append(n_sig.alias("n_sig"))
        if content:
            fields.append(_content(start, end).alias("content"))
        return F.struct(*fields)

    # An empty file has no chunk: the range below would count downwards, so it is emptied.
    numbers = F.filter(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: k < count)
    opened = (F.explode_outer if keep_empty else F.explode)(F.transform(numbers, chunk))
    return files.select(*keep, F.col("_n").alias("total_lines"), opened.alias("_c")).select(
        *keep, "total_lines", "_c.*"
    )


def chunk_fixed(files: DataFrame, size: int = CHUNK_SIZE, start: int = 1) -> DataFrame:
    """Chunks of ``size`` lines from line ``start`` on."""
    if size < 1 or start < 1:
        raise ValueError("size and start begin at 1")
    prepared = _with_lines(files)
    count = F.greatest(F.ceil((F.col("_n") - (start - 1)) / size), F.lit(0)).cast("int")

    def span(k):
        first = k * size + start
        return first, F.least(first + (size - 1), F.col("_n")), None

    return _cut(prepared, count, span).withColumn("eof", F.col("end_line") == F.col("total_lines"))


def chunk_significant(
    files: DataFrame, size: int = CHUNK_SIZE, overlap: int = 1, keep_empty: bool = False, content: bool = True
) -> DataFrame:
    """Chunks of ``size`` significant lines.

    ``overlap=1``: a chunk begins with the last line of the one before it, and ``reported_end_line``
    is one short. ``overlap=0``: chunks do not share lines. Bounds come straight from the marks: chunk k
    ends at mark ``(k+1)*step+1`` (``(k+1)*size`` without overlap) or at the end of file.
    ``content=False`` gives the bounds only.
    """
    if overlap not in (0, 1):
        raise ValueError("overlap is 0 or 1")
    if size < 1 + overlap:
        raise ValueError("a chunk must hold more lines than it shares")
    step = size - overlap
    prepared = _with_lines(files)
    s, n = F.col("_s"), F.col("_n")
    full = F.floor(F.greatest(s - overlap, F.lit(0)) / step).cast("int")  # chunks that reach their size
    # ``get`` counts from 0: the mark closing chunk k-1 sits at k*step-(1-overlap).
    bound = lambda k: F.get("_marks", k * step - (1 - overlap))
    count = F.when(n == 0, 0).when((full > 0) & (bound(full) == n), full).otherwise(full + 1)

    def span(k):
        first = F.when(k == 0, 1).otherwise(bound(k) + (1 - overlap))
        last = F.when(k < full, bound(k + 1)).otherwise(n)
        inside = F.greatest(F.least((k + 1) * step + overlap, s) - k * step, F.lit(0))
        return first, last, inside

    return (
        _cut(prepared, count, span, keep_empty, content)
        .withColumn("reported_end_line", F.col("end_line") - overlap)
        .withColumn("eof", F.col("end_line") == F.col("total_lines"))
    )


def context_length(model: Column) -> Column:
    """Context length by model name: the first prefix in table order that fits, else the default."""
    base = F.lower(F.substring_index(model, ":", 1))
    found = None
    for prefix, length in CONTEXT_LENGTHS:
        test = F.startswith(base, F.lit(prefix))
        found = F.when(test, length) if found is None else found.when(test, length)
    return found.otherwise(DEFAULT_CONTEXT_LENGTH)


def mark_oversized(files: DataFrame, context: int | Column = DEFAULT_CONTEXT_LENGTH) -> DataFrame:
    """``estimated_tokens`` from ``size_bytes``, and whether they pass the share of the context."""
    limit = F.floor((F.lit(context) if isinstance(context, int) else context) * F.lit(CONTEXT_SHARE))
    return files.withColumn("estimated_tokens", F.floor(F.col("size_bytes") / BYTES_PER_TOKEN)).withColumn(
        "oversized_file", F.col("estimated_tokens") > limit
    )


def mark_structural(chunks: DataFrame) -> DataFrame:
    """Later chunks of oversized files get the brief prompt."""
    return chunks.withColumn(
        "structural_only", F.col("oversized_file") & (F.col("chunk_no") >= FULL_PROMPT_CHUNKS)
    )
