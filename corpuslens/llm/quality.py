"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the corpus (operator 3).

Words and pairs of neighbouring words are hashed to places, whose number grows with the corpus (see ``places``).
Multinomials over the places are counted in one pass over all documents: one of the corpus, and one of the
trusted documents (labelled good) of each of ``FOLDS`` folds. Folds are cut by a hash of the text, and a document
is measured by the trusted texts of the other folds, so none is measured by its own counts and equal texts are
judged alike. The score is the mean of ``ln p_target - ln p_corpus`` over its n-grams, so it does not depend on
length. A document is kept if it passes the base rules and scores at least as high as the trusted document at
``QUANTILE`` of all trusted ones; the border is read off a histogram of steps of ``STEP``, so reruns agree.

DataFrame functions only: counts combine in the task that reads the text, weights are sent to the tasks while
they are at most ``SENT_PLACES`` rows and joined by shuffle beyond, and no text is shuffled.

Cases: NULL and empty texts have no words and fail the base rules; a fold that finds no trusted text in the
others scores 0 throughout, and without trusted documents the border is 0; labels that are NULL or of unknown
documents count for nothing; repeated rows are judged alike and all stay; a very long text is one row of its task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.llm.shared import WORD, keep, small, text_of

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_PLACES = 1 << 10
#: Places for each square root of a byte: 2^17 for 0.5 GB, 2^20 for 30 GB, 2^26 for 100 TB.
PLACES_A_ROOT = 4
#: At most so many weights (a place and a number for each fold) are broadcast.
SENT_PLACES = 1 << 20
FOLDS = 2
#: The target is mixed with so large a share of the corpus, so no place has probability 0 in it.
SMOOTHING = 0.1
#: The share of trusted documents that score below the border.
QUANTILE = 0.01
STEP = 0.001
MIN_WORDS = 20
REPEAT_WORDS = 8


def _pairs(hashes: str, gap: int) -> Column:
    """Hash of every entry with the one ``gap`` later."""
    h = F.col(hashes)
    at = F.sequence(F.lit(0), F.size(h) - (gap + 1))
    return F.when(F.size(h) > gap, F.transform(at, lambda i: F.xxhash64(h[i], h[i + gap]))).otherwise(F.array().cast("array<long>"))


def with_words(docs: DataFrame) -> DataFrame:
    """Adds ``_text, _words, _h1`` (a hash per word) and ``_h2`` (one per pair of neighbours)."""
    held = docs.withColumn("_text", text_of()).withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), 0))
    return held.withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_h2", _pairs("_h1", 1))


def places(docs: DataFrame) -> int:
    """Places for the n-grams of ``docs``: the power of two at or above ``PLACES_A_ROOT`` times the root of its bytes."""
    held = docs.agg(F.coalesce(F.sum(F.octet_length(text_of())), F.lit(0))).first()[0]
    return max(LEAST_PLACES, 1 << max(0, math.ceil(math.log2(PLACES_A_ROOT * math.sqrt(max(1, held))))))


def by_place(rows: DataFrame, n_places: int, *columns: str) -> DataFrame:
    """A row with ``_place`` for each n-gram; one without a place for a text without words. ``n_places`` is a power of
    two, so the low bits of a hash are its place."""
    each = rows.select(*columns, F.explode_outer(F.concat("_h1", "_h2")).alias("_hash"))
    return each.select(*columns, F.col("_hash").bitwiseAND(F.lit(n_places - 1)).cast("int").alias("_place"))


def fold() -> Column:
    return F.pmod(F.xxhash64("_text", F.lit(3)), F.lit(FOLDS)).cast("int")


def with_base(docs: DataFrame) -> DataFrame:
    """Adds the base measures. Needs the columns of ``with_words``.

    Windows of eight words are hashed by doubling. Only texts that hold one twice sort theirs.
    """
    lines = F.filter(F.split("_text", "\n"), lambda line: F.translate(line, WHITE, "") != "")
    lacks = lambda signs: F.length("_text") - F.length(F.translate("_text", signs, ""))
    held = (
        docs.withColumn("_h4", _pairs("_h2", 2))
        .withColumn("_h8", _pairs("_h4", 4))
        .withColumn("_lines", lines)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", (F.length("_text") - lacks(WHITE)).cast("long"))
        .withColumn("n_symbols", lacks(SYMBOLS).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn(
            "_order",
            F.when(
                F.size("_h8") > F.size(F.array_distinct("_h8")),
                F.sort_array(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ),
        )
    )
    order = F.col("_order")
    twice = F.filter(
        order,
        lambda x, i: ((i > 0) & (x["h"] == F.get(order, i - 1)["h"])) | F.coalesce(x["h"] == F.get(order, i + 1)["h"], F.lit(False)),
    )
    held = held.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    after = F.slice(F.col("_at"), F.lit(2), F.greatest(F.size("_at"), F.lit(1)))
    covers = F.zip_with("_at", after, lambda a, b: F.least(F.lit(REPEAT_WORDS), F.coalesce(b - a, F.lit(REPEAT_WORDS))))
    return held.withColumn(
        "n_repeat_words",
        F.coalesce(F.aggregate(covers, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
    )


def trusted(labels: DataFrame) -> DataFrame:
    """``doc_id, _trusted`` of the documents labelled good."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return small(good.withColumn("_trusted", F.lit(True)))


def place_weights(docs: DataFrame, good: DataFrame, n_places: int) -> DataFrame:
    """``_place, _weight0, _weight1, ...``: the log ratio of the two multinomials at every place the corpus uses,
    for documents of each fold."""
    marked = with_words(docs.select("doc_id", "text").join(good, "doc_id", "left")).withColumn("_fold", F.when(F.col("_trusted"), fold()))
    counts = keep(
        by_place(marked, n_places, "_fold").filter("_place IS NOT NULL").groupBy("_place").agg(
            F.count(F.lit(1)).alias("_all"), *(F.count_if(F.col("_fold") != f).alias(f"_good{f}") for f in range(FOLDS))
        ),
        "places",
    )
    totals = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts.columns[1:])).first()
    share = F.col("_all") / F.lit(float(totals["_all"] or 1))

    def weight(name: str) -> Column:
        if not totals[name]:
            return F.lit(0.0)
        seen = F.col(name) / F.lit(float(totals[name]))
        return F.log((seen + SMOOTHING * share) / (1 + SMOOTHING) / share)

    return counts.select("_place", *(weight(f"_good{f}").alias(f"_weight{f}") for f in range(FOLDS)))


def border(scored: DataFrame) -> float:
    """The score that a share of ``1 - QUANTILE`` of the trusted documents reach, in steps of ``STEP``; 0 without any.

    The histogram has a row for each step between the least and the greatest weight that occur."""
    steps = scored.filter("_trusted AND NOT base_failed").groupBy(F.floor(F.col("score") / STEP).alias("step")).count().orderBy("step")
    held = [(r["step"], r["count"]) for r in steps.toLocalIterator()]
    left = QUANTILE * sum(n for _, n in held)
    for step, n in held:
        left -= n
        if left < 0:
            return round(step * STEP, 9)
    return 0.0


def judge(docs: DataFrame, labels: DataFrame, least: float | None = None) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept`` for
    every row. ``least`` is the score required; if None, the ``border`` of the trusted documents."""
    n_places, good = places(docs), trusted(labels)
    weights = small(place_weights(docs, good, n_places), SENT_PLACES)
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = with_base(with_words(docs.select("doc_id", "text"))).withColumns({"_row": F.monotonically_increasing_id(), "_fold": fold()})
    weight = F.coalesce(*(F.when(F.col("_fold") == f, F.col(f"_weight{f}")) for f in range(FOLDS)))
    summed = (
        by_place(rows, n_places, "_row", "_fold", *base)
        .join(weights, "_place", "left")
        .groupBy("_row").agg(*(F.first(c).alias(c) for c in base), F.avg(weight).alias("score"))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    score = F.round(F.coalesce("score", F.lit(0.0)), 9)
    scored = keep(summed.select(*base, failed.alias("base_failed"), score.alias("score")), "scores")
    if least is None:
        least = border(scored.join(good, "doc_id"))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))
