"""Report rows and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens import config
from corpuslens.functions import replies
from corpuslens.functions.text import let, strip

# The layout of a report.
HEADING = "## 📄 "
RULE = "---"
SECTION_TITLES = (
    ("classes", "Classes"),
    ("functions", "Functions/Methods"),
    ("dependencies", "Dependencies/Imports"),
)
REMAINING_HEADING = "## Files Remaining to Study"


def _section(name: str, title: str) -> Column:
    base = F.replace(F.substring_index("rel_path", "/", -1), F.lit("`"), F.lit("\\`"))
    heading = F.concat(F.lit("\n### "), base, F.lit(f" - **{title}**\n"))
    return let(
        replies.section_lines(F.col(name)),
        lambda body: F.when(body != "", F.concat(heading, body)).otherwise(F.lit("")),
    )


def file_report(file_analysis: DataFrame) -> DataFrame:
    """One report per file: its error, or its summary and lists. A switched-off section is NULL and left out."""
    heading = F.concat(F.lit(HEADING), "rel_path", F.lit("\n\n"))
    failed = F.concat(
        F.lit("\n"), heading, F.lit("**Error**: "), "error", F.lit(f"\n\n{RULE}\n")
    )
    summary = replies.clean_summary(F.coalesce("summary", F.lit(config.NO_SUMMARY)))
    good = strip(
        F.concat(
            heading, summary, F.lit("\n"), *[_section(n, t) for n, t in SECTION_TITLES], F.lit(f"\n{RULE}")
        )
    )
    return file_analysis.select(
        "corpus_id", "rel_path", F.when(F.col("error").isNotNull(), failed).otherwise(good).alias("report")
    )


def report_index(remaining: DataFrame) -> DataFrame:
    """Remaining files of each corpus as lines, in order of part and rel_path; a finished corpus has none."""
    heading = remaining.select("corpus_id").distinct().select(
        "corpus_id", F.lit(0).alias("part"), F.lit("").alias("rel_path"), F.lit(REMAINING_HEADING).alias("line")
    )
    items = remaining.select(
        "corpus_id", F.lit(1).alias("part"), "rel_path", F.concat(F.lit("- `"), "rel_path", F.lit("`")).alias("line")
    )
    return heading.unionByName(items)


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """Ordered text files per corpus: a range shuffle, so a large corpus spans several files in order."""
    (
        lines.repartitionByRange("corpus_id", *order)
        .sortWithinPartitions("corpus_id", *order)
        .select("corpus_id", "line")
        .write.mode("overwrite")
        .partitionBy("corpus_id")
        .text(path)
    )
