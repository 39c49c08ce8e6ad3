"""Line and whitespace rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# White space as a text strip() sees it: Unicode white space and the four separators 1C-1F.
SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Both ends trimmed of every kind of white space (``trim`` takes spaces only)."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def unify_newlines(content: Column) -> Column:
    return F.regexp_replace(content, r"\r\n?", "\n")


def split_parts(content: Column) -> Column:
    return F.split(unify_newlines(content), "\n")


def drop_open_end(parts: Column) -> Column:
    """A final line end opens no further line; empty text has no line."""
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def ends_with_newline(content: Column) -> Column:
    return F.coalesce(F.right(content, F.lit(1)).isin("\n", "\r"), F.lit(False))


def is_filled(line: Column) -> Column:
    return line.rlike(rf"(?U){NOT_SPACE}")


def is_code(line: Column) -> Column:
    """Neither blank nor a ``//`` comment."""
    return is_filled(line) & ~line.rlike(rf"(?U)^{SPACE}*//")


def has_comments(extension: Column) -> Column:
    """Files whose ``//`` comment lines do not count."""
    return F.coalesce(F.lower(extension) == ".cs", F.lit(False))


def is_significant(line: Column, extension: Column) -> Column:
    """False for blank lines, and for ``//`` comment lines of C# files. Over the lines of one file choose by
    ``has_comments`` first, outside of the loop."""
    return F.when(has_comments(extension), is_code(line)).otherwise(is_filled(line))
