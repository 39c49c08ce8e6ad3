"""Path and name rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpuslens.functions.text import strip


def filename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Last suffix with its dot; a name that only has leading dots has none."""
    return F.regexp_extract(filename(path), r"^\.*[^.].*?(\.[^.]*)$", 1)


def suffix(path: Column) -> Column:
    """The suffix the extension filter sees: a lone trailing dot is no suffix."""
    found = extension(path)
    return F.when(found == ".", "").otherwise(found)


def relative_path(path: Column, root: Column) -> Column:
    """Path below ``root``; a path elsewhere gives its base name. Back slashes become slashes."""
    clean = F.translate(path, "\\", "/")
    base = F.concat(F.rtrim(F.translate(root, "\\", "/"), F.lit("/")), F.lit("/"))
    return F.when(F.startswith(clean, base), F.substr(clean, F.length(base) + 1)).otherwise(filename(clean))


def safe_id(path: Column) -> Column:
    return F.translate(path, "/\\. ", "____")


def class_name(item: Column) -> Column:
    return F.when(F.contains(item, F.lit(":")), strip(F.substring_index(item, ":", 1))).otherwise(item)


def function_name(item: Column) -> Column:
    return F.when(F.contains(item, F.lit("(")), strip(F.substring_index(item, "(", 1))).otherwise(item)


def module_name(item: Column) -> Column:
    """Second space-separated word if there is one (``from a import b`` gives ``a``)."""
    return F.coalesce(F.get(F.split(item, " ", 3), F.lit(1)), item)
