"""Ignore-style path patterns as Java regular expressions.

Follows the public gitignore rules: last matching pattern wins, ``!`` keeps, a pattern with a slash
inside or in front is anchored at the root, a trailing slash takes what lies beneath a folder, and a
match on a folder covers everything under it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, functions as F

RUNS_TYPE = "array<struct<regex:string, hit:boolean>>"


def _segment(glob: str) -> str | None:
    """One path segment; None for a bracket left open, which can match nothing."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "\\" and i < len(glob):
            out.append(re.escape(glob[i]))
            i += 1
        elif c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            close = glob.find("]", i + (2 if glob[i : i + 1] in ("!", "^") else 1))
            if close < 0:
                return None
            inner = glob[i:close]
            negate = inner[:1] in ("!", "^")
            members = re.sub(r"([\\\[\]&^~])", r"\\\1", inner[1:] if negate else inner)
            out.append(f"(?!/)[{'^' if negate else ''}{members}]")
            i = close + 1
        else:
            out.append(re.escape(c))
    return "".join(out)


def to_regex(pattern: str) -> tuple[str, bool] | None:
    """``(regex, hit)`` for one line, or None where the line holds no pattern."""
    line = pattern.rstrip("\r\n")
    line = line.strip() if not line.endswith("\\ ") else line.lstrip()
    if not line or line.startswith("#") or line == "/":
        return None
    hit = not line.startswith("!")
    if not hit:
        line = line[1:]
    below_only = line.endswith("/")
    anchored = "/" in line.rstrip("/")
    segments = [s for s in line.split("/") if s]
    if not segments:
        return None
    regex = "^" if anchored else "^(?:.+/)?"
    last = len(segments) - 1
    slash = ""
    for i, segment in enumerate(segments):
        if segment == "**":
            if last == 0:
                return ("^.+/.*$" if below_only else "^.+$"), hit
            if i == last:
                regex += slash + ".+/.*" if below_only else slash + ".*"
                return regex + "$", hit
            regex += "(?:.+/)?" if not slash else "/(?:.+/)?"
            slash = ""
            continue
        body = "[^/]+" if segment == "*" else _segment(segment)
        if body is None:
            return None
        regex += slash + body
        slash = "/"
    return regex + ("/.*$" if below_only else "(?:/.*)?$"), hit


def to_runs(patterns: Iterable[str]) -> list[tuple[str, bool]]:
    """Patterns in order, neighbours of one sign joined into one expression."""
    runs: list[tuple[str, bool]] = []
    for found in filter(None, map(to_regex, patterns)):
        if runs and runs[-1][1] == found[1]:
            runs[-1] = (f"{runs[-1][0]}|{found[0]}", found[1])
        else:
            runs.append(found)
    return runs


def matches(path: Column, patterns: Iterable[str]) -> Column:
    """Does the last matching pattern say yes? Patterns are few and known when the plan is made."""
    test = None
    for regex, hit in reversed(to_runs(patterns)):
        found = path.rlike(regex)
        test = F.when(found, F.lit(hit)) if test is None else test.when(found, F.lit(hit))
    return F.lit(False) if test is None else test.otherwise(F.lit(False))


def runs_of(content: Column) -> Column:
    """The rules of a whole ignore file, one row per corpus, as an array of ordered runs."""

    @F.pandas_udf(RUNS_TYPE)
    def translate(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda text: [{"regex": r, "hit": h} for r, h in to_runs((text or "").split("\n"))]
        )

    return translate(content)


def matches_runs(path: Column, runs: Column) -> Column:
    """As ``matches`` with the rules in a column."""
    hits = F.filter(runs, lambda run: F.call_function("rlike", path, run["regex"]))
    return F.coalesce(F.try_element_at(hits, F.lit(-1))["hit"], F.lit(False))
