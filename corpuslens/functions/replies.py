"""Reply clean-up as column expressions: find the JSON, repair it, parse it.

Each step is one small function from Column to Column; ``operators/model.py`` chains them as
successive projections so that no step is computed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpuslens import config
from corpuslens.functions.text import let, strip

SECTIONS = ("classes", "functions", "dependencies")
REPLY_TYPE = (
    "description string, classes array<string>, functions array<string>, dependencies array<string>"
)

# The patterns that decide which text counts as the reply.
DIRECT = r'(?s)(\{.*?"description".*?"classes".*?\})'
BRACES = r"(?s)\{.*\}"
FENCED = r'(?sU)```(?:json)?\s*\n(\{\s*".*?"\s*:.*?\})\s*\n```'
FENCE_TAIL = r"(?mdU)\s*```.*$"
BOLD = r'(?d)"\*\*(.*?)\*\*"'
TYPED_SIGNATURE = r'(?U)"([^"]+\(\)[^"]*?)\s*->\s*[^"]+"\s*:\s*"([^"]+)"'
SIGNATURE = r'(?U)"([^"]+\(\))\s*"\s*:\s*"([^"]+)"'
PAIR = r'(?U)"([^"]+)"\s*:\s*"([^"]+)"'
FUNCTIONS_CLOSED = r'(?U)"functions"\s*:\s*\[[^\]]*\]'
FUNCTIONS_OPEN = r'(?U)("functions"\s*:\s*\[[^\]]*),\s*"dependencies"'
DESCRIPTION_COLON = r'(?U)("description":\s*"|\G(?!\A))([^":]*):(?=[^"]*")'
ARRAY = r'(?sU)"%s"\s*:\s*\[(.*?)\]'
ARRAY_OF_STRINGS = r'(?sU)"%s"\s*:\s*\[((?:[^"\]]++|"(?:[^"\\]++|\\.)*+")*+)\]'
COLON_HEADING = r"(?dU)^#+\s+.*:$"
LINK_HEADING = r"(?dU)^#+\s+.*\[.*\]\(.*\):$"
TOP_HEADING = r"^#(?!#)"
THINKING = r"(?s)<think>.*?</think>"
FENCE = "```"


def _array_of(text: Column, section: str) -> Column:
    """What stands in a section's array, up to the first ``]``; if that lies within a string, such as
    ``List[int]``, up to the first one outside of strings."""
    short = F.regexp_extract(text, ARRAY % section, 1)
    whole = F.regexp_extract(text, ARRAY_OF_STRINGS % section, 1)
    quotes = F.length(short) - F.length(F.replace(short, F.lit('"'), F.lit("")))
    return F.when((quotes % 2 == 1) & (whole != ""), whole).otherwise(short)


def is_json(candidate: Column) -> Column:
    """One whole JSON object and nothing after it (the bare parser stops at the first value). Of a key given
    twice the last value counts, as in any reader of JSON text."""
    alone = F.json_array_length(F.concat(F.lit("["), candidate, F.lit("]"))) == 1
    options = {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"}
    return F.coalesce(alone, F.lit(False)) & F.from_json(candidate, "_none string, _bad string", options)["_bad"].isNull()


def direct_object(reply: Column) -> Column:
    """First shortest object naming description and classes that parses; NULL if none."""
    return F.get(F.filter(F.regexp_extract_all(reply, F.lit(DIRECT), 1), is_json), F.lit(0))


def widest_braces(reply: Column) -> Column:
    """From the first ``{`` to the last ``}``; NULL if there is no such pair."""
    return F.nullif(F.regexp_extract(reply, BRACES, 0), F.lit(""))


def fenced_object(reply: Column) -> Column:
    """The first fenced object; among several fences the first that names both keys."""
    blocks = F.regexp_extract_all(reply, F.lit(FENCED), 1)
    named = F.filter(
        blocks,
        lambda b: F.contains(b, F.lit('"description"')) & F.contains(b, F.lit('"classes"')),
    )
    fences = F.size(F.split(reply, FENCE)) - 1
    first = F.get(blocks, F.lit(0))
    return F.when(fences > 2, F.coalesce(F.get(named, F.lit(0)), first)).otherwise(first)


def trim_fences(found: Column) -> Column:
    return strip(F.btrim(F.regexp_replace(found, FENCE_TAIL, ""), F.lit("`")))


def strip_bold(text: Column) -> Column:
    return F.regexp_replace(text, BOLD, '"$1"')


def join_signatures(text: Column) -> Column:
    """``"f() -> T": "d"`` and ``"f()": "d"`` become ``"f(): d"``."""
    return F.regexp_replace(F.regexp_replace(text, TYPED_SIGNATURE, '"$1: $2"'), SIGNATURE, '"$1: $2"')


def join_pairs(text: Column, section: str) -> Column:
    """Pairs inside one section's array become single strings, assignments (``"a = b": "d"``) included."""
    items = _array_of(text, section)
    joined = F.regexp_replace(items, PAIR, '"$1: $2"')
    return F.when(items != joined, F.replace(text, items, joined)).otherwise(text)


def close_functions(text: Column) -> Column:
    """A functions array left open before dependencies is closed."""
    broken = F.contains(text, F.lit('"dependencies"')) & ~text.rlike(FUNCTIONS_CLOSED)
    return F.when(broken, F.regexp_replace(text, FUNCTIONS_OPEN, '$1 ],"dependencies"')).otherwise(text)


def drop_description_colons(text: Column) -> Column:
    return F.regexp_replace(text, DESCRIPTION_COLON, "$1$2")


def parse(text: Column) -> Column:
    """NULL unless ``text`` is JSON (the guard matters: bad text would give a struct of NULLs)."""
    return F.when(is_json(text), F.from_json(text, REPLY_TYPE, {"allowSingleQuotes": "false"}))


def reply_text(reply: Column, *fields: str) -> Column:
    """Text of a reply object: the first of ``fields`` it has, else its own string form."""
    return F.coalesce(*[reply[f] for f in fields], reply.cast("string"))


def clean_summary(summary: Column) -> Column:
    """Summary text fit for a report: no thinking, no wrapping fence, no repeated or top headings."""
    return _clean_headings(let(F.regexp_replace(summary, THINKING, ""), _unwrap_fence))


def _unwrap_fence(text: Column) -> Column:
    close = F.locate(FENCE, text, 4)  # end fence, looked for behind the opening one
    line_end = F.locate("\n", text, 4)
    between = strip(F.substr(text, line_end + 1, F.greatest(close - line_end - 1, F.lit(0))))
    after = strip(F.substr(text, close + 3))
    first_break = F.locate("\n", text)
    return (
        F.when(~F.startswith(strip(text), F.lit(FENCE)), text)
        .when(close > 0, F.when(after == "", between).otherwise(F.concat(between, F.lit("\n\n"), after)))
        .when(first_break > 1, strip(F.substr(text, first_break + 1)))
        .otherwise(strip(F.replace(text, F.lit(FENCE), F.lit(""))))
    )


def _clean_headings(text: Column) -> Column:
    def level(line):
        colon = line.rlike(COLON_HEADING) & ~line.rlike(LINK_HEADING)
        kept = F.when(colon, F.left(line, F.length(line) - 1)).otherwise(line)
        return F.when(kept.rlike(TOP_HEADING), F.concat(F.lit("#"), kept)).otherwise(kept)

    # Headings by their trimmed text; every other line by NULL, which is never a repeat.
    keyed = F.transform(
        F.transform(F.split(text, "\n"), level),
        lambda line: F.struct(line.alias("line"), F.when(F.startswith(line, F.lit("#")), strip(line)).alias("head")),
    )

    def first_heads(lines):
        new = lambda x, i: x["head"].isNull() | (F.array_position(lines["head"], x["head"]) == i + 1)
        return F.array_join(F.transform(F.filter(lines, new), lambda x: x["line"]), "\n")

    return let(keyed, first_heads)


def section_lines(items: Column) -> Column:
    """A bullet list, sorted and distinct; empty text where there is nothing to list."""
    body = lambda listed: F.concat(F.lit("\n- "), F.array_join(listed, "\n- "), F.lit("\n\n"))
    return F.when(
        F.size(F.coalesce(items, F.expr("cast(array() AS array<string>)"))) > 0,
        body(F.sort_array(F.array_distinct(items))),
    ).otherwise(F.lit(""))


def error_description(error: Column) -> Column:
    return F.concat(F.lit(config.CHUNK_ERROR_PREFIX), error)
