"""The main text of web pages by paths that a host's pages agree on (operator 12).

Consensus host paths. First every page alone: its containers (``div``, ``article``, ``td``, ...) are scored by
the text they hold outside links, menus and the like, less the text of what they would drag along; the best
one votes with its generalised path, the tags and classes of the containers around it with digits taken out.
Spark counts the votes of each host and keeps its ``PATHS`` most voted paths. Then every page is read again:
the first of its host's paths that the page has, and whose containers score at least half as much as the
page's own best, gives the text; a page that follows none of them keeps its own best container.

Votes are counted with map-side combining, so a host of a third of all pages is a few rows a task; pages meet
their host's paths in a join that is broadcast while the paths are few and cuts hot hosts otherwise.

Left out of a container: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, hidden
parts and reader comments, told by tag, role, class and id. Of a ``header`` within an article its headings stay.
Character references are decoded; white space (as Python's ``str.split`` sees it) within a block becomes one
space, as does ``br``; blocks are joined by one newline in the order of the page.

Cases: NULL and empty pages give an empty text; broken markup is closed as browsers do it; a page without any
tag is its own text; a page whose URL names no host votes for nobody and keeps its own best container. Repeated
rows get equal texts. Beyond ``DEPTH`` open elements no further ones are told apart (their text is kept).
Memory follows one page. An empty table gives no rows. Columns of other names are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.llm.batches import column, slices
from corpuslens.llm.shared import keep
from corpuslens.operators.skew import lookup_join

#: Paths kept for each host, most voted first; a page without any of them is served by its own best.
PATHS = 16
#: A consensus path serves a page if it scores at least this share of the page's own best.
SHARE = 0.5
DEPTH = 256

# Names of the markup language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = set("article body center div main section td th".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes first, and where the search for it ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"}),
}
FENCE = {"table", "td", "th", "caption", "button", "object", "template", "html"}

# What is no main text, by tag, role, and word of a class or id.
DROPPED = set("head script style noscript template textarea title xmp iframe noembed noframes svg canvas audio video object select button nav aside footer form dialog".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
WORDS = set(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar cookie cookies consent gdpr "
    "notice notices alert banner popup modal overlay ad ads adv advert adverts advertisement advertising sponsor sponsored promo promos "
    "promotion newsletter subscribe subscription signup login form share sharing social related recommended pagination pager widget widgets "
    "skip".split()
)
COMMENTS = set("comment comments commentlist disqus respond".split())
#: Names such as ``has-sidebar`` say what is beside an element.
BESIDE = set("has with without no is not".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_MARK = re.compile(r"<(?:[a-zA-Z/!?])")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "kids", "path", "junk", "soft", "main", "good", "bad")

    def __init__(self, tag: str, parent: Node | None, path: str = "", junk: bool = False, soft: bool = False, main: bool = False):
        self.tag, self.parent, self.path, self.main = tag, parent, path, main
        self.junk, self.soft = junk, soft  # soft: told by a class or id, which an article within overrules
        self.kids: list = []  # nodes, texts, and None for a break between blocks
        self.good = self.bad = 0


def _hints(attributes: dict[str, str]) -> tuple[bool, bool]:
    """Do class or id name something that is no main text; and is it comments?"""
    junk = comments = False
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w.lower() for w in _WORD.findall(name)]
        if words and words[0] in BESIDE:
            continue
        junk = junk or not WORDS.isdisjoint(words)
        comments = comments or not COMMENTS.isdisjoint(words)
    return junk, comments


def _open(tag: str, written: str, parent: Node) -> Node:
    attributes = {}
    for name, *values in _ATTRIBUTE.findall(written):
        attributes.setdefault(name.lower(), next(filter(None, values), ""))
    role = attributes.get("role", "").lower()
    main = tag in ("article", "main") or role == "main" or "articlebody" in attributes.get("itemprop", "").lower()
    hint, comments = _hints(attributes) if tag not in ("body", "html") else (False, False)
    hard = tag in DROPPED or role in ROLES or "hidden" in attributes or bool(_HIDDEN.search(attributes.get("style", ""))) or comments
    path = parent.path
    if tag in CONTAINERS:
        classes = sorted({re.sub(r"\d+", "", c) for c in unescape(attributes.get("class", "")).split()} - {""})
        path = f"{path}>{'.'.join([tag, *classes])}"
    node = Node(tag, parent, path, hard or hint and not main, not hard, main and not comments)
    if node.main and not hard:
        at = parent
        while at is not None and not (at.junk and not at.soft):
            at.junk, at = False, at.parent
    return node


def parse(html: str) -> list[Node]:
    """All elements in the order of the page; the first stands for the page."""
    root = Node("html", None)
    nodes, stack, at, n = [root], [("html", root)], 0, len(html)

    def close(names: set[str], fence: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                leave(i)
                return
            if stack[i][0] in fence:
                return

    def leave(i: int) -> None:
        if any(tag in BLOCKS for tag, _ in stack[i:]):
            stack[i - 1][1].kids.append(None)
        del stack[i:]

    while at < n:
        mark = _MARK.search(html, at)
        if not mark:
            stack[-1][1].kids.append(html[at:])
            break
        if mark.start() > at:
            stack[-1][1].kids.append(html[at : mark.start()])
        at = mark.start()
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        found = _TAG.match(html, at)
        if not found:  # a declaration, or a tag that never ends
            end = html.find(">", at)
            at = n if end < 0 else end + 1
            continue
        at = found.end()
        tag = found[2].lower()
        if found[1]:
            inline = tag not in BLOCKS and tag not in DROPPED
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    leave(i)
                    break
                if inline and stack[i][0] in BLOCKS or stack[i][0] in ("td", "th") and tag not in ("tr", "table", "tbody", "thead", "tfoot", "td", "th"):
                    break  # what was opened outside of a block is not closed within it
            else:
                if tag in BLOCKS:
                    stack[-1][1].kids.append(None)
            continue
        if tag in BLOCKS:
            close({"p"}, FENCE)
        if tag in HEADINGS and stack[-1][0] in HEADINGS:
            leave(len(stack) - 1)
        if tag in CLOSES:
            close(*CLOSES[tag])
        parent = stack[-1][1]
        if tag in ("html", "body") and tag in {t for t, _ in stack}:
            if tag == "body" or len(stack) > 1:
                continue
        if tag == "br":
            parent.kids.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                parent.kids.append(None)
            continue
        if len(stack) > DEPTH:
            node = parent
            if tag in BLOCKS:
                parent.kids.append(None)
        else:
            node = _open(tag, found[3], parent)
            parent.kids.append(node)
            nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            at = n if not end else end.start()
            if not end:
                break
        if found[3].endswith("/") and tag in ("svg", "path"):
            continue
        stack.append((tag, node))
    return nodes


def score(nodes: list[Node]) -> None:
    """``good``: letters outside links, ``bad``: letters that would be dragged along, for every element."""
    state: dict[int, tuple[bool, bool, Node]] = {}
    size: dict[int, list[int]] = {}
    for node in nodes:
        junk, link, block = state[id(node.parent)] if node.parent is not None else (False, False, node)
        junk = junk or node.junk or node.tag == "header"
        link = link or node.tag == "a"
        block = node if node.tag in BLOCKS or node.parent is None else block
        state[id(node)] = (junk, link, block)
        letters = sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        if junk:
            node.bad += letters
        elif letters:
            held = size.setdefault(id(block), [0, 0])
            held[0] += letters
            held[1] += letters if link else 0
    for node in reversed(nodes):
        letters, linked = size.get(id(node), (0, 0))
        node.good += max(0, letters - 2 * linked)
        node.bad += max(0, 2 * linked - letters)
        if node.parent is not None:
            node.parent.good += node.good
            node.parent.bad += node.bad
    for node in nodes:  # what lies in a part that is left out is no candidate
        if state[id(node)][0]:
            node.good = 0


def worth(node: Node) -> float:
    # an element that says it is the main text is believed: what does not belong there is left out anyway
    return 1.5 * node.good - 0.25 * node.bad if node.main else node.good - node.bad


def best(nodes: list[Node]) -> Node | None:
    """The container of highest worth, the innermost of equal ones."""
    found = None
    for node in nodes:
        if (node.tag in CONTAINERS or node.parent is None) and node.good > 0:
            if found is None or worth(node) > worth(found) or worth(node) == worth(found) and _within(node, found):
                found = node
    return found


def _within(node: Node, other: Node) -> bool:
    at = node.parent
    while at is not None and at is not other:
        at = at.parent
    return at is other


def blocks(container: Node) -> list[str]:
    """The texts of its blocks, without what is no main text."""
    found, run = [], []

    def flush() -> None:
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text:
                found.append(text)
            run.clear()

    inside = any_main(container)
    todo = [(iter(container.kids), True, False, inside)]
    while todo:
        kids, block, header, inside = todo[-1]
        for kid in kids:
            if kid is None:
                flush()
            elif isinstance(kid, str):
                if not header:
                    run.append(kid)
            elif not kid.junk and (kid.tag != "header" or inside):
                block = kid.tag in BLOCKS
                if block:
                    flush()
                todo.append((iter(kid.kids), block, (header or kid.tag == "header") and kid.tag not in HEADINGS, inside or kid.main))
                break
        else:
            if block:
                flush()
            todo.pop()
    flush()
    return found


def any_main(node: Node | None) -> bool:
    while node is not None and not node.main:
        node = node.parent
    return node is not None


def matching(nodes: list[Node], path: str) -> list[Node]:
    """Elements of this path that hold main text, none within another."""
    found: list[Node] = []
    for node in nodes:
        if node.path == path and node.tag in CONTAINERS and node.good > 0 and not (found and _within(node, found[-1])):
            found.append(node)
    return found


def main_text(html: str, paths: list[str] | None = None, share: float = SHARE) -> str:
    """The main text by the first of ``paths`` that suits the page, else by its own best container."""
    nodes = parse(html)
    score(nodes)
    own = best(nodes)
    if own is None:
        return ""
    chosen = [own]
    for path in paths or []:
        if path == own.path and worth(own) <= 0:
            break
        match = matching(nodes, path)
        if match and sum(map(worth, match)) >= share * worth(own):
            chosen = match
            break
    return "\n".join(text for node in chosen for text in blocks(node))


def vote(html: str) -> str | None:
    nodes = parse(html)
    score(nodes)
    found = best(nodes)
    return found.path if found is not None and found.path else None


def host_of(url: str | Column) -> Column:
    """The host that a URL names, in lower case; NULL where it names none."""
    host = F.regexp_extract(F.col(url) if isinstance(url, str) else url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", F.lower(host))


def host_paths(pages: DataFrame, paths: int = PATHS) -> DataFrame:
    """``host, paths``: the paths that most pages of a host vote for, most voted first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            votes = [vote(html) if html else None for html in column(part, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(part, "host"), pa.array(votes, pa.string())], ["host", "path"])

    held = pages.select(host_of("url").alias("host"), F.col("html").cast("string").alias("html")).filter("host IS NOT NULL")
    counted = held.mapInArrow(run, "host string, path string").filter("path IS NOT NULL").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))
    # a host of very many paths is cut before it is ranked whole
    order = [F.desc("votes"), F.col("path")]
    first = Window.partitionBy("host", F.pmod(F.xxhash64("path"), F.lit(64))).orderBy(*order)
    whole = Window.partitionBy("host").orderBy(*order)
    ranked = counted.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= paths)
    ranked = ranked.withColumn("place", F.row_number().over(whole)).filter(F.col("place") <= paths)
    listed = F.sort_array(F.collect_list(F.struct("place", "path")))
    return ranked.groupBy("host").agg(F.transform(listed, lambda p: p["path"]).alias("paths"))


def extract(pages: DataFrame, paths: int = PATHS, share: float = SHARE) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""
    agreed = keep(host_paths(pages, paths), "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            pairs = zip(column(part, "html").to_pylist(), column(part, "paths").to_pylist())
            texts = [main_text(html, held, share) if html else "" for html, held in pairs]
            yield pa.RecordBatch.from_arrays(
                [column(part, "page_id"), column(part, "url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    held = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of("url").alias("host"))
    joined = lookup_join(held, agreed, ["host"], ["page_id"]).select("page_id", "url", "html", "paths")
    kind = pages.schema["page_id"].dataType.simpleString()
    texts = joined.mapInArrow(run, f"page_id {kind}, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
