import html as markup
import os
import re

import pytest

from corpuslens.llm import pages as op

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TEXT = "A first paragraph of some length, as articles have them.", "A second one &amp; its &quot;signs&quot;, caf&eacute; &#8364;5."
PLAIN = "A first paragraph of some length, as articles have them.\nA second one & its \"signs\", café €5."


def body(content: str, start: str = "<article>", end: str = "</article>") -> str:
    return (
        "<!DOCTYPE html><html><head><title>Site</title><style>p{color:red}</style><script>var a='<p>no</p>';</script></head><body>"
        "<header><h1>Site name</h1></header><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></ul></nav>"
        f"<div class='cookie-notice'>We use cookies</div>{start}{content}{end}<aside><p>Read also this</p></aside>"
        "<div id=comments><article class=comment><p>First! A very long comment by a reader that says a lot and goes on and on.</p></article></div>"
        "<form><label>Mail</label><input><button>Send</button></form><div class='ad'>Buy now</div><footer>&copy; us</footer></body></html>"
    )


@pytest.mark.parametrize(
    "content, expected",
    [
        ("<h1>Title</h1><p>{}</p><p>{}</p>", "Title\n" + PLAIN),
        ("<p>{}<p><b>{}", PLAIN),
        ("<p>{}</p><!-- <p>gone</p> --><script>x()</script><p>{}</p>", PLAIN),
        ("<header><h1>Title</h1><p>by me</p></header><p>{}</p><div class='share social'>Share</div><p>{}</p><footer>tags</footer>", "Title\n" + PLAIN),
        ("<section><p>{}</p></section><section class='part-2'><p>{}</p></section>", PLAIN),
        ("<p>{}</p><form><p>Subscribe</p></form><p hidden>hid</p><p style='display: none'>hid</p><p>{}</p>", PLAIN),
        ("<ul><li>{}<li>{}</ul>", PLAIN),
        ("<table><tr><td>{}<td>{}</table>", PLAIN),
    ],
)
@pytest.mark.parametrize("frame", [("<article>", "</article>"), ("<main><div class='x y9'>", "</div></main>"), ("<article>", "")])
def test_main_text_without_the_rest(content, expected, frame):
    assert op.main_text(body(content.format(*TEXT), *frame)) == expected


def test_div_pages_without_any_hint():
    page = body("<h2>Title</h2><p>{}</p><p>{}</p>".format(*TEXT), "<div class=content>", "</div>")
    assert op.main_text(page) == "Title\n" + PLAIN


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""), ("no tags,\n  a &lt; b", "no tags, a < b"), ("a < b > c", "a < b > c"), ("<p>a<br>b  \n c</p>", "a b c"), ("<p>x &am", "x &am"),
        ("<p>one</p>two<div>three", "one\ntwo\nthree"), ("<script>only()</script>", ""), ("<p title='a>b'>c", "c"), ("<b><p>one</b> two</p>", "one two"),
        ("<pre>a\n  b</pre>", "a b"), ("<!-- open", ""), ("<p>kept</p><p class=", "kept"), ("</p></div>x", "x"), ("<nav>only a menu</nav>", ""),
    ],
)
def test_broken_and_small_pages(page, text):
    assert op.main_text(page) == text


def test_deep_and_long_pages():
    deep = "".join(f"<div>t{i} " for i in range(5000))
    assert op.main_text(deep).split() == [f"t{i}" for i in range(5000)]
    long = body("".join(f"<p>paragraph {i} with &amp; and more words</p>" for i in range(100_000)))
    assert op.main_text(long).count("\n") == 99_999


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", ["y"], 3) for r in rows], "page_id long, url string, html string, host string, paths array<string>, text int").repartition(3)


def texts(found):
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    rows = found.collect()
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    return sorted((r["page_id"] is not None, r["page_id"] or 0, r["text"]) for r in rows)


def test_a_host_agrees_on_its_paths(spark):
    page = lambda i, story, offers: f"<body><div class='story s{i}'><p>{story}</p></div><div class='offers'><p>{offers}</p></div></body>"
    story, offer = "Some words of the story, rather many of them. ", "An offer that is no story at all. "
    rows = [(i, "http://H.example/x", page(i, story * 4, f"<a href='/'>{offer}</a>")) for i in range(6)]
    rows.append((10, "https://u:p@h.example:80/y?z", page(10, story * 2, offer * 2)))  # alone, it would be all of it
    other = f"<body><div class='offers'><p>{offer * 3}</p></div></body>"
    rows += [(11, "http://h.example/z", other), (12, "http://alone.example", page(3, story * 2, offer * 2))]
    rows += [(13, None, other), (14, "no url", page(1, story * 2, offer * 2)), (15, "http://h.example/", None), (16, "http://h.example/", ""), (None, "http://h.example", other)]
    found = {(k, i): t for k, i, t in texts(op.extract(table(spark, rows)))}
    assert len(found) == len(rows)
    assert all(found[True, i] == (story * 4).strip() for i in range(6))
    assert found[True, 10] == (story * 2).strip()  # by consensus
    assert found[True, 11] == found[True, 13] == found[False, 0] == (offer * 3).strip()  # follows no path, keeps its own best
    assert found[True, 12] == found[True, 14] == (story * 2).strip() + "\n" + (offer * 2).strip()  # nobody to agree with
    assert found[True, 15] == found[True, 16] == ""
    paths = {r["host"]: r["paths"] for r in op.host_paths(table(spark, rows)).collect()}
    assert paths["h.example"] == [">body>div.s.story", ">body>div.offers", ">body"]
    assert set(paths) == {"h.example", "alone.example"}


def test_votes_and_texts_as_by_hand(spark):
    """The job against the same pages one by one: votes counted in a dictionary, every path tried in order."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    votes, rows = {}, pages.collect()
    for r in rows:
        votes.setdefault(r["url"].split("/")[2].lower(), []).append(op.vote(r["html"]))
    ranked = {h: sorted(set(p), key=lambda x: (-p.count(x), x))[: op.PATHS] for h, p in votes.items()}
    expected = sorted((True, r["page_id"], op.main_text(r["html"], ranked[r["url"].split("/")[2].lower()])) for r in rows)
    assert texts(op.extract(pages)) == expected


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_given_pages_against_their_articles(spark):
    """Another way to the same text: what stands between the article's tags, cut at tags that part blocks."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    expected = []
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(markup.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?p>|</?h1>", article)]
        expected.append((True, r["page_id"], "\n".join(filter(None, parts))))
    assert texts(op.extract(pages)) == sorted(expected)


def test_repeated_rows_and_empty_table(spark):
    page = body("<p>{}</p><p>{}</p>".format(*TEXT))
    assert texts(op.extract(table(spark, [(1, "http://a.b/c", page)] * 3))) == [(True, 1, PLAIN)] * 3
    assert texts(op.extract(table(spark, [(1, "u", "x")]).limit(0))) == []


def test_hosts(spark):
    urls = ["http://A.b/c", "https://x.y:8/", "ftp://u@h?q", "//no.scheme/", "mailto:a@b", "", None, "http:///x"]
    found = spark.createDataFrame([(u,) for u in urls], "url string").select(op.host_of("url")).collect()
    assert [r[0] for r in found] == ["a.b", "x.y", "h", None, None, None, None, None]
