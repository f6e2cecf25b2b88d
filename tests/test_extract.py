import time
import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hrefwarden.functions.anchors import _regular_anchors, html_anchors, parsed_anchors
from hrefwarden.functions.bibtex import bibtex_entries
from hrefwarden.operators import extract

HTML = """<html><body><h1>Title</h1>
<p>See <a href="https://one.example.com/">the first</a> and
<a     href="https://two.example.com">the second</a>.</p></body></html>"""

MARKDOWN = """
Bare <https://bare.example.com> and
[inline](https://inline.example.com) and
[titled](http://titled.example.com/p.php?id=x "A title here")
"""

TEX = r"""
\section{S} note\footnote{\url{https://url.example.com/1}} then
\href{https://href.example.com/}{its text} then
x\url{https://url.example.com/2}x
x\href[ignored]{https://optional.example.com}{other text}x
"""

BIB = """
% a comment line

@Article{Roe2020,
author  = {Ann Roe},
title   = {On {Nested {Braces}}},
doi     = { 10.1/abc },
url     = {https://bib.example.com/},
}
"""


def rows(df, *columns):
    return [tuple(row) for row in df.orderBy("path", "pos").select(*columns).collect()]


def test_html(docs):
    expected = [(0, "https://one.example.com/", "the first"), (1, "https://two.example.com", "the second")]
    assert rows(extract.html_links(docs({"a.html": HTML})), "pos", "url", "linktext") == expected
    assert rows(extract.html_links_simple(docs({"a.html": HTML})), "pos", "url", "linktext") == expected


def test_markdown_inline_comes_first(docs):
    assert rows(extract.markdown_links(docs({"a.md": MARKDOWN})), "pos", "url", "linktext") == [
        (0, "https://inline.example.com", "inline"),
        (1, "http://titled.example.com/p.php?id=x", "titled"),
        (2, "https://bare.example.com", "https://bare.example.com"),
    ]


def test_tex_href_comes_first(docs):
    assert rows(extract.tex_links(docs({"a.tex": TEX})), "pos", "url", "linktext") == [
        (0, "https://href.example.com/", "its text"),
        (1, "https://optional.example.com", "other text"),
        (2, "https://url.example.com/1", "https://url.example.com/1"),
        (3, "https://url.example.com/2", "https://url.example.com/2"),
    ]


def test_bibtex(docs):
    documents = docs({"a.bib": BIB})
    assert rows(extract.bibtex_links(documents), "url", "linktext") == [
        ("https://bib.example.com/", "Key: Roe2020, Field: Url")
    ]
    assert rows(extract.bibtex_dois(documents), "doi", "description") == [("10.1/abc", "Key: Roe2020, Field: DOI")]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("[t](http://u)", [("http://u", "t")]),
        ("[t](http://u?foo=1 \"T\")", [("http://u?foo=1", "t")]),
        ("[t](http://u 'T')", [("http://u", "t")]),
        ("[t](http://u\u00a0x)", [("http://u", "t")]),
        ("[t](http://u\x1cx)", [("http://u", "t")]),
        ("[![img](http://a)](http://b)", [("http://b", "img](http://a)")]),
        ("[t](http://u\r\nx)", [("http://u", "t")]),
        ("[two\nlines](http://u)", [("http://u", "two\nlines")]),
        ("[a](http://1) [b](http://2)", [("http://1", "a"), ("http://2", "b")]),
        ("[t](http://u", []),
        ("<b>x</b>", [("b", "b"), ("/b", "/b")]),
        ("a < b", []),
        ("> a <b> c < d", [("b", "b")]),
        ("<a\n<b>", [("a\n<b", "a\n<b")]),
    ],
)
def test_markdown_forms(docs, text, expected):
    assert rows(extract.markdown_links(docs({"a.md": text})), "url", "linktext") == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        (r"\URL{http://u}", [("http://u", "http://u")]),
        (r"\footnote{\url{http://u?id=f}}", [("http://u?id=f", "http://u?id=f")]),
        (r"\footnote{\href[o]{http://u}{t}}", [("http://u", "t")]),
        # the optional argument is read to the last bracket of the line
        (r"\href[a]{http://1}{x} \href[b]{http://2}{y}", [("http://2", "y")]),
        ("\\href[a]{http://1}{x}\n\\href[b]{http://2}{y}", [("http://1", "x"), ("http://2", "y")]),
        ("\\href{http://u}\n{t}", []),
    ],
)
def test_tex_forms(docs, text, expected):
    assert rows(extract.tex_links(docs({"a.tex": text})), "url", "linktext") == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("<a href='u'>x &amp; <b>y</b></a>", [("u", "x & y")]),
        ("<a href=u>x</a>", [("u", "x")]),
        ("<A HREF='u'>x</A>", [("u", "x")]),
        ("<a name='n'>x</a>", [(None, "x")]),
        ("<a href>x</a>", [("", "x")]),
        ("<a href='u?a=1&amp;b=2'>x</a>", [("u?a=1&b=2", "x")]),
        ("<a href='1' href='2'>x</a>", [("2", "x")]),
        ("<!-- <a href='u'>x</a> --><a href='v'>y</a>", [("v", "y")]),
        ("<script>var s = \"<a href='u'>\";</script>", []),
        ("<a href='u'>x<script>no</script>y</a>", [("u", "xy")]),
        ("<a href='u'>x<br>y<img src='i'>z</a>", [("u", "xyz")]),
        ("<a href='u'> \n <i>x</i></a>", [("u", "\nx")]),
        ("<a href='u'>  <i>x</i></a>", [("u", " x")]),
        ("<a href='u'/>after", [("u", "")]),
        ("<p><a href='u'>open</p>after", [("u", "open")]),
        ("<a href='u'>runs</p> to the end", [("u", "runs to the end")]),
        ("<a href='1'>x<a href='2'>y</a>z</a>", [("1", "x"), ("2", "y")]),
        ("<abbr>x</abbr><article>y</article>", []),
        ("", []),
    ],
)
def test_anchor_forms(text, expected):
    assert html_anchors(text) == expected


PIECES = st.sampled_from(
    ["<a href=\"u\">", "<a href='v&amp;w' class=\"c\">", "<a>", "<A HREF=\"W\">", "<a href=x>", "<a href=\"y\"/>", "</a>", "</A >", "<p>", "</p>",
     "<b class=\"k\">", "</b>", "<br>", "<br/>", "<img src='s' alt=\"t\">", "<pre>", "</pre>", "text", " ", "\n", "&amp;", "&lt;", "&copy", "a&b",
     "<!-- note -->", "<!-- <a href=\"c\"> -->", "<!-- a--b -->", "<!-->", "<!doctype html>", "<!DOCTYPE html>", "<script>", "</script>",
     "<script>if (a < b) x();</script>", "<script><!-- y --></script>", "<style>p{}</style>", "<title>t &amp; u</title>", "<textarea> x </textarea>",
     "<title>", "</title>", "<title></title>", "<noscript></noscript>", "<![foo[", "<![ foo", "<a href='x", "<", ">", "\"", "<?pi?>", "<![CDATA[x]]>", "<a b=\"<\">", "<rt>r</rt>", "<template>t</template>", "<plaintext>", "\0", "é"]
)


@settings(max_examples=3000, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_regular_markup_is_read_as_the_parser_reads_it(text):
    quick = _regular_anchors(text)
    assert quick is None or quick == parsed_anchors(text)


def test_real_pages_are_regular():
    pq = pytest.importorskip("pyarrow.parquet")
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()
    quick = [_regular_anchors(page) for page in pages]
    assert None not in quick and quick == [parsed_anchors(page) for page in pages]


def test_bibtex_forms():
    text = """
    @string{base = "http://m.example.com/"}
    @comment{ignored = {x}}
    @preamble{"p"}
    @misc(round, URL = base # {x}, year = 2020, month = jan)
    @misc{quoted, url = "http://q.example.com/{a"b}", url = {second}, }
    @misc{broken, url = {http://never closed
    @misc{after, url = {http://a.example.com}}
    @misc{unknown, url = nosuchmacro}
    @misc{nofields}
    """
    found = list(bibtex_entries(text))
    entries = {key: fields for key, fields in found if key}
    problems = [text for key, text in found if key is None]
    assert entries["round"]["url"] == "http://m.example.com/x"
    assert entries["quoted"]["url"] == 'http://q.example.com/{a"b}'
    assert entries["after"]["url"] == "http://a.example.com"
    assert entries["nofields"] == {}
    assert len(problems) == 2 and "never closed" in problems[0] and "nosuchmacro" in problems[1]


def doubling(first, lines):
    return f"@string{{a0 = {first}}}\n" + "".join(f"@string{{a{k} = a{k - 1} # a{k - 1}}}\n" for k in range(1, lines + 1))


@pytest.mark.parametrize("first", ["{x}", "{}", '"ab"'])
def test_macros_that_double_each_other_cost_nothing(first):
    for lines in (20, 60, 30_000):
        text = doubling(first, lines) + f"@misc{{k, note = a{lines}, url = a{lines} # {{/p}}, doi = {{10.1/x}}}}\n@misc{{l, url = a3}}"
        tracemalloc.start()
        started = time.monotonic()
        found = list(bibtex_entries(text, ("url", "doi")))
        assert time.monotonic() - started < 5 and tracemalloc.get_traced_memory()[1] < 100 * len(text) + (64 << 20)
        tracemalloc.stop()
        problems, entries = [text for key, text in found if key is None], {key: fields for key, fields in found if key}
        small = first == "{}"
        assert entries["k"]["doi"] == "10.1/x" and entries["l"]["url"] == first[1:-1] * 8
        assert entries["k"].get("url") == ("/p" if small else None)
        assert len(problems) == (0 if small else 1) and all("characters, field 'url' of 'k'" in p for p in problems)


def test_many_long_values_are_a_problem_in_all():
    text = doubling("{x}", 18) + "".join(f"@misc{{k{k}, url = a18}}\n" for k in range(200)) + "@misc{plain, url = {http://u}}"
    found = list(bibtex_entries(text))
    lengths = [len(fields["url"]) for key, fields in found if key and "url" in fields]
    assert lengths == [1 << 18] * 64 + [8] and sum(key is None for key, _ in found) == 136


def test_a_bomb_is_a_row(docs):
    text = doubling("{x}", 60) + "@misc{k, url = a60, doi = {10.1/x}}"
    found = extract.findings(docs({"a.bib": text, "b.bib": "@misc{k, url = {http://u}}"}))
    assert sorted(rows(found, "path", "kind", "value"), key=str) == [
        ("a.bib", "doi", "10.1/x"), ("a.bib", "problem", None), ("b.bib", "link", "http://u")
    ]


@pytest.mark.parametrize("n", [1, 49, 50, 51, 100])
def test_no_doi_of_a_long_bibliography_is_lost(docs, n):
    text = "\n".join(f"@misc{{k{i}, doi = {{10.1/{i}}}}}" for i in range(n))
    assert extract.bibtex_dois(docs({"a.bib": text})).count() == n


def test_findings_of_all_formats_in_one_pass(docs, spark):
    documents = docs(
        {"a.html": HTML, "b.htm": HTML, "c.md": MARKDOWN, "d.tex": TEX, "e.bib": BIB, "f.txt": MARKDOWN, "g.md": "", "h.bib": "@x{"}
    )
    found = extract.findings(documents)
    counts = {(r["path"], r["kind"]): r["count"] for r in found.groupBy("path", "kind").count().collect()}
    assert counts == {
        ("a.html", "link"): 2, ("b.htm", "link"): 2, ("c.md", "link"): 3, ("d.tex", "link"): 4,
        ("e.bib", "link"): 1, ("e.bib", "doi"): 1, ("h.bib", "problem"): 1,
        ("f.txt", "problem"): 1,
    }
    assert extract.links_of(extract.findings(documents, (".md",))).select("path").distinct().count() == 1
    with pytest.raises(ValueError):
        extract.findings(documents, (".txt",))


def test_long_texts_are_read_whole_and_in_time(docs):
    """Megabytes of brackets that open and never close, and a link behind them."""
    n = 300_000
    texts = {
        "a.md": "[" * n + "<" * n + "[t](http://u) <http://v>" + "<" * n + "[" * n,
        "b.tex": "\\href{" * 1000 + "x" * n + "\n\\url{http://u}",
        "c.html": "<p>" * n + "<a href='http://u'>t</a>" + "<" * n,
    }
    found = extract.findings(docs(texts)).groupBy("path").count()
    assert {r["path"]: r["count"] for r in found.collect()} == {"a.md": 2, "b.tex": 1, "c.html": 1}


@pytest.mark.parametrize(
    "text",
    ["<a href=x>t</a><![foo[", "<![ foo", "<a href='x'>y" * 80_000, "<a href='x" * 100_000, "<a b=\"'>" * 100_000,
     "<a href='u'><title></title>" * 40_000, "<!-- x <a " * 100_000, "<![foo " * 150_000, "<?x " * 200_000, "<" * 500_000],
)
def test_malformed_html_takes_linear_time(text):
    started = time.monotonic()
    found = html_anchors(text)
    assert time.monotonic() - started < 5
    assert sum(len(label) for _, label in found) <= len(text)


@pytest.mark.parametrize("entry", ["@misc{k, url={x\n", "@misc{k, url={x", '@misc{k, url="x\n', '@misc{k, url="{x}\n'])
def test_unclosed_entries_take_linear_time(entry):
    started = time.monotonic()
    list(bibtex_entries(entry * (1_000_000 // len(entry))))
    assert time.monotonic() - started < 5


def test_a_document_that_breaks_the_parser_is_a_problem(docs, monkeypatch):
    def broken(text):
        raise AssertionError(text)

    found = extract._batch(pa.array(["x", None, "<a>"]), broken).to_pylist()
    assert [[row["kind"] for row in rows] for rows in found] == [["problem"], [], ["problem"]]
    texts = {"a.html": "<a href='u'>t</a><![foo[bar]]>", "b.html": "<a href='v'><![ foo"}
    assert sorted(rows(extract.html_links(docs(texts)), "url")) == [("u",), ("v",)]


def test_formats_without_extractor_are_reported(docs):
    texts = {"http://site/a": "[t](http://u)", "b.HTML": "", "c.txt": "x", "d.md": "[t](http://u)"}
    found = extract.findings(docs(texts))
    assert sorted(rows(extract.problems_of(found), "path")) == [("b.HTML",), ("c.txt",), ("http://site/a",)]
    assert extract.links_of(found).count() == 1
