"""Patterns on texts made to be slow: the same links as a plain search, and in time."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from hrefwarden.functions import markup

MD = re.compile(r"\[([^\[]*)\]\(([^\)]*?)[\s\)]+")
POINTY = re.compile(r"<([^>]*?)>")
HREF = re.compile(r"\\href(?:\[.*\])?\{([^}]*)\}\{([^}]*?)\}", re.I)
SIMPLE = re.compile(r'<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', re.I | re.S)

WAYS = {
    "md_inline": (markup.md_inline, lambda t: [(u, x) for x, u in MD.findall(t)], ["[", "]", "](", "(", ")", " ", "\n", "a", "\u00a0", "\x1c", "http://u", "é", "\U0001f600"]),
    "md_pointy": (markup.md_pointy, lambda t: [(u, u) for u in POINTY.findall(t)], ["<", ">", "a", "\n", "é"]),
    "tex_href": (markup.tex_href, HREF.findall, ["\\href", "\\HREF", "\\href{", "\\href[", "[", "]", "]{", "{", "}", "}{", "}{", "{u}{t}", "\n", "a", "\x01", "\x010", "\x011", "é", "\r", "\u2028"]),
    "html_simple": (markup.html_simple, SIMPLE.findall, ["<a ", "<A\n", "<a", 'href="', 'HREF="', '"', ">", "</a>", "</A>", "<", "x", "é", " ", "<b>"]),
}


@pytest.mark.parametrize("name", list(WAYS))
def test_same_links_as_a_plain_search(spark, name):
    links, plain, pieces = WAYS[name]
    rng = random.Random(name)
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(6000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, content string").repartition(4)
    found = {r.k: [tuple(link) for link in r.links] for r in rows.select("k", links(F.col("content")).alias("links")).collect()}
    wrong = [(text, plain(text), found[k]) for k, text in enumerate(texts) if plain(text) != found[k]]
    assert not wrong, wrong[:3]
    assert sum(map(len, found.values())) > 300


HOSTILE = {
    "md_inline": ["[a](", "[](](", "[", "](", "[a]( ", "[a](b)", "[a](\n[b", "[a](x", "]()["],
    "md_pointy": ["<", "<a", "<a\n", "<>"],
    "tex_href": [r"\href{", r"\href{u", r"\href[", r"\href[]{", r"\href[x]{u", r"\href{u}", r"\href[a\href{b", r"]{}\href[", r"\href[]{u}{t}", "\\href[a]{\n", r"\href[}{", r"}{\href[", r"\href]{}"],
    "html_simple": ['<a href="x">', '<a href="x"', "<a ", '<a href="', '<a href="x">t</a>', '<a href=">', '<a "', '<a href="x"<', "<a </a>"],
}
ENDS = {
    "md_inline": ["", "[t](http://u)", ")"],
    "md_pointy": ["", "<http://u>"],
    "tex_href": ["", r"\href{http://u}{t}", "}", "}{", "]{u}{t}", "\n\\href[a]{u}{t}"],
    "html_simple": ["", "</a>", '"><a href="http://u">t</a>', '<a href="u', "></a>"],
}


@pytest.mark.parametrize("name", list(WAYS))
def test_a_megabyte_takes_seconds(spark, name):
    links = WAYS[name][0]
    texts = [(piece, end, piece * (1_000_000 // len(piece)) + end) for piece in HOSTILE[name] for end in ENDS[name]]
    rows = spark.createDataFrame(texts[:1], "piece string, end string, content string")
    rows.select(F.size(links(F.col("content")))).collect()
    for row in texts:
        one = spark.createDataFrame([row], rows.schema).select(F.size(links(F.col("content"))))
        started = time.monotonic()
        one.collect()
        assert time.monotonic() - started < 5, row[:2]
