import pytest
from pyspark.sql import functions as F

from hrefwarden.functions import urls

NORMALIZED = [
    ("HTTP://Ex.COM", "http://ex.com/"),
    ("http://ex.com:80/a", "http://ex.com/a"),
    ("https://ex.com:443", "https://ex.com/"),
    ("https://ex.com:80/a", "https://ex.com:80/a"),
    ("http://ex.com:8080/a", "http://ex.com:8080/a"),
    ("http://ex.com//a///b//?x=1//2", "http://ex.com/a/b/?x=1//2"),
    ("http://ex.com/?b=2&a=1#f", "http://ex.com/?a=1&b=2"),
    ("http://ex.com/?a=2&a=1", "http://ex.com/?a=2&a=1"),
    ("http://ex.com/?a=1&a=1", "http://ex.com/?a=1&a=1"),
    ("http://ex.com/?&&b=1&", "http://ex.com/?b=1"),
    ("http://ex.com/?=1&=2", "http://ex.com/?=1&=2"),
    ("http://ex.com/?", "http://ex.com/"),
    ("http://ex.com/?flag&b", "http://ex.com/?b&flag"),
    ("http://ex.com?z=1", "http://ex.com/?z=1"),
    ("http://ex.com/#a?b=1", "http://ex.com/"),
    ("http://ex.com/x?a=b?c", "http://ex.com/x?a=b?c"),
    ("http://u:P@Ex.com:8080/", "http://u:P@ex.com:8080/"),
    ("http://[::1]:80/x", "http://[::1]/x"),
    (" http://ex.com/ ", "http://ex.com/"),
    ("\nhttp://ex.com/\t", "http://ex.com/"),
    ("http://a_b.com/ü", "http://a_b.com/ü"),
    ("httpfoo", "httpfoo"),
    ("http://", "http://"),
    ("http:///path", "http:///path"),
    ("https://www.example.com/index.html#one", "https://www.example.com/index.html"),
    ("https://www.example.com/index.html#two", "https://www.example.com/index.html"),
    (None, None),
]

HOSTS = [
    ("http://www.Example.com/x", "www.example.com"),
    ("http://user:pw@Host.org:8080/x", "host.org"),
    ("http://a@b@host.org/", "host.org"),
    ("http://under_score.org", "under_score.org"),
    ("http://bücher.example/", "bücher.example"),
    ("http://[2001:DB8::1]:80/", "2001:db8::1"),
    ("http://host.org?x=a@b", "host.org"),
    ("http://host.org#a@b", "host.org"),
    ("http://host.org/a b%zz", "host.org"),
    ("http://:80/", None),
    ("http://", None),
    ("httpfoo", None),
    (None, None),
]


def _apply(spark, values, function):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, url string")
    return [row[0] for row in function(rows).orderBy("i").select("out").collect()]


def test_normalized_urls(spark):
    got = _apply(spark, [u for u, _ in NORMALIZED], lambda df: urls.with_normalized_url(df, "url", "out"))
    assert got == [n for _, n in NORMALIZED]


def test_normalizing_twice_changes_nothing(spark):
    got = _apply(spark, [n for _, n in NORMALIZED], lambda df: urls.with_normalized_url(df, "url", "out"))
    assert got == [n for _, n in NORMALIZED]


def test_query_can_be_kept(spark):
    got = _apply(
        spark, ["http://ex.com/?b=2&&a=1"], lambda df: urls.with_normalized_url(df, "url", "out", keep_query=True)
    )
    assert got == ["http://ex.com/?b=2&&a=1"]


def test_hostnames(spark):
    got = _apply(spark, [u for u, _ in HOSTS], lambda df: df.withColumn("out", urls.hostname(F.col("url"))))
    assert got == [h for _, h in HOSTS]


def test_scheme_is_case_sensitive(spark):
    values = ["http://a", "https://a", "httpfoo", "HTTP://a", "mailto:a@b", "ftp://a", "/rel", "", None]
    got = _apply(spark, values, lambda df: df.withColumn("out", urls.scheme_class(F.col("url"))))
    assert got == ["http", "http", "http", "unsupported", "mailto", "unsupported", "unsupported", "unsupported", "missing"]


def test_suffixes(spark):
    values = ["/a/b.md", "b.tar.html", "/a/.md", "/a/b", "/a.d/b", "x.", "..md", "/a/b.HTML", "a.htmlandmore"]
    got = _apply(spark, values, lambda df: df.withColumn("out", urls.suffix_of(F.col("url"))))
    assert got == [".md", ".html", "", "", "", "", ".md", ".HTML", ".htmlandmore"]
    got = _apply(spark, values, lambda df: df.withColumn("out", urls.is_supported(F.col("url"))))
    assert got == [True, True, False, False, False, False, True, False, False]


def test_path_is_rewritten_once(spark):
    values = ["/srv/www/a.md", "/srv/www/srv/www/a.md", "/else/a.md", "/x/srv/www/a.md"]
    rewritten = lambda df: df.withColumn("out", urls.rewrite_path(F.col("url"), "/srv/www", "https://e.com/"))
    assert _apply(spark, values, rewritten) == [
        "https://e.com/a.md", "https://e.com/srv/www/a.md", "/else/a.md", "/xhttps://e.com/a.md",
    ]
    for folder, url in (("", "x"), ("x", "")):
        with pytest.raises(ValueError):
            urls.rewrite_path(F.col("url"), folder, url)
