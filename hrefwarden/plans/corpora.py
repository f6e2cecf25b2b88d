"""Document corpora, logs and caches derived from the test tables.

The tables hold pages with absolute URLs but no documents that link to them.
These projections write the URLs into documents of each format, and make the
recorded answers and the cache from the same rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefwarden import scratch
from hrefwarden.functions import urls

AS_OF = dt.datetime(2024, 1, 2, tzinfo=dt.timezone.utc)
PAGES_PER_DOCUMENT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def pages_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as a stream of its files, whether the table is a folder of files or one file."""
    path = f"{sf_dir}/pages.parquet"
    reader = spark.readStream.schema("page_id long, url string, html string")
    if scratch.path_kind(spark, path) == "file":  # streams read folders only
        return reader.option("pathGlobFilter", "pages.parquet").parquet(sf_dir)
    return reader.parquet(path)


def _text(*parts) -> Column:
    return F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts])


def _id() -> Column:
    return F.col("page_id").cast("string")


def markdown_corpus(spark, sf_dir) -> DataFrame:
    """Documents per host, of at most ``PAGES_PER_DOCUMENT`` pages each."""
    url = F.col("url")
    line = _text(
        "[page ", _id(), "](", url, ' "t")\n', F.when(F.col("page_id") % 4 == 0, _text("<", url, ">\n")).otherwise("")
    )
    return (
        pages(spark, sf_dir)
        .groupBy(
            urls.hostname(url).alias("host"),
            F.floor(F.col("page_id") / PAGES_PER_DOCUMENT).cast("string").alias("chunk"),
        )
        .agg(F.sort_array(F.collect_list(F.struct("page_id", line.alias("line")))).alias("lines"))
        .select(
            _text("/corpus/", F.col("host"), "/", F.col("chunk"), ".md").alias("path"),
            F.array_join(F.col("lines.line"), "").alias("content"),
        )
    )


def _tex(url: Column, name: Column) -> Column:
    return F.when(F.col("page_id") % 2 == 0, _text("\\href[x]{", url, "}{page ", name, "}")).otherwise(
        _text("\\url{", url, "}")
    )


def tex_documents_of(page_rows: DataFrame) -> DataFrame:
    """One TeX document per page; works on a table as on a stream of pages."""
    return page_rows.select(
        _text("/corpus/", _id(), ".tex").alias("path"), _tex(F.col("url"), _id()).alias("content")
    )


def tex_corpus(spark, sf_dir) -> DataFrame:
    return tex_documents_of(pages(spark, sf_dir))


def bibtex_corpus(spark, sf_dir) -> DataFrame:
    return pages(spark, sf_dir).select(
        _text("/corpus/", _id(), ".bib").alias("path"),
        _text("@misc{p", _id(), ",\n  url = {", F.col("url"), "},\n  doi = {10.5555/", _id(), "}\n}").alias("content"),
    )


def html_corpus(spark, sf_dir) -> DataFrame:
    return pages(spark, sf_dir).select(_text("/corpus/", _id(), ".html").alias("path"), F.col("html").alias("content"))


#: Ends of pages that are no HTML, and the anchors (href, text) they hold.
MALFORMED = (
    ("<![foo[bar]]>", ()),
    ("<![ foo", ()),
    ("<a href='x", ()),
    ('<a href="u"><title></title></a>', (("u", ""),)),
    ('<a href="v">one<a href="w">two', (("v", "one"), ("w", "two"))),
    ('<a href="y">open</p><!-- never closed <a href="z">', (("y", "open"),)),
    ("</a <a href='q'", ()),
)


def malformed_corpus(spark, sf_dir) -> DataFrame:
    """The pages with broken markup behind them, of every kind in turn."""
    tail = F.element_at(F.array(*[F.lit(text) for text, _ in MALFORMED]), (F.col("page_id") % len(MALFORMED) + 1).cast("int"))
    return pages(spark, sf_dir).select(_text("/corpus/", _id(), ".html").alias("path"), F.concat("html", tail).alias("content"))


#: Openings that are never completed around a link, of each format that patterns read: (suffix, before, link, behind).
HOSTILE = (
    (".md", "[a](" * 400, " [t](http://m.example.com/{} ", "[b](" * 400),
    (".tex", "\\href{" * 400 + "}\n", "\\href[o]{http://t.example.com/{}}{t}", "\\href[" * 400 + "\n" + "\\href[]{u" * 400),
    (".html", '<a href="x"' * 400 + "</a>", '<a href="http://h.example.com/{}">t</a>', '<a href="y">' * 400),
)


def hostile_corpus(spark, sf_dir) -> DataFrame:
    """The texts of ``documents`` with openings behind them that are never completed, and one link among them."""
    name = F.col("doc_id").cast("string")
    made = [
        (suffix, _text(F.col("text"), "\n" + before, _text(link.partition("{}")[0], name, link.partition("{}")[2]), behind))
        for suffix, before, link, behind in HOSTILE
    ]
    kind = F.col("doc_id") % len(HOSTILE)
    suffix, content = F.lit(HOSTILE[0][0]), made[0][1]
    for k in range(1, len(made)):
        suffix, content = F.when(kind == k, made[k][0]).otherwise(suffix), F.when(kind == k, made[k][1]).otherwise(content)
    return table(spark, sf_dir, "documents").select(_text("/corpus/", name, suffix).alias("path"), content.alias("content"))


def mixed_corpus(spark, sf_dir) -> DataFrame:
    """The texts of ``documents`` under names of known and of unknown formats."""
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".md", ".txt", "", ".HTML", ".tex")]), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("/corpus/"), F.col("doc_id").cast("string"), suffix)
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").alias("content"))


def prose_corpus(spark, sf_dir) -> DataFrame:
    """The texts of ``documents`` as files of all formats; those with a page of the same id link to it."""
    url = F.col("url")
    name = F.col("doc_id").cast("string")
    text = F.col("text")
    markdown = _text(text, F.coalesce(_text("\n[doc ", name, "](", url, ' "t")\n<', url, ">\n"), F.lit("")))
    tex = _text(text, F.coalesce(_text("\n\\href[x]{", url, "}{doc ", name, "}\n\\url{", url, "}\n"), F.lit("")))
    anchor = _text('<a href="', F.replace(url, F.lit("&"), F.lit("&amp;")), '">doc ', name, "</a>")
    html = _text("<html><body><p>", text, "</p>", F.coalesce(anchor, F.lit("")), "</body></html>")
    bib_link = _text(",\n  url = {", url, "},\n  doi = {10.5555/", name, "}")
    bibtex = _text("@misc{d", name, ",\n  note = {", text, "}", F.coalesce(bib_link, F.lit("")), "\n}")
    kind = F.col("doc_id") % 4
    suffix = F.when(kind == 0, ".md").when(kind == 1, ".tex").when(kind == 2, ".html").otherwise(".bib")
    content = F.when(kind == 0, markdown).when(kind == 1, tex).when(kind == 2, html).otherwise(bibtex)
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    linked = pages(spark, sf_dir).select(F.col("page_id").alias("doc_id"), "url")
    return documents.join(linked, "doc_id", "left").select(
        _text("/corpus/", F.col("source"), "/", name, suffix).alias("path"), content.alias("content")
    )


def raw_corpus(spark, sf_dir) -> DataFrame:
    """Pages as bytes; those whose URL ends with a slash are not valid UTF-8."""
    data = F.col("html").cast("binary")
    broken = F.concat(F.unhex(F.lit("FF")), data)
    return pages(spark, sf_dir).select(
        _text("/corpus/", _id(), ".html").alias("path"), F.when(F.col("url").endswith("/"), broken).otherwise(data).alias("data")
    )


def _by_target(spark, sf_dir) -> DataFrame:
    named = urls.with_normalized_url(pages(spark, sf_dir).select("page_id", "url"))
    return named.groupBy("normalized_url").agg(F.min("page_id").alias("page_id"))


def probe_log(spark, sf_dir) -> DataFrame:
    """A recorded answer per normalised URL, of every kind in turn."""
    kind = F.col("page_id") % 10
    status = (
        F.when(kind <= 3, 200).when(kind == 4, 301).when(kind == 5, 404).when(kind == 6, 403).when(kind == 7, 429).when(kind == 8, 500)
    )
    return _by_target(spark, sf_dir).select(
        "normalized_url", status.alias("status"), F.when(kind == 9, "Timeout").alias("failure")
    )


def url_cache(spark, sf_dir) -> DataFrame:
    """When each URL was last seen valid: 0 to 47 hours before ``AS_OF``."""
    age = F.make_dt_interval(F.lit(0), (F.col("page_id") % 48).cast("int"))
    return _by_target(spark, sf_dir).select("normalized_url", (F.lit(AS_OF).cast("timestamp") - age).alias("last_valid"))


def _doi() -> Column:
    return _text("10.5555/", _id())


def doi_cache(spark, sf_dir) -> DataFrame:
    """DOIs of the pages on https were seen before."""
    seen = F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 30 DAYS")
    return (
        pages(spark, sf_dir).filter(F.col("url").startswith("https:")).select(_doi().alias("doi"), seen.alias("last_seen"))
    )


def doi_log(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("url").endswith(".html"), 404).when(F.contains(F.col("url"), F.lit("utm_source")), 500).otherwise(200)
    return pages(spark, sf_dir).select(_doi().alias("doi"), status.alias("status"), F.lit(None).cast("string").alias("failure"))


def stub_fetch(url: str) -> tuple[int | None, str | None]:
    """Stands for the network: the length of a URL decides its answer."""
    kind = len(url) % 5
    return ((200, 301, 404, 500)[kind], None) if kind < 4 else (None, "Timeout")
