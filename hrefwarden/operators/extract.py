"""Documents to links and DOIs: one row per link, one pass over the documents.

Input is ``documents(path, content)``; links come out as ``(path, pos, url,
linktext)``. Markdown and TeX are read by JVM expressions, HTML and BibTeX in
Arrow batches; only documents of those two formats, and of these only the ones
that can hold a link at all, are handed to a Python worker.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hrefwarden.functions import fixed, markup, urls

# Built from type objects: workers import this module without a session.
FINDING_ARRAY = T.ArrayType(T.StructType([T.StructField(name, T.StringType()) for name in ("kind", "value", "text")]))
_FINDING = pa.struct([("kind", pa.string()), ("value", pa.string()), ("text", pa.string())])

LINK, DOI, PROBLEM = "link", "doi", "problem"


def _html_findings(text: str) -> list[tuple]:
    from hrefwarden.functions.anchors import html_anchors

    return [(LINK, href, label) for href, label in html_anchors(text)]


def _bibtex_findings(text: str) -> list[tuple]:
    from hrefwarden.functions.bibtex import bibtex_entries, one_line

    links, dois, problems = [], [], []
    for key, fields in bibtex_entries(text, ("url", "doi")):
        if key is None:
            problems.append((PROBLEM, None, fields))
            continue
        if "url" in fields:
            links.append((LINK, one_line(fields["url"]), f"Key: {key}, Field: Url"))
        if "doi" in fields:
            dois.append((DOI, one_line(fields["doi"]).strip(), f"Key: {key}, Field: DOI"))
    return links + dois + problems


def _batch(texts: pa.Array, parse) -> pa.Array:
    """Apply ``parse`` to a batch of texts; flat arrays and offsets, no row objects."""
    offsets, rows = [0], []
    for text in texts:
        if text.is_valid:
            try:
                rows.extend(parse(text.as_py()))
            except Exception as error:  # one odd document is a row of the report, not the end of the job
                rows.append((PROBLEM, None, f"cannot be parsed ({type(error).__name__})"))
        offsets.append(len(rows))
    kinds, values, labels = zip(*rows) if rows else ((), (), ())
    flat = pa.StructArray.from_arrays(
        [pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(labels, pa.string())],
        fields=list(_FINDING),
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


@F.arrow_udf(FINDING_ARRAY)
def parse_html(text: pa.Array) -> pa.Array:
    return _batch(text, _html_findings)


@F.arrow_udf(FINDING_ARRAY)
def parse_bibtex(text: pa.Array) -> pa.Array:
    return _batch(text, _bibtex_findings)


def _has_anchor(content: Column) -> Column:
    return content.rlike(r"(?i)<a[\s/>]")


def _link_rows(documents: DataFrame, links: Column) -> DataFrame:
    return documents.select("path", F.posexplode(links).alias("pos", "link")).select(
        "path", "pos", F.col("link.url").alias("url"), F.col("link.linktext").alias("linktext")
    )


def _content() -> Column:
    return markup.unix_newlines(F.col("content"))


def md_inline_links(documents: DataFrame) -> DataFrame:
    return _link_rows(documents, markup.md_inline(_content()))


def md_pointy_links(documents: DataFrame) -> DataFrame:
    return _link_rows(documents, markup.md_pointy(_content()))


def markdown_links(documents: DataFrame) -> DataFrame:
    return _link_rows(documents, markup.markdown_links(_content()))


def tex_href_links(documents: DataFrame) -> DataFrame:
    return _link_rows(documents, markup.tex_href(_content()))


def tex_url_links(documents: DataFrame) -> DataFrame:
    return _link_rows(documents, markup.tex_url(_content()))


def tex_links(documents: DataFrame) -> DataFrame:
    return _link_rows(documents, markup.tex_links(_content()))


def html_links_simple(documents: DataFrame) -> DataFrame:
    """By pattern, in the JVM; for HTML known to be regular."""
    return _link_rows(documents, markup.html_simple(F.col("content")))


def _finding_rows(documents: DataFrame, findings: Column) -> DataFrame:
    part = [name for name in ("part",) if name in documents.columns]
    return documents.select("path", *part, F.posexplode(findings).alias("pos", "found")).select(
        "path",
        *part,
        F.col("found.kind").alias("kind"),
        "pos",
        F.col("found.value").alias("value"),
        F.col("found.text").alias("text"),
    )


def _as_links(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("kind") == LINK).select(
        "path", "pos", F.col("value").alias("url"), F.col("text").alias("linktext")
    )


def _as_dois(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("kind") == DOI).select(
        "path", "pos", F.col("value").alias("doi"), F.col("text").alias("description")
    )


def html_links(documents: DataFrame) -> DataFrame:
    """Every anchor, by the parser."""
    with_anchor = documents.filter(_has_anchor(F.col("content")))
    return _as_links(_finding_rows(with_anchor, parse_html(F.col("content"))))


def bibtex_links(documents: DataFrame) -> DataFrame:
    return _as_links(_finding_rows(documents, parse_bibtex(F.col("content"))))


def bibtex_dois(documents: DataFrame) -> DataFrame:
    """DOI rows; ``pos`` counts the DOIs of a document, after its links."""
    return _as_dois(_finding_rows(documents, parse_bibtex(F.col("content"))))


def bibtex_problems(documents: DataFrame) -> DataFrame:
    findings = _finding_rows(documents, parse_bibtex(F.col("content")))
    return findings.filter(F.col("kind") == PROBLEM).select("path", F.col("text").alias("problem"))


def _tagged(links: Column) -> Column:
    return F.transform(
        links, lambda link: F.struct(F.lit(LINK).alias("kind"), link["url"].alias("value"), link["linktext"].alias("text"))
    ).cast(FINDING_ARRAY)


def findings(documents: DataFrame, suffixes=fixed.SUPPORTED_SUFFIXES) -> DataFrame:
    """Links, DOIs and problems of documents of every format in ``suffixes``.

    One scan: the format decides per row which expression is evaluated, so the
    corpus is not read once per format. Documents of the other supported formats are
    left out; those no extractor knows are problems, whatever they hold.
    """
    unknown = set(suffixes) - set(fixed.SUPPORTED_SUFFIXES)
    if unknown:
        raise ValueError(f"unsupported suffixes: {sorted(unknown)}")
    suffix = urls.suffix_of(F.col("path"))
    native = suffix.isin(*fixed.MARKDOWN_SUFFIXES, *fixed.TEX_SUFFIXES)
    content = F.when(native, _content()).otherwise(F.col("content"))
    problem = F.col("problem") if "problem" in documents.columns else F.lit(None).cast("string")
    known = F.coalesce(suffix.isin(*fixed.SUPPORTED_SUFFIXES), F.lit(False))
    problem = F.coalesce(problem, F.when(~known, F.lit(fixed.NO_EXTRACTOR)))
    # The raw column is tested, not the one with its line ends replaced.
    wanted = problem.isNotNull() | (suffix.isin(*suffixes) & (F.col("content") != ""))
    part = [name for name in ("part",) if name in documents.columns]
    chosen = documents.filter(wanted).select("path", *part, content.alias("content"), suffix.alias("suffix"), problem.alias("problem"))
    unreadable = F.array(F.struct(F.lit(PROBLEM).alias("kind"), F.lit(None).alias("value"), F.col("problem").alias("text")))

    content = F.col("content")

    def of(format_suffixes):
        return F.col("suffix").isin(*[s for s in format_suffixes if s in suffixes])

    found = (
        F.when(F.col("problem").isNotNull(), unreadable.cast(FINDING_ARRAY))
        .when(of(fixed.MARKDOWN_SUFFIXES), _tagged(markup.markdown_links(content)))
        .when(of(fixed.TEX_SUFFIXES), _tagged(markup.tex_links(content)))
    )
    # Texts are read in the JVM before the Python node, and only those a worker parses pass it.
    # What was found is used twice below, which keeps the two projections apart.
    is_html, is_bib = of(fixed.HTML_SUFFIXES), of(fixed.BIBTEX_SUFFIXES)
    rows = chosen.select(
        "path",
        *part,
        found.alias("found"),
        F.when(F.col("problem").isNull() & is_html & _has_anchor(content), content).alias("html"),
        F.when(F.col("problem").isNull() & is_bib, content).alias("bibtex"),
    )
    found = F.when(F.col("found").isNotNull(), F.col("found"))
    if set(fixed.HTML_SUFFIXES) & set(suffixes):
        found = found.when(F.col("html").isNotNull(), parse_html(F.col("html")))
    if set(fixed.BIBTEX_SUFFIXES) & set(suffixes):
        found = found.when(F.col("bibtex").isNotNull(), parse_bibtex(F.col("bibtex")))
    return _finding_rows(rows, found)


def numbered(findings_table: DataFrame) -> DataFrame:
    """Findings of a written table with positions that go on from part to part of a large file.

    What each part holds is counted first; only large files have parts, so the counts are
    few. Within a part positions are in the order of its format.
    """
    if "part" not in findings_table.columns:
        return findings_table
    parted = findings_table.filter(F.col("part").isNotNull())
    if parted.isEmpty():
        return findings_table.drop("part")
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parted.groupBy("path", "part").agg(F.count("*").alias("n"))
    first = counts.select("path", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias("_first"))
    rows = findings_table.join(first, ["path", "part"], "left")
    columns = [name for name in findings_table.columns if name != "part"]
    return rows.withColumn("pos", F.col("pos") + F.coalesce("_first", F.lit(0))).select(*columns)


def links_of(findings_table: DataFrame) -> DataFrame:
    return _as_links(findings_table)


def dois_of(findings_table: DataFrame) -> DataFrame:
    return _as_dois(findings_table)


def problems_of(findings_table: DataFrame) -> DataFrame:
    return findings_table.filter(F.col("kind") == PROBLEM).select("path", F.col("text").alias("problem"))
