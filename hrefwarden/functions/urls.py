"""URL and path functions as Column expressions.

Everything here stays in the JVM. Parts are cut out with ``substring_index``
and ``substring`` instead of one regular expression per part: the URL column is
the widest string of the link table, and byte searches are far cheaper than
running a regex engine six times per link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefwarden.functions import fixed

_HAS_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]"


def _after(text: Column, head: Column) -> Column:
    """What follows the prefix ``head`` of ``text``."""
    return F.substring(text, F.length(head) + 1, F.length(text))


def _authority_of(rest: Column) -> Column:
    return F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)


def suffix_of(path: Column) -> Column:
    """File suffix with its dot, '' if none; a name such as ``.md`` has none."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1)


def is_supported(path: Column, suffixes=fixed.SUPPORTED_SUFFIXES) -> Column:
    return suffix_of(path).isin(*suffixes)


def scheme_class(url: Column) -> Column:
    """http / mailto / unsupported / missing; the test is case-sensitive."""
    return (
        F.when(url.isNull(), "missing")
        .when(url.startswith("http"), "http")
        .when(url.startswith("mailto:"), "mailto")
        .otherwise("unsupported")
    )


def hostname(url: Column) -> Column:
    """Lower-case host without user info and port; NULL if there is none.

    ``parse_url`` is not used: it gives NULL for hosts with an underscore or
    non-ASCII letters.
    """
    clean = F.translate(url, "\t\r\n", "")
    host_port = F.substring_index(_authority_of(_after(clean, F.concat(F.substring_index(clean, "://", 1), F.lit("://")))), "@", -1)
    bracketed = F.substring_index(F.substring_index(host_port, "[", -1), "]", 1)
    host = F.when(host_port.startswith("["), bracketed).otherwise(F.substring_index(host_port, ":", 1))
    return F.when(clean.rlike(_HAS_AUTHORITY) & (host != ""), F.lower(host))


def _sorted_query(query: Column) -> Column:
    """Order the parts of a query; leave it alone if one of its keys repeats."""
    parts = F.array_remove(F.split(query, "&", -1), "")
    # Keys by cutting the values out of the joined text: a lambda would take the
    # projection out of code generation.
    keys = F.split(F.regexp_replace(F.array_join(parts, "&"), "=[^&]*", ""), "&", -1)
    return (
        F.when(F.instr(query, "&") == 0, query)
        .when(F.size(F.array_distinct(keys)) < F.size(keys), query)
        .otherwise(F.array_join(F.sort_array(parts), "&"))
    )


def with_normalized_url(rows: DataFrame, url: str = "url", to: str = "normalized_url", keep_query: bool = False) -> DataFrame:
    """Add one spelling for all URLs that lead to the same resource.

    Lower-case scheme and host, no fragment, no default port, '/' for an empty
    path, no repeated slashes in the path, query parts in order. Text without a
    scheme or host comes back trimmed, and so is what is left where fragment and
    query are cut off. ``keep_query`` leaves the query as found.

    The parts are columns of intermediate projections, not one nested
    expression: each is computed once and the plan stays small.
    """
    text, page, base, query, scheme, rest, place, host, path = (
        F.col(f"_{name}") for name in ("text", "page", "base", "query", "scheme", "rest", "place", "host", "path")
    )
    columns = [column for column in rows.columns if column != to]
    blanks = F.lit(" \t\r\n")
    rows = (
        rows.withColumn("_text", F.btrim(F.col(url), blanks))
        .withColumn("_page", F.rtrim(F.substring_index(text, "#", 1), blanks))
        .withColumn("_base", F.substring_index(page, "?", 1))
        .withColumns({"_query": F.substring(page, F.length(base) + 2, F.length(page)), "_base": F.rtrim(base, blanks)})
        .withColumn("_scheme", F.substring_index(base, "://", 1))
        .withColumns({"_rest": F.substring(base, F.length(scheme) + 4, F.length(base)), "_scheme": F.lower(scheme)})
        .withColumn("_place", F.substring_index(rest, "/", 1))
        .withColumns({"_host": F.lower(F.substring_index(place, "@", -1)), "_path": _after(rest, place)})
    )
    user = F.substring(place, F.lit(1), F.length(place) - F.length(host))
    bare_host = (
        F.when((scheme == "http") & host.endswith(":80"), F.substring(host, F.lit(1), F.length(host) - 3))
        .when((scheme == "https") & host.endswith(":443"), F.substring(host, F.lit(1), F.length(host) - 4))
        .otherwise(host)
    )
    clean_path = (
        F.when(path == "", F.lit("/"))
        .when(F.contains(path, F.lit("//")), F.regexp_replace(path, "/{2,}", "/"))
        .otherwise(path)
    )
    rows = rows.withColumn("_query", F.rtrim(query if keep_query else _sorted_query(query), blanks))
    tail = F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))
    normalized = F.when(
        text.rlike(_HAS_AUTHORITY), F.concat(scheme, F.lit("://"), user, bare_host, clean_path, tail)
    ).otherwise(text)
    return rows.select(*columns, normalized.alias(to))


def rewrite_path(path: Column, folder: str, base_url: str) -> Column:
    """Put ``base_url`` in the place of the first occurrence of ``folder``."""
    if not folder or not base_url:
        raise ValueError("rewriting a path needs the folder and the URL to put in its place")
    at = F.instr(path, F.lit(folder))
    head = F.substring(path, F.lit(1), at - 1)
    tail = F.substring(path, at + len(folder), F.length(path))
    return F.when(at > 0, F.concat(head, F.lit(base_url.rstrip("/")), tail)).otherwise(path)
