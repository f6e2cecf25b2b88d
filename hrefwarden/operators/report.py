"""Defects per file: flat rows, counts, nested parts and text lines.

The flat table is the report proper. Nested rows come in parts of a fixed
number of link positions, so no row ever holds a whole hot file.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefwarden.functions import fixed, urls
from hrefwarden.operators import spread
from hrefwarden.operators.verdict import ERROR, EXCEPTION, FINE, REDIRECT

POSITIONS_PER_PART = 1000


def defects(queue: DataFrame, verdicts: DataFrame, hot: spread.HotKeys | None = None) -> DataFrame:
    """Every link whose URL is not fine, with the URL as found in the file.

    ``code`` is the HTTP status, or the reason where there is no verdict.
    """
    bad = verdicts.filter(F.col("outcome") != FINE).select(
        "normalized_url", "outcome", F.coalesce(F.col("reason"), F.col("status").cast("string")).alias("code")
    )
    return spread.lookup(queue, bad, "normalized_url", hot).select(
        "path", "pos", "url", "linktext", "outcome", "code"
    )


def by_file(defect_rows: DataFrame, outcome: str) -> DataFrame:
    return defect_rows.filter(F.col("outcome") == outcome).drop("outcome")


def counts_by_file(defect_rows: DataFrame) -> DataFrame:
    """Defective links per outcome and file; a link that occurs twice counts twice."""
    return defect_rows.groupBy("outcome", "path").agg(F.count("*").alias("n"))


def count_by_file(queue: DataFrame, verdicts: DataFrame, outcome: str, hot=None) -> DataFrame:
    chosen = verdicts.filter(F.col("outcome") == outcome).select("normalized_url")
    return (
        spread.lookup(queue, chosen, "normalized_url", hot, "left_semi").groupBy("path").agg(F.count("*").alias("n"))
    )


FILE_KEY = ("outcome", "path")


def hot_files(counts: DataFrame, min_rows: int = spread.MIN_HOT_ROWS, keys: int = spread.KEYS_PER_PARTITION) -> spread.HotKeys | None:
    """Files with too many defects of one outcome for one task."""
    return spread.hot_keys(counts, FILE_KEY, "n", min_rows, keys=keys)


def shown_path(folder: str | None, base_url: str | None) -> Column:
    path = F.col("path")
    return urls.rewrite_path(path, folder, base_url) if folder and base_url else path


def with_counts(defect_rows: DataFrame, counts: DataFrame, hot: spread.HotKeys | None = None) -> DataFrame:
    """Defects of all outcomes, each with the number of its outcome in its file."""
    return spread.lookup(defect_rows, counts.select(*FILE_KEY, "n"), FILE_KEY, hot)


def listing(defect_rows: DataFrame, outcome: str, counts: DataFrame | None = None, hot: spread.HotKeys | None = None) -> DataFrame:
    """(path, n, pos, url, linktext, code): sort with ``sorted_listing``."""
    counts = counts_by_file(defect_rows) if counts is None else counts
    chosen = F.col("outcome") == outcome
    return with_counts(defect_rows.filter(chosen), counts.filter(chosen), hot).select(
        "path", "n", "pos", "url", "linktext", "code"
    )


def sorted_listing(rows: DataFrame) -> DataFrame:
    """Worst file first, by a range sort. The position is part of the key, so a hot file spans tasks."""
    return rows.orderBy(F.desc("n"), F.asc("path"), F.asc("pos"))


def nested_listing(rows: DataFrame) -> DataFrame:
    """(path, n, part, items): the links of a file in parts of bounded length."""
    item = F.struct("pos", "url", "linktext", "code")
    return (
        rows.groupBy("path", "n", F.floor(F.col("pos") / POSITIONS_PER_PART).cast("int").alias("part"))
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
        .withColumn(
            "items",
            F.transform("items", lambda i: F.struct(i["url"].alias("url"), i["linktext"].alias("linktext"), i["code"].alias("code"))),
        )
    )


def statistics(queue: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: links found, URLs checked, URLs fine."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    fine = (F.col("outcome") == FINE).cast("long")
    found = queue.select(one.alias("links"), zero.alias("checked"), zero.alias("fine"))
    checked = verdicts.select(zero.alias("links"), one.alias("checked"), fine.alias("fine"))
    return found.unionByName(checked).agg(
        F.coalesce(F.sum("links"), zero).alias("num_links"),
        F.coalesce(F.sum("checked"), zero).alias("num_checked"),
        F.coalesce(F.sum("fine"), zero).alias("num_fine"),
    )


def timed(stats: DataFrame, seconds: float, at: dt.datetime) -> DataFrame:
    """Statistics with the figures only the driver knows."""
    seconds = seconds or 1.0
    return stats.select(
        F.date_format(F.lit(at).cast("timestamp"), fixed.TIMESTAMP_FORMAT).alias("timestamp"),
        "num_links",
        "num_checked",
        F.lit(round(seconds)).alias("time_to_check"),
        F.round(F.col("num_checked") / F.lit(float(seconds)), 2).alias("checks_per_second"),
        "num_fine",
    )


# --- text --------------------------------------------------------------------
# A line has a sort key (section, rank, path, pos, line), so the text is one
# range sort of rows that were made independently of each other.

_SECTIONS = (ERROR, REDIRECT, EXCEPTION)
_ACCESS = 1
LINE_ORDER = ("section", "rank", "path", "pos", "line")


def _per_section(choose) -> Column:
    """An expression chosen by the column ``outcome``."""
    chosen = F.when(F.col("outcome") == _SECTIONS[0], choose(_SECTIONS[0]))
    for section in _SECTIONS[1:]:
        chosen = chosen.when(F.col("outcome") == section, choose(section))
    return chosen


def _number() -> Column:
    return _per_section(lambda section: F.lit(_SECTIONS.index(section) + _ACCESS + 1))


def _line_rows(rows: DataFrame, section, rank, path, pos, lines) -> DataFrame:
    lines = F.array(*lines) if isinstance(lines, list) else lines
    return rows.select(
        section.cast("int").alias("section"),
        rank.cast("long").alias("rank"),
        path.alias("path"),
        pos.cast("long").alias("pos"),
        F.posexplode(lines).alias("line", "text"),
    )


def _heading(title: str, markdown: bool) -> str:
    return f"# {title}" if markdown else f" {title} ".center(39, "#")


def _legend(markdown: bool) -> list[str]:
    if markdown:
        return ["HTTP status code | Meaning", "--:|:--"] + [f"{code} | {text}" for code, text in fixed.STATUS_MEANING.items()]
    return [f"HTTP status code {code} = {text}" for code, text in fixed.STATUS_MEANING.items()]


def _texts(texts: list[str]) -> Column:
    return F.array(*[F.lit(text) for text in texts])


def _intros(counts: DataFrame, markdown: bool) -> DataFrame:
    """Heading of each section, with its legend or with the note that it is empty."""
    spark = counts.sparkSession
    every = spark.createDataFrame([(section, 0) for section in _SECTIONS], "outcome string, files int")
    files = counts.select("outcome", F.lit(1).alias("files")).unionByName(every)
    rows = files.groupBy("outcome").agg(F.sum("files").alias("files"))

    def lines(section):
        head = ["", _heading(fixed.SECTION_TITLES[section], markdown)]
        full = head + (_legend(markdown) if section == ERROR else [])
        return F.when(F.col("files") == 0, _texts(head + [fixed.SECTION_EMPTY[section]])).otherwise(_texts(full))

    return _line_rows(rows, _number(), F.lit(None), F.lit(""), F.lit(-2), _per_section(lines))


def _file_headings(counts: DataFrame, markdown: bool, shown: Column) -> DataFrame:
    n = F.col("n").cast("string")
    if markdown:
        column = F.when(F.col("outcome") == EXCEPTION, "exception").otherwise("code")
        lines = [
            F.lit(""),
            F.concat(F.lit("**"), shown, F.lit("** ("), n, F.lit(")")),
            F.lit(""),
            F.concat(F.lit("|"), column, F.lit("| URL and link text |")),
            F.lit("|--:|:------------------|"),
        ]
    else:
        lines = [F.lit(""), F.concat(shown, F.lit(" "), n)]
    return _line_rows(counts, _number(), -F.col("n"), F.col("path"), F.lit(-1), lines)


def _defect_lines(rows: DataFrame, markdown: bool) -> DataFrame:
    url, code = F.col("url"), F.col("code")
    label = F.coalesce(F.col("linktext"), F.lit(""))
    if markdown:
        lines = [
            F.concat(F.lit("|"), code, F.lit(" | ["), url, F.lit("]("), url, F.lit(")|")),
            F.concat(F.lit("| | "), label, F.lit(" |")),
        ]
    else:
        lines = [F.concat(F.lit("* "), code, F.lit(": "), label, F.lit(" "), url)]
    return _line_rows(rows, _number(), -F.col("n"), F.col("path"), F.col("pos"), lines)


def _opening(timed_stats: DataFrame, markdown: bool) -> DataFrame:
    # --- fixed values: title and sentences of the report
    kind = "links" if markdown else "hyperlinks"
    title = ["---", "title: Results of Linkcheck", "---"] if markdown else ["#" * 39, " RESULTS ".center(39, "#"), "#" * 39]
    lines = [
        *[F.lit(text) for text in title],
        F.lit(""),
        F.format_string("generated: %s", F.col("timestamp")),
        F.lit(""),
        F.format_string(f"Found %d {kind} which had %d distinct targets.", F.col("num_links"), F.col("num_checked")),
        F.format_string("Checked those in %d seconds.", F.col("time_to_check")),
        F.concat(F.lit("This averages to "), F.col("checks_per_second").cast("string"), F.lit(" checks/second.")),
        F.lit(""),
        F.format_string("%d of those hyperlinks are fine.", F.col("num_fine")),
    ]
    return _line_rows(timed_stats, F.lit(0), F.lit(None), F.lit(""), F.lit(-3), lines)


def _access_lines(access_errors: DataFrame, markdown: bool, shown: Column) -> DataFrame:
    lines = [F.concat(F.lit("* "), shown, F.lit(" ("), F.col("problem"), F.lit(")"))]
    body = _line_rows(access_errors, F.lit(_ACCESS), F.lit(0), F.col("path"), F.lit(0), lines)
    any_error = access_errors.limit(1)
    head = _texts(["", _heading(fixed.SECTION_TITLES["access"], markdown), ""])
    return _line_rows(any_error, F.lit(_ACCESS), F.lit(None), F.lit(""), F.lit(-2), head).unionByName(body)


def report_lines(
    timed_stats: DataFrame,
    access_errors: DataFrame,
    defect_rows: DataFrame,
    counts: DataFrame,
    markdown: bool = False,
    show_redirects: bool = True,
    show_exceptions: bool = True,
    folder: str | None = None,
    base_url: str | None = None,
    hot: spread.HotKeys | None = None,
) -> DataFrame:
    """Lines of the text report with their sort keys; see ``sorted_lines``.

    A section switched off is written as an empty one.
    """
    shown = shown_path(folder, base_url)
    visible = F.col("outcome").isin([ERROR] + [REDIRECT] * show_redirects + [EXCEPTION] * show_exceptions)
    counts = counts.filter(visible)
    return (
        _opening(timed_stats, markdown)
        .unionByName(_access_lines(access_errors, markdown, shown))
        .unionByName(_intros(counts, markdown))
        .unionByName(_file_headings(counts, markdown, shown))
        .unionByName(_defect_lines(with_counts(defect_rows.filter(visible), counts, hot), markdown))
    )


def sorted_lines(lines: DataFrame) -> DataFrame:
    return lines.orderBy(*[F.asc_nulls_first(name) for name in LINE_ORDER])
