"""Registered queries, their DuckDB counterparts, and the flagship query."""

from __future__ import annotations

import functools
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefwarden import scratch, shipping
from hrefwarden.functions import fixed, urls
from hrefwarden.operators import extract, queue, report, spread, verdict
from hrefwarden.options import AuditOptions
from hrefwarden.plans import audit, corpora
from hrefwarden.sources import cache, documents, snapshot
from hrefwarden.streaming import audit_stream as stream

Query = Callable[[SparkSession, str], DataFrame]

SMOKE_DIR = "/root/testdata/sf0.001"
TTL_HOURS = 24
EVERY_KEY = 1_000_000


def entry(spark: SparkSession) -> DataFrame:
    """Which files hold dead links, worst first."""
    return queries()["error_report"](spark, SMOKE_DIR)


# --- shared inputs -----------------------------------------------------------


def _markdown_queue(spark, sf) -> DataFrame:
    return queue.link_queue(extract.markdown_links(corpora.markdown_corpus(spark, sf)))


def _fresh(spark, sf) -> DataFrame:
    return cache.fresh_urls(corpora.url_cache(spark, sf), TTL_HOURS, corpora.AS_OF)


def _dois(spark, sf) -> DataFrame:
    return queue.doi_queue(extract.bibtex_dois(corpora.bibtex_corpus(spark, sf)))


def _verdicts(spark, sf, targets: DataFrame) -> DataFrame:
    answers = corpora.probe_log(spark, sf)
    return verdict.url_verdicts(targets, answers, corpora.AS_OF)


def _doi_verdicts(spark, sf, dois: DataFrame) -> DataFrame:
    unknown = queue.without_cached(queue.distinct_dois(dois), corpora.doi_cache(spark, sf), "doi")
    return verdict.doi_verdicts(unknown, corpora.doi_log(spark, sf), corpora.AS_OF)


class _Judged:
    """Links of the Markdown corpus and their verdicts as written tables.

    What follows reads them more than once: the corpus is parsed once, and the
    hot keys are counted before any link row is shuffled.
    """

    def __init__(self, spark, sf):
        folder = scratch.run_folder(spark)
        self.folder = folder
        self.queue = scratch.stage(_markdown_queue(spark, sf), folder, "links")
        targets = queue.url_targets(self.queue)
        self.verdicts = scratch.stage(_verdicts(spark, sf, targets), folder, "verdicts")

    def hot(self, min_rows: int = spread.MIN_HOT_ROWS, max_bytes: int = spread.MAX_HOT_BYTES) -> spread.HotKeys | None:
        # A lowered bound is to make keys hot that are not so for their share of a partition.
        keys = spread.KEYS_PER_PARTITION if min_rows == spread.MIN_HOT_ROWS else EVERY_KEY
        return spread.hot_keys(self.verdicts, "normalized_url", "n_links", min_rows, max_bytes, keys=keys)

    def defects(self, min_rows: int = spread.MIN_HOT_ROWS, max_bytes: int = spread.MAX_HOT_BYTES) -> DataFrame:
        return report.defects(self.queue, self.verdicts, self.hot(min_rows, max_bytes))

    def staged_defects(self, min_rows: int = spread.MIN_HOT_ROWS) -> tuple[DataFrame, DataFrame]:
        rows = scratch.stage(self.defects(min_rows), self.folder, "defects")
        return rows, scratch.stage(report.counts_by_file(rows), self.folder, "counts")


# --- sources -----------------------------------------------------------------


def supported_format(spark, sf):
    path = F.col("path")
    return corpora.prose_corpus(spark, sf).select(
        "path", urls.suffix_of(path).alias("suffix"), urls.is_supported(path).alias("supported")
    )


def doc_format_filter(spark, sf):
    corpus = corpora.prose_corpus(spark, sf)
    counts = [
        kept.agg(F.count("*").alias("files"), F.sum(F.length("content")).alias("chars")).select(F.lit(name).alias("file_type"), "files", "chars")
        for name, kept in (
            ("html", documents.html_documents(corpus)),
            ("markdown", documents.markdown_documents(corpus)),
            ("tex", documents.tex_documents(corpus)),
        )
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def decode_problems(spark, sf):
    return documents.decoded(corpora.raw_corpus(spark, sf)).select(
        "path", F.length("content").cast("long").alias("chars"), "problem"
    )


def access_errors(spark, sf):
    return documents.access_errors(documents.decoded(corpora.raw_corpus(spark, sf)))


def cache_fresh_urls(spark, sf):
    return _fresh(spark, sf).select("normalized_url", F.unix_timestamp("last_valid").alias("last_valid"))


def cache_dois(spark, sf):
    return corpora.doi_cache(spark, sf).select("doi", F.unix_timestamp("last_seen").alias("last_seen"))


# --- extraction --------------------------------------------------------------


def html_anchors(spark, sf):
    return extract.html_links_simple(corpora.html_corpus(spark, sf))


def html_anchors_parser(spark, sf):
    return extract.html_links(corpora.html_corpus(spark, sf))


def html_malformed(spark, sf):
    """Anchors of pages that end in broken markup."""
    return extract.html_links(corpora.malformed_corpus(spark, sf))


def hostile_markup(spark, sf):
    """Links of texts whose openings are never completed, by the pattern of each format."""
    corpus = corpora.hostile_corpus(spark, sf)
    links = [
        extract.md_inline_links(documents.markdown_documents(corpus)),
        extract.tex_href_links(documents.tex_documents(corpus)),
        extract.html_links_simple(documents.html_documents(corpus)),
    ]
    found = links[0].unionByName(links[1]).unionByName(links[2])
    return found.select("path", "pos", "url", F.length("linktext").alias("text_chars"))


def unsupported_documents(spark, sf):
    """Documents no extractor knows are reported, not left out."""
    return extract.problems_of(extract.findings(corpora.mixed_corpus(spark, sf)))


def md_inline_links(spark, sf):
    return extract.md_inline_links(corpora.markdown_corpus(spark, sf))


def md_pointy_links(spark, sf):
    return extract.md_pointy_links(corpora.markdown_corpus(spark, sf))


def tex_href_links(spark, sf):
    return extract.tex_href_links(corpora.tex_corpus(spark, sf))


def tex_url_links(spark, sf):
    return extract.tex_url_links(corpora.tex_corpus(spark, sf))


def bib_urls(spark, sf):
    return extract.bibtex_links(corpora.bibtex_corpus(spark, sf))


def bib_dois(spark, sf):
    return extract.bibtex_dois(corpora.bibtex_corpus(spark, sf))


def links_all_formats(spark, sf):
    return extract.findings(corpora.prose_corpus(spark, sf))


def links_after_changes(spark, sf):
    """Findings of a corpus of which a run before has read an older state: a fifth has changed, a part is new, a part gone."""
    corpus = corpora.prose_corpus(spark, sf)
    turn = F.pmod(F.xxhash64("path"), F.lit(20))
    older = F.when(turn < 4, F.concat("content", F.lit("\n[old](http://old.example.com/)"))).otherwise(F.col("content"))
    gone = corpus.where(turn == 5).select(F.concat(F.lit("/corpus/gone"), "path").alias("path"), "content")
    before = corpus.where(turn != 4).select("path", older.alias("content")).unionByName(gone)
    out = f"{scratch.run_folder(spark)}/snapshot"

    def findings_of(documents_now: DataFrame) -> DataFrame:
        # Rows of a table have no time of change; the hash of their content tells as much.
        listing = documents_now.select("path", F.octet_length("content").cast("long").alias("size"), F.xxhash64("content").alias("modified"))

        def read(changed: DataFrame) -> DataFrame:
            return extract.findings(documents_now.join(changed.select("path"), "path", "left_semi"))

        return snapshot.refreshed(spark, out, listing, fixed.SUPPORTED_SUFFIXES, scratch.run_folder(spark), read)

    findings_of(before)
    return findings_of(corpus).select("path", "kind", "pos", "value", "text")


def prose_scan(spark, sf):
    """Texts of two tables read as Markdown; they hold no links, which costs one pass over the bytes."""
    docs = documents.from_table(corpora.table(spark, sf, "documents"), "doc_id", "text", ".md")
    turns = documents.from_table(
        corpora.table(spark, sf, "conversations"), F.concat_ws("-", "conv_id", "turn"), "text", ".md"
    )
    texts = docs.withColumn("kind", F.lit("documents")).unionByName(turns.withColumn("kind", F.lit("conversations")))
    from hrefwarden.functions import markup

    return texts.groupBy("kind").agg(
        F.count("*").alias("texts"),
        F.sum(F.length("content")).alias("chars"),
        F.sum(F.size(markup.markdown_links(F.col("content")))).alias("links"),
    )


# --- filters and functions ---------------------------------------------------


def _spellings(spark, sf) -> DataFrame:
    """Other ways to write the URL of each page."""
    url = F.col("url")
    more = F.when(F.contains(url, F.lit("?")), "&").otherwise("?")
    spelled = F.array(
        url,
        F.concat(F.lit(" "), F.upper(F.substring(url, 1, 12)), F.substring(url, F.lit(13), F.length(url)), F.lit(" ")),
        F.regexp_replace(url, "^(https?://[^/]+)", "$1:443"),
        F.regexp_replace(url, "^(https?://[^/]+)", "$1:80"),
        F.regexp_replace(url, "([a-z0-9])/", "$1//"),
        F.regexp_replace(url, "^(https?)://", "$1://Us:Pw@"),
        F.concat(url, more, F.lit("b=2&a=1&&")),
        F.concat(url, more, F.lit("a=1&a=1")),
        F.replace(url, F.lit("."), F.lit("_")),
        F.concat(url, F.lit(" #x")),
        F.concat(F.substring_index(url, "?", 1), F.lit(" ?b=2 &a=1 #f")),
    )
    return corpora.pages(spark, sf).select("page_id", F.posexplode(spelled).alias("spelling", "url"))


def scheme_router(spark, sf):
    found = F.array(
        F.col("url"),
        F.concat(F.lit("mailto:"), F.col("page_id").cast("string"), F.lit("@example.com")),
        F.upper("url"),
        F.regexp_replace("url", "^https?://[^/]+", ""),
        F.lit(None).cast("string"),
    )
    rows = corpora.pages(spark, sf).select("page_id", F.explode(found).alias("url"))
    return rows.select("page_id", "url", urls.scheme_class(F.col("url")).alias("scheme"))


def scheme_counts(spark, sf):
    return queue.scheme_counts(extract.html_links_simple(corpora.html_corpus(spark, sf)))


def hostname(spark, sf):
    return _spellings(spark, sf).select("page_id", "spelling", urls.hostname(F.col("url")).alias("hostname"))


def normalize_url(spark, sf):
    return urls.with_normalized_url(_spellings(spark, sf))


def normalize_query_conflict(spark, sf):
    return urls.with_normalized_url(_spellings(spark, sf), keep_query=True).drop("url")


def link_queue(spark, sf):
    return _markdown_queue(spark, sf)


def doi_queue(spark, sf):
    return _dois(spark, sf)


def ignore_urls(spark, sf):
    targets = queue.distinct_urls(_markdown_queue(spark, sf))
    return queue.without_ignored(targets, AuditOptions(ignore_urls=IGNORED).ignore_urls)


def rewrite_path(spark, sf):
    path = F.concat(F.lit("/srv/www"), F.col("path"), F.lit("/srv/www/x.md"))
    shown = urls.rewrite_path(path, "/srv/www", "https://www.example.com/")
    return corpora.markdown_corpus(spark, sf).select(path.alias("path"), shown.alias("shown"))


# --- distinct and pruning ----------------------------------------------------


def distinct_urls(spark, sf):
    return queue.distinct_urls(_markdown_queue(spark, sf))


def url_targets(spark, sf):
    return queue.url_targets(_markdown_queue(spark, sf))


def distinct_dois(spark, sf):
    return queue.distinct_dois(_dois(spark, sf))


def prune_cached_links(spark, sf):
    folder = scratch.run_folder(spark)
    links = scratch.stage(_markdown_queue(spark, sf), folder, "links")
    targets = scratch.stage(queue.url_targets(links), folder, "targets")
    hot = spread.hot_keys(targets, "normalized_url", "n_links")
    return queue.without_cached(links, _fresh(spark, sf), "normalized_url", hot)


def prune_cached_dois(spark, sf):
    return queue.without_cached(_dois(spark, sf), corpora.doi_cache(spark, sf), "doi")


def prune_counts(spark, sf):
    return queue.prune_counts(_markdown_queue(spark, sf), _fresh(spark, sf), "normalized_url")


# --- probing and verdicts ----------------------------------------------------


def probe_map(spark, sf):
    """Every distinct URL asked once; the answers are stored before they are used."""
    targets = queue.url_targets(_markdown_queue(spark, sf))
    return scratch.stage(verdict.probe(targets, corpora.stub_fetch, threads_per_task=4), scratch.run_folder(spark), "answers")


def probe_join(spark, sf):
    targets = queue.distinct_urls(_markdown_queue(spark, sf))
    answers = verdict.latest_answers(corpora.probe_log(spark, sf), "normalized_url")
    return targets.join(answers, "normalized_url", "left")


def classify_status(spark, sf):
    """Every status from 100 to 599 in turn."""
    status = (F.lit(100) + F.col("page_id") % 500).cast("int")
    none = F.lit(None).cast("string")
    return corpora.pages(spark, sf).select(
        "page_id",
        status.alias("status"),
        verdict.outcome_of(status, none).alias("outcome"),
        verdict.reason_of(status, none).alias("reason"),
    )


def classify_failure(spark, sf):
    names = ["Timeout", "ClientConnectorError", "ClientResponseError", "ClientOSError", "Server disconnected", "Odd", None]
    failure = F.element_at(F.array(*[F.lit(name).cast("string") for name in names]), (F.col("page_id") % 7 + 1).cast("int"))
    status = F.lit(None).cast("int")
    return corpora.pages(spark, sf).select(
        "page_id",
        failure.alias("failure"),
        verdict.outcome_of(status, failure).alias("outcome"),
        verdict.reason_of(status, failure).alias("reason"),
    )


def _plain_verdicts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("checked_at", F.unix_timestamp("checked_at"))


def verdicts(spark, sf):
    """Distinct, uncached URLs with their verdicts."""
    targets = queue.without_cached(queue.url_targets(_markdown_queue(spark, sf)), _fresh(spark, sf), "normalized_url")
    return _plain_verdicts(_verdicts(spark, sf, targets)).select("normalized_url", "status", "outcome", "reason", "checked_at")


def classify_doi(spark, sf):
    return _plain_verdicts(_doi_verdicts(spark, sf, _dois(spark, sf)))


def upsert_valid_dois(spark, sf):
    known = corpora.doi_cache(spark, sf)
    found = _doi_verdicts(spark, sf, _dois(spark, sf))
    return verdict.refreshed_dois(known, found).withColumn("last_seen", F.unix_timestamp("last_seen"))


def invalid_dois_by_file(spark, sf):
    folder = scratch.run_folder(spark)
    dois = scratch.stage(_dois(spark, sf), folder, "dois")
    counts = scratch.stage(dois.groupBy("doi").agg(F.count("*").alias("n_links")), folder, "doi_counts")
    hot = spread.hot_keys(counts, "doi", "n_links")
    return verdict.invalid_dois_by_file(dois, _doi_verdicts(spark, sf, dois), hot)


def refresh_url_cache(spark, sf):
    fresh = _fresh(spark, sf)
    targets = queue.without_cached(queue.url_targets(_markdown_queue(spark, sf)), fresh, "normalized_url")
    refreshed = verdict.refreshed_urls(fresh, _verdicts(spark, sf, targets))
    return refreshed.withColumn("last_valid", F.unix_timestamp("last_valid"))


def errors_by_code(spark, sf):
    targets = queue.url_targets(_markdown_queue(spark, sf))
    return verdict.errors_with_status(_verdicts(spark, sf, targets), 404)


def count_errors(spark, sf):
    targets = queue.url_targets(_markdown_queue(spark, sf))
    return verdict.count_errors(_verdicts(spark, sf, targets))


# --- reports -----------------------------------------------------------------


def _defects_by_file(outcome: str) -> Query:
    def run(spark, sf):
        return report.by_file(_Judged(spark, sf).defects(), outcome)

    return run


def _count_by_file(outcome: str) -> Query:
    def run(spark, sf):
        judged = _Judged(spark, sf)
        return report.count_by_file(judged.queue, judged.verdicts, outcome, judged.hot())

    return run


def _report(outcome: str) -> Query:
    def run(spark, sf):
        rows, counts = _Judged(spark, sf).staged_defects()
        return report.sorted_listing(report.listing(rows, outcome, counts, report.hot_files(counts)))

    return run


def errors_by_file_hot_urls(spark, sf):
    """Errors per file with every URL that is linked twice treated as a hot one."""
    return report.by_file(_Judged(spark, sf).defects(min_rows=2), verdict.ERROR)


def errors_by_file_dealt_urls(spark, sf):
    """The same with hot URLs taken as too many to broadcast: each is dealt to tasks by its share of the links."""
    return report.by_file(_Judged(spark, sf).defects(min_rows=2, max_bytes=0), verdict.ERROR)


def error_report_hot_files(spark, sf):
    """The error report with every file of three or more errors treated as a hot one."""
    rows, counts = _Judged(spark, sf).staged_defects(min_rows=2)
    hot = report.hot_files(counts, min_rows=3, keys=EVERY_KEY)
    return report.sorted_listing(report.listing(rows, verdict.ERROR, counts, hot))


def nested_error_report(spark, sf):
    """The report as one row per file and part; items joined to a text."""
    rows, counts = _Judged(spark, sf).staged_defects()
    nested = report.nested_listing(report.listing(rows, verdict.ERROR, counts, report.hot_files(counts)))
    item = F.transform("items", lambda i: F.concat_ws(" ", i["url"], i["linktext"], i["code"]))
    return nested.withColumn("items", F.array_join(item, "|"))


def run_statistics(spark, sf):
    judged = _Judged(spark, sf)
    return report.statistics(judged.queue, judged.verdicts)


def _lines(markdown: bool) -> Query:
    def run(spark, sf):
        judged = _Judged(spark, sf)
        rows, counts = judged.staged_defects()
        return report.report_lines(
            report.timed(report.statistics(judged.queue, judged.verdicts), 2.0, corpora.AS_OF),
            access_errors(spark, sf),
            rows,
            counts,
            markdown=markdown,
            folder="/corpus",
            base_url="https://www.example.com",
            hot=report.hot_files(counts),
        )

    return run


# --- whole audits ------------------------------------------------------------


def _audit_options(**more) -> AuditOptions:
    return AuditOptions(as_of=corpora.AS_OF, ttl_hours=TTL_HOURS, **more)


def link_audit(spark, sf):
    """Documents of all formats to defects, in one audit."""
    done = audit.run_audit(
        spark, corpora.prose_corpus(spark, sf), _audit_options(), corpora.probe_log(spark, sf), corpora.doi_log(spark, sf)
    )
    return done.defects


def link_audit_repeat(spark, sf):
    """The same audit twice: the second asks only what was not fine in the first."""
    kept = _audit_options(cache_path=f"{scratch.run_folder(spark)}-cache")
    logs = corpora.probe_log(spark, sf), corpora.doi_log(spark, sf)
    scratch.make_parent(spark, kept.cache_path)
    audit.run_audit(spark, corpora.prose_corpus(spark, sf), kept, *logs)
    again = audit.run_audit(spark, corpora.prose_corpus(spark, sf), kept, *logs)
    return again.verdicts.select("normalized_url", "n_links", "outcome")


def stream_link_audit(spark, sf):
    """Pages arrive as a stream of TeX documents; the defects of all batches."""
    out = scratch.run_folder(spark)
    scratch.make_parent(spark, f"{out}/cache")
    docs = corpora.tex_documents_of(corpora.pages_stream(spark, sf))
    options = _audit_options(cache_path=f"{out}/cache")
    running = stream.audit_stream(docs, options, out, corpora.probe_log(spark, sf), corpora.doi_log(spark, sf))
    running.awaitTermination()
    return stream.batches_of(spark, out, audit.DEFECTS).drop("batch")


# --- fixed values: URLs of the ignore list, as a user would type them
IGNORED = "http://blog.ththan.example.net/en/960, https://thther.example.org/en/685,https://m.therou.example.com/en/474.html"


def audit_queries() -> dict[str, Query]:
    """The queries of the link audit."""
    named = [
        supported_format, doc_format_filter, decode_problems, access_errors, cache_fresh_urls, cache_dois,
        html_anchors, html_anchors_parser, html_malformed, hostile_markup, unsupported_documents, md_inline_links, md_pointy_links, tex_href_links, tex_url_links,
        bib_urls, bib_dois, links_all_formats, links_after_changes, prose_scan,
        scheme_router, scheme_counts, hostname, normalize_url, normalize_query_conflict, link_queue, doi_queue,
        ignore_urls, rewrite_path,
        distinct_urls, url_targets, distinct_dois, prune_cached_links, prune_cached_dois, prune_counts,
        probe_map, probe_join, classify_status, classify_failure, verdicts, classify_doi, upsert_valid_dois,
        invalid_dois_by_file, refresh_url_cache, errors_by_code, count_errors,
        errors_by_file_hot_urls, errors_by_file_dealt_urls, error_report_hot_files, nested_error_report, run_statistics, link_audit, link_audit_repeat, stream_link_audit,
    ]
    found: dict[str, Query] = {query.__name__: query for query in named}
    for outcome in (verdict.ERROR, verdict.REDIRECT, verdict.EXCEPTION):
        found[f"{outcome}s_by_file"] = _defects_by_file(outcome)
        found[f"{outcome}_count_by_file"] = _count_by_file(outcome)
        found[f"{outcome}_report"] = _report(outcome)
    found["report_lines"] = _lines(markdown=True)
    found["report_lines_plain"] = _lines(markdown=False)
    return {name: _with_package(query) for name, query in found.items()}


def queries() -> dict[str, Query]:
    found = _llm("QUERIES")
    if found and importlib.util.find_spec("corpus_pipeline"):
        import corpus_pipeline

        found["pipeline"] = corpus_pipeline.run
    return audit_queries() | {name: _with_package(query) for name, query in found.items()}


def _llm(what: str) -> dict:
    """What the subpackage llm registers, if it is there."""
    spec = importlib.util.find_spec("hrefwarden.llm")
    if spec is None or not spec.origin:  # not there, or a folder without code
        return {}
    from hrefwarden.llm import registered

    return dict(getattr(registered, what))


def _with_package(query: Query) -> Query:
    """Python workers import the package; make sure they have it."""

    @functools.wraps(query)
    def run(spark, sf):
        shipping.ship(spark)
        return query(spark, sf)

    return run


def oracle_sql() -> dict[str, str]:
    from oracle import statements

    ours = _llm("SQL")
    found = statements() | ours
    if ours and importlib.util.find_spec("corpus_pipeline"):
        import corpus_pipeline

        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
