"""One audit: documents in, verdicts, defects and refreshed cache out.

Three tables are written on the way, each once, and everything after it starts
from the table: the findings (so the corpus is read and parsed once), the
verdicts (so nothing is asked twice) and the defects (so every report is a scan
of the small part of the links that matters). Cached URLs are marked among the
distinct targets, not deleted from the link rows: a URL that is not asked has no
verdict, and links without a verdict are in no report.
"""

from __future__ import annotations

import functools
import time
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefwarden import scratch, shipping
from hrefwarden.functions import urls
from hrefwarden.operators import extract, queue, report, spread, verdict
from hrefwarden.options import AuditOptions, DeadLinks
from hrefwarden.sources import cache, files, snapshot

FINDINGS, TARGETS, ANSWERS, VERDICTS, DEFECTS, COUNTS = "findings", "targets", "answers", "verdicts", "defects", "counts"
DOI_TARGETS, DOI_ANSWERS, DOI_VERDICTS = "doi_targets", "doi_answers", "doi_verdicts"
#: Tables of a run that only it needs, and all of them.
PASSING = (FINDINGS, TARGETS, ANSWERS, DOI_TARGETS, DOI_ANSWERS)
TABLES = (*PASSING, VERDICTS, DEFECTS, COUNTS, DOI_VERDICTS)


@dataclass
class Audit:
    """Tables of a finished audit. What only reports need is made when one asks for it."""

    folder: str
    batch: str
    options: AuditOptions
    links: DataFrame
    dois: DataFrame
    verdicts: DataFrame
    doi_verdicts: DataFrame
    judged: DataFrame
    judged_dois: DataFrame
    defects: DataFrame
    access_errors: DataFrame
    seconds: float

    @cached_property
    def counts(self) -> DataFrame:
        return scratch.stage(report.counts_by_file(self.defects), self.folder, COUNTS + self.batch)

    @cached_property
    def hot_files(self) -> spread.HotKeys | None:
        return report.hot_files(self.counts)

    @property
    def statistics(self) -> DataFrame:
        return report.timed(report.statistics(self.links, self.verdicts), self.seconds, self.options.as_of)

    @property
    def invalid_dois(self) -> DataFrame:
        hot = spread.hot_keys(self.judged_dois, "doi", "n_links")
        return verdict.invalid_dois_by_file(self.dois, self.doi_verdicts, hot)

    @property
    def saved_by_cache(self) -> DataFrame:
        """(kind, keys, links): URLs and DOIs that were not asked as the cache knows them, and the links to them."""
        parts = []
        for kind, judged in (("url", self.judged), ("doi", self.judged_dois)):
            cached = judged.filter(F.col("skipped") == "cached")
            parts.append(cached.agg(F.lit(kind).alias("kind"), F.count("*").alias("keys"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("links")))
        return parts[0].unionByName(parts[1])

    def release(self) -> None:
        """Remove the tables this audit wrote; nothing can be read from it afterwards."""
        spark = self.links.sparkSession
        for name in TABLES if self.batch else ("",):
            scratch.release(spark, f"{self.folder}/{name}{self.batch}" if name else self.folder)

    def listing(self, outcome: str) -> DataFrame:
        """Flat defects of one outcome: path, n, pos, url, linktext, code."""
        shown = report.shown_path(self.options.base_folder, self.options.base_url)
        return report.listing(self.defects, outcome, self.counts, self.hot_files).withColumn("path", shown)

    def lines(self, markdown: bool = False) -> DataFrame:
        return report.report_lines(
            self.statistics,
            self.access_errors,
            self.defects,
            self.counts,
            markdown=markdown,
            show_redirects=self.options.show_redirects,
            show_exceptions=self.options.show_exceptions,
            folder=self.options.base_folder,
            base_url=self.options.base_url,
            hot=self.hot_files,
        )

    def write_report(self, path: str, markdown: bool = False) -> None:
        """Text files whose names are in the order of the report; replaces what is there."""
        report.sorted_lines(self.lines(markdown)).select("text").write.mode("overwrite").text(path)

    def show_report(self, markdown: bool = False) -> None:
        """Print it, line by line as the driver receives it."""
        for row in report.sorted_lines(self.lines(markdown)).select("text").toLocalIterator():
            print(row["text"])


def read_findings(documents: DataFrame, options: AuditOptions) -> DataFrame:
    """The one pass over the corpus. Links that cannot be checked go no further."""
    found = extract.findings(documents, options.suffixes)
    is_link = F.col("kind") == extract.LINK
    kept = found.filter(~is_link | F.col("value").startswith("http"))
    part = [name for name in ("part",) if name in found.columns]
    return urls.with_normalized_url(kept, "value").select("path", *part, "pos", "value", "text", "normalized_url", "kind")


def queued_links(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("kind") == extract.LINK).select(
        "path", "pos", F.col("value").alias("url"), "normalized_url", F.col("text").alias("linktext")
    )


def _answers(targets: DataFrame, key: str, log: DataFrame | None, fetch, options: AuditOptions, keep, name: str) -> DataFrame:
    """Recorded answers to the targets, or those asked for.

    A log is cut down to the targets before anything of it is shuffled. Targets are
    asked slice by slice, each stored when it is complete; ``keep`` takes up the slices
    an earlier try has stored.
    """
    if fetch is None:
        if log is None:
            return targets.sparkSession.createDataFrame([], f"{key} string, status int, failure string")
        log = log.join(targets.select(key), key, "left_semi")
        return verdict.latest_answers(log, key, "at" if "at" in log.columns else None)

    def ask(part: DataFrame) -> DataFrame:
        return verdict.probe(
            part,
            fetch,
            key,
            host="hostname" if "hostname" in part.columns else None,
            partitions=options.probe_partitions,
            lanes_per_host=options.lanes_per_host,
            threads_per_task=options.threads_per_task,
        )

    if options.probe_slices <= 1:
        return keep(ask(targets), name)
    slice_of = F.pmod(F.xxhash64(key, F.lit("slice")), F.lit(options.probe_slices))
    stored = [keep(ask(targets.filter(slice_of == k)), f"{name}/slice-{k}") for k in range(options.probe_slices)]
    return functools.reduce(DataFrame.unionByName, stored)


def run_audit(
    spark: SparkSession,
    documents: DataFrame | None,
    options: AuditOptions,
    probe_log: DataFrame | None = None,
    doi_log: DataFrame | None = None,
    folder: str | None = None,
    run_key: str | None = None,
    batch: str = "",
    add_to_cache: int = 0,
    findings: DataFrame | None = None,
) -> Audit | None:
    """Audit ``documents(path, content[, problem][, part])``, or the ``findings`` of ``read_findings`` as a written table.

    The cache is replaced at the end, or only added to as long as fewer than
    ``add_to_cache`` runs have done so since it was last replaced.

    URLs are asked with ``options.fetch`` or looked up in ``probe_log``. A run
    whose ``run_key`` is the one that last wrote the cache is complete: None. A
    run with a key that broke takes up the answers stored in its ``folder``.
    """
    if (options.fetch is None) == (probe_log is None):
        raise ValueError("give either options.fetch or a probe_log: URLs are asked or looked up")
    if options.fetch_doi is not None and doi_log is not None:
        raise ValueError("give either options.fetch_doi or a doi_log")
    started = time.monotonic()
    options = options.for_run()
    folder = folder or scratch.run_folder(spark)
    if options.cache_path:
        cache.check_path(spark, options.cache_path)
    state = cache.load(spark, options.cache_path)
    if run_key and state.run_key == run_key:
        return None
    fresh = cache.fresh_urls(state.urls, options.ttl_hours, options.as_of)

    def stage(df, name, by=None):
        return scratch.stage(df, folder, name + batch, by)

    def stage_asked(df, name):
        # Answers are not repeatable: a named run started again takes up those it has.
        return scratch.stage_once(df, folder, name) if run_key else scratch.stage(df, folder, name)

    if findings is None:
        findings = extract.numbered(stage(read_findings(documents, options), FINDINGS, by="kind"))
    links = queued_links(findings)

    # Written before they are joined, so that their size is known.
    counted = stage_asked(queue.url_targets(links), f"{TARGETS}{batch}/counted")
    known = cache.fresh_urls(cache.holding(state, "urls", counted), options.ttl_hours, options.as_of)
    targets = queue.mark_skipped(counted, known, "normalized_url", options.ignore_urls)
    targets = stage_asked(targets, f"{TARGETS}{batch}/marked")
    asked = queue.to_ask(targets)
    answers = _answers(asked, "normalized_url", probe_log, options.fetch, options, stage_asked, ANSWERS + batch)
    judged = stage(verdict.url_verdicts(targets, answers, options.as_of), VERDICTS)
    verdicts = queue.to_ask(judged)

    # Hot among all targets: a hot URL that is fine or cached must not be
    # shuffled by its links either.
    hot_urls = spread.hot_keys(judged, "normalized_url", "n_links")
    defects = stage(report.defects(links, verdicts, hot_urls), DEFECTS)

    dois = extract.dois_of(findings)
    doi_targets = stage_asked(dois.groupBy("doi").agg(F.count("*").alias("n_links")), f"{DOI_TARGETS}{batch}/counted")
    doi_targets = stage_asked(queue.mark_skipped(doi_targets, cache.holding(state, "dois", doi_targets), "doi"), f"{DOI_TARGETS}{batch}/marked")
    doi_answers = _answers(queue.to_ask(doi_targets), "doi", doi_log, options.fetch_doi, options, stage_asked, DOI_ANSWERS + batch)
    judged_dois = stage(verdict.doi_verdicts(doi_targets, doi_answers, options.as_of), DOI_VERDICTS)
    doi_verdicts = queue.to_ask(judged_dois)
    audit = Audit(
        folder=folder,
        batch=batch,
        options=options,
        links=links,
        dois=dois,
        verdicts=verdicts,
        doi_verdicts=doi_verdicts,
        judged=judged,
        judged_dois=judged_dois,
        defects=defects,
        access_errors=extract.problems_of(findings),
        seconds=time.monotonic() - started,
    )
    if options.cache_path:
        key = run_key or folder
        if state.depth < add_to_cache:
            cache.add(options.cache_path, state, verdict.newly_fine(verdicts), verdict.newly_valid(doi_verdicts), key)
        else:
            cache.replace(
                options.cache_path,
                state,
                verdict.refreshed_urls(fresh, verdicts, one_each=state.depth > 1),
                verdict.refreshed_dois(state.dois, doi_verdicts),
                key,
            )
    return audit


def gate(audit: Audit) -> None:
    """Raise for dead links if the options say so; the cache is already written."""
    if audit.options.raise_for_dead_links and verdict.has_errors(audit.verdicts):
        raise DeadLinks("some links lead nowhere")


def check(
    spark: SparkSession,
    searchpath: str,
    options: AuditOptions,
    probe_log: DataFrame | None = None,
    doi_log: DataFrame | None = None,
    write_to: str | None = None,
    markdown: bool = False,
    release: bool = False,
) -> Audit | None:
    """Audit a file or folder, report, keep the cache, raise if asked to.

    ``release`` removes the tables of the run once the report is written.
    """
    shipping.ship(spark)
    folder = scratch.run_folder(spark)
    listing = files.list_path(spark, searchpath, options.suffixes, folder)
    if listing is None:
        return None
    options = options.for_run(base_folder=options.base_folder or files.absolute(searchpath))
    if options.snapshot_path:

        def read(changed: DataFrame) -> DataFrame:
            return read_findings(files.read_files(changed), options)

        found = snapshot.refreshed(spark, options.snapshot_path, listing, options.suffixes, folder, read)
        audit = run_audit(spark, None, options, probe_log, doi_log, folder, findings=found)
    else:
        audit = run_audit(spark, files.read_files(listing), options, probe_log, doi_log, folder)
    if write_to:
        audit.write_report(write_to, markdown)
    else:
        audit.show_report(markdown)
    try:
        gate(audit)
    finally:
        if release:
            audit.release()
    return audit
