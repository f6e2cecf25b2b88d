import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from hrefwarden import AuditOptions, DeadLinks, scratch
from hrefwarden.operators import queue, report
from hrefwarden.plans import audit, corpora
from hrefwarden.sources import cache
from hrefwarden.streaming import audit_stream as stream

NOW = dt.datetime(2024, 5, 1, 12, tzinfo=dt.timezone.utc)

FILES = {
    "index.html": "<a href='http://fine.example.com/'>fine</a> <a href='http://dead.example.com/x#top'>dead</a>",
    "post.md": "[d](http://dead.example.com/x) [again](http://dead.example.com/x#b) [moved](http://moved.example.com)",
    "_draft/note.tex": r"\url{http://slow.example.com/} \href{http://ignored.example.com/}{i}",
    "refs.bib": "@misc{k, url = {http://fine.example.com}, doi = {10.1/good}}\n@misc{l, doi = {10.1/bad}}",
    "mail.md": "[m](mailto:a@example.com) [r](/relative)",
}
ANSWERS = [
    ("http://fine.example.com/", 200, None),
    ("http://dead.example.com/x", 404, None),
    ("http://moved.example.com/", 301, None),
    ("http://slow.example.com/", None, "Timeout"),
    ("http://ignored.example.com/", 404, None),
]


def fetchers():
    """Made here, so that they travel to the workers by value: workers cannot import the tests."""
    known = {url: (status, failure) for url, status, failure in ANSWERS}
    return {"fetch": lambda url: known[url], "fetch_doi": lambda doi: (200 if doi.endswith("good") else 404, None)}


@pytest.fixture
def site(tmp_path):
    base = tmp_path / "site"
    for name, text in FILES.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(text)
    (base / "bad.md").write_bytes(b"\xff")
    return base


@pytest.fixture
def logs(spark):
    probe = spark.createDataFrame(ANSWERS, "normalized_url string, status int, failure string")
    dois = spark.createDataFrame([("10.1/good", 200, None), ("10.1/bad", 404, None)], "doi string, status int, failure string")
    return probe, dois


def options(**more):
    return AuditOptions(as_of=NOW, ignore_urls=" http://ignored.example.com/ ,", **more)


def test_folder_to_report(spark, site, logs, tmp_path):
    out = str(tmp_path / "report")
    done = audit.check(spark, str(site), options(base_url="https://pub.example.com/"), *logs, write_to=out, markdown=True)
    text = spark.read.text(out).collect()
    lines = [row[0] for row in text]
    assert "**https://pub.example.com/post.md** (2)" in lines and "**https://pub.example.com/index.html** (1)" in lines
    assert lines.index("**https://pub.example.com/post.md** (2)") < lines.index("**https://pub.example.com/index.html** (1)")
    assert "|404 | [http://dead.example.com/x#top](http://dead.example.com/x#top)|" in lines
    assert "|Timeout | [http://slow.example.com/](http://slow.example.com/)|" in lines
    assert "Found 8 links which had 4 distinct targets." in lines
    assert any(line.startswith("* https://pub.example.com/bad.md (") for line in lines)
    assert "generated: 2024-May-01 12:00h" in lines
    assert done.invalid_dois.select("doi").collect()[0][0] == "10.1/bad"
    errors = [(os.path.basename(r["path"]), r["n"], r["url"]) for r in report.sorted_listing(done.listing("error")).collect()]
    assert errors == [
        ("post.md", 2, "http://dead.example.com/x"),
        ("post.md", 2, "http://dead.example.com/x#b"),
        ("index.html", 1, "http://dead.example.com/x#top"),
    ]
    stats = done.statistics.first()
    assert (stats["num_links"], stats["num_checked"], stats["num_fine"]) == (8, 4, 1)


def test_single_file_and_file_types(spark, site, logs, capsys):
    done = audit.check(spark, str(site / "post.md"), options(), *logs)
    assert done.defects.count() == 3
    printed = capsys.readouterr().out
    assert "* 404: d http://dead.example.com/x" in printed and "No exceptions during the crawl!" in printed
    assert audit.check(spark, str(site), options(file_types="tex"), *logs).links.count() == 2
    with pytest.raises(ValueError):
        AuditOptions(file_types="pdf")


def test_second_run_asks_only_what_was_not_fine(spark, site, tmp_path):
    kept = options(cache_path=str(tmp_path / "cache"), threads_per_task=2, **fetchers())
    first = audit.check(spark, str(site), kept)
    assert {r["normalized_url"] for r in first.verdicts.collect()} == {u for u, _, _ in ANSWERS[:4]}
    assert first.doi_verdicts.count() == 2
    second = audit.check(spark, str(site), kept)
    assert {r["normalized_url"] for r in second.verdicts.collect()} == {u for u, _, _ in ANSWERS[1:4]}
    assert [r["doi"] for r in second.doi_verdicts.collect()] == ["10.1/bad"]
    # A day later the entry is stale.
    late = options(cache_path=str(tmp_path / "cache"), **fetchers())
    late.as_of = NOW + dt.timedelta(hours=24)
    third = audit.check(spark, str(site), late)
    assert third.verdicts.count() == 4


def test_gate_raises_after_the_cache_is_written(spark, site, logs, tmp_path):
    strict = options(cache_path=str(tmp_path / "cache"), raise_for_dead_links=True)
    with pytest.raises(DeadLinks):
        audit.check(spark, str(site), strict, *logs, write_to=str(tmp_path / "report"))
    assert cache.load(spark, strict.cache_path).urls.count() == 1
    (tmp_path / "fine").mkdir()
    (tmp_path / "fine" / "a.md").write_text("<http://fine.example.com>")
    assert audit.check(spark, str(tmp_path / "fine"), options(raise_for_dead_links=True), *logs) is not None


def test_folder_without_documents(spark, tmp_path, logs):
    assert audit.check(spark, str(tmp_path), options(), *logs) is None


def test_each_url_has_one_verdict_and_counts_add_up(spark):
    sf = "/root/testdata/sf0.001"
    done = audit.run_audit(
        spark, corpora.prose_corpus(spark, sf), AuditOptions(as_of=corpora.AS_OF), corpora.probe_log(spark, sf), corpora.doi_log(spark, sf)
    )
    distinct = done.links.select("normalized_url").distinct().count()
    assert done.verdicts.count() == distinct == done.verdicts.select("normalized_url").distinct().count()
    assert done.counts.agg(F.sum("n")).first()[0] == done.defects.count()
    assert done.verdicts.agg(F.sum("n_links")).first()[0] == done.links.count()


def test_skipped_targets_are_counted_but_not_judged(spark, docs, logs, tmp_path):
    documents = docs({"a.md": FILES["post.md"], "b.tex": FILES["_draft/note.tex"], "c.html": FILES["index.html"]})
    kept = options(cache_path=str(tmp_path / "cache"))
    audit.run_audit(spark, documents, kept, *logs)
    again = audit.run_audit(spark, documents, kept, *logs)
    table = spark.read.parquet(f"{again.folder}/{audit.VERDICTS}")
    skipped = {r["normalized_url"]: r["skipped"] for r in table.filter("skipped is not null").collect()}
    assert skipped == {"http://fine.example.com/": "cached", "http://ignored.example.com/": "ignored"}
    assert table.agg(F.sum("n_links")).first()[0] == again.links.count()
    assert "ignored" not in str(again.defects.collect())


def test_sections_can_be_switched_off(spark, site, logs):
    done = audit.check(spark, str(site), options(show_redirects=False, show_exceptions=False), *logs)
    text = [r["text"] for r in done.lines().collect()]
    assert "No permanent redirects found!" in text and "No exceptions during the crawl!" in text
    assert not any("slow.example.com" in line or "moved.example.com" in line for line in text)
    assert "HTTP status code 404 = Not Found" in text


def test_report_of_nothing(spark, logs, docs):
    done = audit.run_audit(spark, docs({"a.md": "no links"}), options(), *logs)
    text = [r["text"] for r in report.sorted_lines(done.lines()).collect()]
    assert "No permanent errors found!" in text and "0 of those hyperlinks are fine." in text
    assert not any("FILE ACCESS" in line for line in text)


@pytest.fixture
def arriving(spark, tmp_path):
    """Documents in four files, read one per batch."""
    folder = str(tmp_path / "arriving")
    for n in range(4):
        rows = [(f"/{n}/{name}", text) for name, text in FILES.items()]
        spark.createDataFrame(rows, "path string, content string").coalesce(1).write.mode("append").parquet(folder)
    return folder


def read_stream(spark, folder):
    return spark.readStream.schema("path string, content string").option("maxFilesPerTrigger", 1).parquet(folder)


def defects_of(df):
    return sorted(tuple(r) for r in df.select("path", "pos", "url", "outcome", "code").collect())


def test_stream_finds_what_the_batch_finds(spark, arriving, logs, tmp_path):
    out = str(tmp_path / "out")
    os.makedirs(out)
    kept = options(cache_path=f"{out}/cache")
    running = stream.audit_stream(read_stream(spark, arriving), kept, out, *logs, replace_every=2)
    running.awaitTermination()
    whole = audit.run_audit(spark, spark.read.parquet(arriving), options(), *logs)
    assert defects_of(stream.batches_of(spark, out, audit.DEFECTS)) == defects_of(whole.defects)
    verdicts = stream.batches_of(spark, out, audit.VERDICTS)
    assert verdicts.select("batch").distinct().count() == 4
    # Fine in the first batch, so never asked again; the dead one is asked every time.
    asked = {r["normalized_url"]: r["count"] for r in queue.to_ask(verdicts).groupBy("normalized_url").count().collect()}
    assert asked["http://fine.example.com/"] == 1 and asked["http://dead.example.com/x"] == 4
    state = cache.load(spark, kept.cache_path)
    assert (state.version, [r[0] for r in state.urls.collect()]) == (4, ["http://fine.example.com/"])


def test_batch_run_again_changes_nothing(spark, arriving, logs, tmp_path):
    out = str(tmp_path / "out")
    os.makedirs(out)
    kept = options(cache_path=f"{out}/cache")
    documents = spark.read.parquet(arriving)
    again = dict(folder=out, run_key="audit:0", batch="/batch=0")
    assert audit.run_audit(spark, documents, kept, *logs, **again) is not None
    before = defects_of(stream.batches_of(spark, out, audit.DEFECTS))
    assert audit.run_audit(spark, documents, kept, *logs, **again) is None
    assert defects_of(stream.batches_of(spark, out, audit.DEFECTS)) == before
    assert cache.load(spark, kept.cache_path).version == 1


def test_named_run_takes_up_stored_answers(spark, docs, tmp_path):
    documents = docs({"a.md": "<http://dead.example.com/x>"})
    named = dict(folder=str(tmp_path / "run"), run_key="nightly")

    def broken(url):
        raise RuntimeError("asked again")

    first = audit.run_audit(spark, documents, options(**fetchers()), **named)
    before = defects_of(first.defects)
    again = audit.run_audit(spark, documents, options(fetch=lambda url: broken(url)), **named)
    assert defects_of(again.defects) == before != []


@pytest.mark.parametrize("files", [0, 3])
def test_stream_of_pages_reads_a_table_of_one_file_or_a_folder(spark, tmp_path, files):
    import __spark_entry__

    rows = [(k, f"http://h{k % 7}.example.com/en/{k % 20}.html", "<p>x</p>") for k in range(60)] + [(None, None, None), (5, "http://h5.example.com/", None)]
    schema = "page_id long, url string, html string"
    pages = spark.createDataFrame(rows, schema)
    table = str(tmp_path / "pages.parquet")
    if files:
        pages.repartition(files).write.parquet(table)
    else:
        pages.toPandas().astype({"page_id": "Int64"}).to_parquet(table)
    spark.createDataFrame([(1, "http://other.example.com/", "")], schema).write.parquet(str(tmp_path / "documents.parquet"))
    found = __spark_entry__.queries()["stream_link_audit"](spark, str(tmp_path))
    logs = corpora.probe_log(spark, str(tmp_path)), corpora.doi_log(spark, str(tmp_path))
    whole = audit.run_audit(spark, corpora.tex_corpus(spark, str(tmp_path)), AuditOptions(as_of=corpora.AS_OF), *logs)
    assert defects_of(found) == defects_of(whole.defects) != []


def test_stream_needs_a_cache(spark, arriving, tmp_path):
    with pytest.raises(ValueError):
        stream.audit_stream(read_stream(spark, arriving), options(), str(tmp_path))


def test_tables_of_a_run_lie_in_the_shared_folder(spark, docs, logs):
    done = audit.run_audit(spark, docs({"a.md": "<http://dead.example.com/x>"}), options(), *logs)
    assert done.folder.startswith(spark.conf.get("spark.checkpoint.dir"))
    scratch.release(spark, done.folder)
    assert scratch.path_kind(spark, done.folder) is None


def test_a_run_that_broke_asks_at_most_a_slice_again(spark, tmp_path, monkeypatch):
    asked = tmp_path / "asked"
    asked.mkdir()

    def fetch(url):
        (asked / uuid.uuid4().hex).write_text(url)
        return 200, None

    docs = spark.createDataFrame([(f"{k}.md", f"[t](http://h{k % 7}.example.com/{k})") for k in range(60)], "path string, content string")
    options = AuditOptions(fetch=fetch, probe_slices=4)
    folder, real = str(tmp_path / "run"), scratch.stage_once

    def breaking(df, where, name):
        if name.endswith("slice-2"):
            raise RuntimeError("lost")
        return real(df, where, name)

    monkeypatch.setattr(scratch, "stage_once", breaking)
    with pytest.raises(RuntimeError):
        audit.run_audit(spark, docs, options, folder=folder, run_key="night")
    monkeypatch.setattr(scratch, "stage_once", real)
    done = audit.run_audit(spark, docs, options, folder=folder, run_key="night")
    urls = sorted(path.read_text() for path in asked.iterdir())
    assert len(urls) == len(set(urls)) == 60 and done.verdicts.count() == 60
    done.release()
    assert scratch.path_kind(spark, folder) is None


def test_urls_are_asked_or_looked_up(spark):
    docs = spark.createDataFrame([("a.md", "")], "path string, content string")
    with pytest.raises(ValueError, match="asked or looked up"):
        audit.run_audit(spark, docs, AuditOptions())
