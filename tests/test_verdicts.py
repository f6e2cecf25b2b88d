import datetime as dt
import itertools
import threading
import http.client
import io
import socket
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from hrefwarden.functions import http_fetch
from hrefwarden.operators import queue, verdict
from hrefwarden.plans import corpora

NOW = dt.datetime(2024, 5, 1, 12, tzinfo=dt.timezone.utc)

CASES = [
    (200, None, "fine", None),
    (302, None, "fine", None),
    (303, None, "fine", None),
    (307, None, "fine", None),
    (301, None, "redirect", None),
    (308, None, "redirect", None),
    (403, None, "error", None),
    (404, None, "error", None),
    (410, None, "error", None),
    (429, None, "exception", "Rate Limit (429)"),
    (500, None, "exception", "Other (500)"),
    (204, None, "exception", "Other (204)"),
    (None, "Timeout", "exception", "Timeout"),
    (None, "ClientConnectorError", "exception", "ClientConnectorError"),
    (None, "ClientResponseError", "exception", "ClientResponseError"),
    (None, "ClientOSError", "exception", "ClientOSError"),
    (None, "Server disconnected", "exception", "Server disconnected"),
    (None, "Something else", "exception", "Unclassified"),
    (None, None, "exception", "Unclassified"),
]


def test_every_kind_of_answer(spark):
    answers = spark.createDataFrame(
        [(f"http://e/{i}", s, f) for i, (s, f, _, _) in enumerate(CASES)], "normalized_url string, status int, failure string"
    )
    targets = answers.select("normalized_url").unionByName(spark.createDataFrame([("http://e/unasked",)], "normalized_url string"))
    got = {r["normalized_url"]: (r["status"], r["outcome"], r["reason"]) for r in verdict.url_verdicts(targets, answers, NOW).collect()}
    assert len(got) == len(CASES) + 1
    for i, (status, _, outcome, reason) in enumerate(CASES):
        assert got[f"http://e/{i}"] == (status, outcome, reason)
    assert got["http://e/unasked"] == (None, "exception", "Unclassified")


def test_newest_recorded_answer_counts(spark):
    log = spark.createDataFrame([("u", 404, None, 1), ("u", 200, None, 2)], "normalized_url string, status int, failure string, at int")
    assert verdict.latest_answers(log, "normalized_url", "at").collect()[0]["status"] == 200
    assert verdict.latest_answers(log.drop("at"), "normalized_url").collect()[0]["status"] == 200


def test_recorded_answers_keep_their_meaning(spark):
    schema = "normalized_url string, status int, failure string"
    log = spark.createDataFrame([(f"http://e/{i}", s, f) for i, (s, f, _, _) in enumerate(CASES)], schema)
    answers = verdict.latest_answers(log, "normalized_url")
    assert "SortAggregate" not in answers._jdf.queryExecution().executedPlan().toString()
    got = {r["normalized_url"]: (r["outcome"], r["reason"]) for r in verdict.url_verdicts(log.select("normalized_url"), answers, NOW).collect()}
    assert got == {f"http://e/{i}": (outcome, reason) for i, (_, _, outcome, reason) in enumerate(CASES)}


def test_probe_asks_each_url_once_and_spreads_a_hot_host(spark):
    urls = [(f"http://hot.example.com/{'x' * (i % 7)}{i}", "hot.example.com") for i in range(400)] + [("http://b.org/", "b.org")]
    targets = spark.createDataFrame(urls, "normalized_url string, hostname string")
    asked = verdict.probe(targets, corpora.stub_fetch, partitions=8, lanes_per_host=32, threads_per_task=2)
    rows = asked.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["normalized_url"] for r in rows) == sorted(u for u, _ in urls)
    assert all((r["status"], r["failure"]) == corpora.stub_fetch(r["normalized_url"]) for r in rows)
    assert len({r["task"] for r in rows}) > 4
    one_lane = verdict.probe(targets, corpora.stub_fetch, partitions=8, lanes_per_host=1).withColumn("task", F.spark_partition_id())
    hot = one_lane.filter(F.col("normalized_url").contains("hot."))
    assert hot.select("task").distinct().count() == 1


def test_one_slow_answer_holds_up_itself_alone():
    others = threading.Semaphore(0)

    def answer(key):
        if key == "slow":  # not before 500 others are answered
            return (200, None) if all(others.acquire(timeout=20) for _ in range(500)) else (None, "held up")
        others.release()
        return 404, None

    keys = ["a", "slow", *(f"k{n}" for n in range(600))]
    taken = []
    found = list(verdict.answers_as_they_come((taken.append(k) or k for k in keys), answer, 3))
    assert sorted(k for k, *_ in found) == sorted(keys) and taken == keys
    assert ("slow", 200, None) in found and found.index(("slow", 200, None)) > 400
    # no more keys are taken than threads can ask soon
    ahead = itertools.count()
    first = next(verdict.answers_as_they_come((f"k{n}" for n in ahead), lambda k: (200, None), 4))
    assert first[1:] == (200, None) and next(ahead) <= 8
    assert list(verdict.answers_as_they_come([], answer, 2)) == []


def test_exception_of_fetch_is_the_failure_of_its_url(spark):
    def fetch(url):
        raise KeyError(url)

    targets = spark.createDataFrame([("http://a/", "a")], "normalized_url string, hostname string")
    assert tuple(verdict.probe(targets, fetch).first()) == ("http://a/", None, "KeyError")


def test_doi_verdicts_and_cache(spark):
    dois = spark.createDataFrame([("d1",), ("d2",), ("d3",), ("d4",)], "doi string")
    log = spark.createDataFrame([("d1", 200), ("d2", 404), ("d3", 500)], "doi string, status int")
    found = verdict.doi_verdicts(dois, log, NOW)
    assert {r["doi"]: r["outcome"] for r in found.collect()} == {"d1": "valid", "d2": "invalid", "d3": "unexpected", "d4": "unexpected"}
    known = spark.createDataFrame([("d0", NOW - dt.timedelta(days=9))], "doi string, last_seen timestamp")
    kept = [(r["doi"], r["last_seen"].day) for r in verdict.refreshed_dois(known, found).orderBy("doi").collect()]
    assert kept == [("d0", 22), ("d1", 1)]


def test_url_cache_takes_what_is_newly_fine(spark):
    old = NOW - dt.timedelta(hours=3)
    fresh = spark.createDataFrame([("a", old)], "normalized_url string, last_valid timestamp")
    found = spark.createDataFrame([("b", "fine", NOW), ("c", "error", NOW)], "normalized_url string, outcome string, checked_at timestamp")
    assert {r["normalized_url"] for r in verdict.refreshed_urls(fresh, found).collect()} == {"a", "b"}


def test_ignored_urls_match_exactly(spark):
    targets = spark.createDataFrame([("http://a/",), ("http://a/b",)], "normalized_url string")
    assert [r[0] for r in queue.without_ignored(targets, ["http://a/"]).collect()] == ["http://a/b"]
    assert queue.without_ignored(targets, []).count() == 2


@pytest.mark.parametrize(
    "error, name",
    [
        (TimeoutError(), "Timeout"),
        (urllib.error.URLError(TimeoutError()), "Timeout"),
        (urllib.error.URLError(socket.gaierror()), "ClientConnectorError"),
        (urllib.error.URLError("no route"), "ClientConnectorError"),
        (ConnectionResetError(), "ClientOSError"),
        (http.client.RemoteDisconnected(), "Server disconnected"),
        (http.client.BadStatusLine("x"), "ClientResponseError"),
        (ValueError(), "ValueError"),
    ],
)
def test_failures_of_the_plain_fetch(monkeypatch, error, name):
    def fail(*args, **kwargs):
        raise error

    monkeypatch.setattr(urllib.request.OpenerDirector, "open", fail)
    assert http_fetch.http_fetch()("http://e.com/") == (None, name)


def test_status_of_the_first_answer(monkeypatch):
    def answer(self, request, timeout=None):
        assert request.get_header("User-agent") == "me" and timeout == 7
        raise urllib.error.HTTPError(request.full_url, 301, "moved", {}, io.BytesIO())

    monkeypatch.setattr(urllib.request.OpenerDirector, "open", answer)
    assert http_fetch.http_fetch(timeout=7, user_agent="me")("http://e.com/ü") == (301, None)


def test_raised_errors_keep_their_reason():
    class ServerDisconnectedError(Exception):
        pass

    class SlowConnect(TimeoutError):
        pass

    found = [verdict.failure_of(e) for e in (SlowConnect(), ServerDisconnectedError(), ConnectionRefusedError(), KeyError())]
    assert found == ["Timeout", "Server disconnected", "ClientConnectorError", "KeyError"]


def test_fetch_without_a_pair_and_negative_statuses(spark):
    targets = spark.createDataFrame([("http://a/",), ("http://b/",)], "normalized_url string")
    answers = verdict.probe(targets, lambda url: None if url == "http://a/" else (200, None), host=None, partitions=1).collect()
    assert sorted((r["normalized_url"], r["status"], r["failure"]) for r in answers) == [("http://a/", None, "TypeError"), ("http://b/", 200, None)]
    log = [("u", -1, None), ("v", -99, None), ("w", None, "Timeout"), ("x", None, "Odd"), ("y", 404, None), ("y", 200, None)]
    rows = verdict.latest_answers(spark.createDataFrame(log, "normalized_url string, status int, failure string"), "normalized_url").collect()
    assert sorted((r["normalized_url"], r["status"], r["failure"]) for r in rows) == [
        ("u", -1, None), ("v", -99, None), ("w", None, "Timeout"), ("x", None, "Unclassified"), ("y", 200, None),
    ]
