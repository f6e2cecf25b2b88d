"""Answers to verdicts: what each distinct URL or DOI turned out to be."""

from __future__ import annotations

import datetime as dt
import itertools
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, as_completed, wait

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefwarden.functions import fixed

FINE, REDIRECT, ERROR, EXCEPTION = "fine", "redirect", "error", "exception"
_FAILURES = (*fixed.KNOWN_FAILURES, fixed.UNCLASSIFIED)
VALID, INVALID, UNEXPECTED = "valid", "invalid", "unexpected"

# --- fixed values: errors by the name of their class, and the failures they stand for
_FAILURE_OF = {
    "TimeoutError": "Timeout",
    "ServerDisconnectedError": "Server disconnected",
    "RemoteDisconnected": "Server disconnected",
    "ClientConnectorError": "ClientConnectorError",
    "ClientResponseError": "ClientResponseError",
    "ClientOSError": "ClientOSError",
    "ConnectionRefusedError": "ClientConnectorError",
    "gaierror": "ClientConnectorError",
    "HTTPException": "ClientResponseError",
    "OSError": "ClientOSError",
}

#: Answers a task holds before it passes them on.
ANSWERS_PER_BATCH = 1_000

Fetch = Callable[[str], tuple[int | None, str | None]]


def outcome_of(status: Column, failure: Column) -> Column:
    return (
        F.when(failure.isNotNull(), EXCEPTION)
        .when(status.isin(*fixed.FINE_STATUS), FINE)
        .when(status.isin(*fixed.REDIRECT_STATUS), REDIRECT)
        .when(status.isin(*fixed.ERROR_STATUS), ERROR)
        .otherwise(EXCEPTION)
    )


def reason_of(status: Column, failure: Column) -> Column:
    """Why a URL could not be judged; NULL for the other outcomes."""
    return (
        F.when(failure.isin(*fixed.KNOWN_FAILURES), failure)
        .when(failure.isNotNull() | status.isNull(), fixed.UNCLASSIFIED)
        .when(status == fixed.RATE_LIMIT_STATUS, fixed.RATE_LIMIT_REASON)
        .when(
            ~status.isin(*fixed.FINE_STATUS, *fixed.REDIRECT_STATUS, *fixed.ERROR_STATUS),
            F.format_string("Other (%d)", status),
        )
    )


def doi_outcome_of(status: Column) -> Column:
    return F.when(status == 200, VALID).when(status == 404, INVALID).otherwise(UNEXPECTED)


def failure_of(error: BaseException) -> str:
    """The failure a raised error stands for, by its class or the nearest one above that is known."""
    known = (_FAILURE_OF[kind.__name__] for kind in type(error).__mro__ if kind.__name__ in _FAILURE_OF)
    return next(known, type(error).__name__)


def answers_as_they_come(keys: Iterable[str], answer: Callable[[str], tuple], threads: int) -> Iterator[tuple]:
    """(key, *answer(key)) of every key, in the order in which the answers arrive.

    A key is taken when a thread is about to be free: one slow answer holds up its own
    thread and nothing else, wherever the batches of keys begin and end.
    """
    threads = max(1, threads)
    with ThreadPoolExecutor(max_workers=threads) as pool:
        asked: dict[Future, str] = {}
        for key in keys:
            asked[pool.submit(answer, key)] = key
            if len(asked) > threads:  # one waits for a thread
                for done in wait(asked, return_when=FIRST_COMPLETED).done:
                    yield asked.pop(done), *done.result()
        for done in as_completed(asked):
            yield asked[done], *done.result()


def probe(
    targets: DataFrame,
    fetch: Fetch,
    key: str = "normalized_url",
    host: str | None = "hostname",
    partitions: int | None = None,
    lanes_per_host: int = 32,
    threads_per_task: int = 1,
) -> DataFrame:
    """Call ``fetch`` once per row of ``targets``, spread over hosts.

    A host is asked by at most ``lanes_per_host`` tasks, so a host that owns a
    third of all URLs neither sits in one task nor is asked by the whole
    cluster. The status expected is that of the first answer, redirects not
    followed; an exception is the failure of its URL and not of the job. Store
    the result before using it: evaluating it again asks again.
    """
    spark = targets.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lane = F.pmod(F.xxhash64(key), F.lit(max(1, lanes_per_host)))
    spread = targets.select(key, *([host] if host else []))
    spread = spread.repartition(n, *([host] if host else []), lane).select(key)

    def answer(url: str) -> tuple[int | None, str | None]:
        try:
            status, failure = fetch(url)
            return (None if status is None else int(status)), (None if failure is None else str(failure))
        except Exception as error:
            return None, failure_of(error)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (url for batch in batches for url in batch.column(key).to_pylist())
        answers = answers_as_they_come(keys, answer, threads_per_task)
        while rows := list(itertools.islice(answers, ANSWERS_PER_BATCH)):
            columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), (pa.string(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "status", "failure"])

    return spread.mapInArrow(ask, f"{key} string, status int, failure string")


#: Less than any status.
_BELOW = -(1 << 33)


def _packed(status: Column, failure: Column) -> Column:
    """An answer as one number: the status, or a number below all of them less the place of the failure in its list."""
    place = F.array_position(F.array(*[F.lit(name) for name in _FAILURES]), failure).cast("long")
    place = F.when(place > 0, place).otherwise(len(_FAILURES))
    return F.when(failure.isNull(), status.cast("int").cast("long")).otherwise(F.lit(_BELOW) - place)


def latest_answers(log: DataFrame, key: str, at: str | None = None) -> DataFrame:
    """One answer per key of a recorded log: the newest, or the smallest if it has no time.

    Answers are packed into numbers first: fixed-width buffers let Spark
    aggregate by hashing, where structs would be sorted before the shuffle.
    """
    failure = F.col("failure") if "failure" in log.columns else F.lit(None).cast("string")
    packed = log.select(key, _packed(F.col("status"), failure).alias("_answer"), *([at] if at else []))
    chosen = F.max_by("_answer", at) if at else F.min("_answer")
    answer = F.col("_answer")
    names = F.array(*[F.lit(name) for name in _FAILURES])
    return (
        packed.groupBy(key)
        .agg(chosen.alias("_answer"))
        .select(
            key,
            F.when(answer > _BELOW, answer).cast("int").alias("status"),
            F.when(answer < _BELOW, F.get(names, (F.lit(_BELOW) - answer - 1).cast("int"))).alias("failure"),
        )
    )


def url_verdicts(targets: DataFrame, answers: DataFrame, checked_at: dt.datetime) -> DataFrame:
    """Exactly one verdict per target; a target nobody answered for is an exception."""
    status, failure = F.col("status"), F.col("failure")
    return targets.join(answers, "normalized_url", "left").select(
        *targets.columns,
        status.cast("int").alias("status"),
        outcome_of(status, failure).alias("outcome"),
        reason_of(status, failure).alias("reason"),
        F.lit(checked_at).cast("timestamp").alias("checked_at"),
    )


def doi_verdicts(dois: DataFrame, answers: DataFrame, checked_at: dt.datetime) -> DataFrame:
    """One verdict per distinct DOI."""
    status = F.col("status")
    return dois.join(answers.select("doi", "status"), "doi", "left").select(
        *dois.columns,
        status.cast("int").alias("status"),
        doi_outcome_of(status).alias("outcome"),
        F.lit(checked_at).cast("timestamp").alias("checked_at"),
    )


def errors_with_status(verdicts: DataFrame, status: int) -> DataFrame:
    return verdicts.filter((F.col("outcome") == ERROR) & (F.col("status") == status)).select("normalized_url")


def count_errors(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter(F.col("outcome") == ERROR).agg(F.count("*").alias("num_errors"))


def has_errors(verdicts: DataFrame) -> bool:
    return not verdicts.filter(F.col("outcome") == ERROR).select("outcome").limit(1).isEmpty()


def newly_fine(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter(F.col("outcome") == FINE).select("normalized_url", F.col("checked_at").alias("last_valid"))


def newly_valid(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter(F.col("outcome") == VALID).select("doi", F.col("checked_at").alias("last_seen"))


def refreshed_urls(fresh: DataFrame, verdicts: DataFrame, one_each: bool = False) -> DataFrame:
    """URL cache after a run: what is still fresh and what is newly fine; stale rows fall out.

    Fresh URLs were not asked, so as a rule the parts have no key in common and need no
    shuffle to be put together. A slot that was added to may hold a URL twice;
    ``one_each`` then keeps the newest.
    """
    rows = fresh.unionByName(newly_fine(verdicts))
    return rows.groupBy("normalized_url").agg(F.max("last_valid").alias("last_valid")) if one_each else rows


def refreshed_dois(known: DataFrame, verdicts: DataFrame) -> DataFrame:
    """DOI cache after a run: known DOIs keep their entry; they were not asked again."""
    return known.unionByName(newly_valid(verdicts))


def invalid_dois_by_file(dois: DataFrame, verdicts: DataFrame, hot=None) -> DataFrame:
    from hrefwarden.operators import spread

    invalid = verdicts.filter(F.col("outcome") == INVALID).select("doi")
    return spread.lookup(dois, invalid, "doi", hot, "left_semi").select("path", "pos", "doi", "description")
