"""The cache of URLs and DOIs seen valid: two Parquet tables kept in two slots.

A run reads the slot written last and replaces the other one, so it never
overwrites what it reads and the cache takes at most twice its size. A stream
adds its finds to the slot in force instead, one version per batch, so a batch
writes what is new and not the whole cache. The marker of a version is written
after its tables; tables without a marker, left by a broken run, do not count
and are overwritten by the next.

Within a version rows are dealt to buckets by the hash of their key, the more the larger
the slot before was. A run reads only the buckets its keys fall into, and they are
sorted by key, so that a small batch reads a small part of a large cache.
"""

from __future__ import annotations

import datetime as dt
import os
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefwarden import scratch

URL_SCHEMA = "normalized_url string, last_valid timestamp"
DOI_SCHEMA = "doi string, last_seen timestamp"
MARKER_SCHEMA = "version long, run_key string, buckets int, n_rows long"
VERSION, BUCKET = "v", "b"
SLOTS = ("a", "b")
KEYS = {"urls": "normalized_url", "dois": "doi"}
#: Rows of a bucket, about, and most buckets; their numbers come to the driver.
BUCKET_ROWS, MAX_BUCKETS = 1_000_000, 4096


@dataclass
class CacheState:
    urls: DataFrame
    dois: DataFrame
    version: int = 0
    slot: str | None = None
    run_key: str | None = None
    #: versions in the slot since it was last replaced, their rows, and the buckets they are dealt to
    depth: int = 0
    n_rows: int = 0
    buckets: int = 1
    in_buckets: dict[str, DataFrame] = field(default_factory=dict)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def buckets_for(n_rows: int) -> int:
    return max(1, min(MAX_BUCKETS, n_rows // BUCKET_ROWS))


def holding(state: CacheState, name: str, keys: DataFrame) -> DataFrame:
    """The rows of the table ``name``, 'urls' or 'dois', in the buckets that ``keys`` fall into.

    The numbers of these, at most ``MAX_BUCKETS``, are made part of the filter, so that
    the other buckets are not read. ``keys`` should be a written table.
    """
    if state.buckets <= 1:
        return getattr(state, name)
    key = KEYS[name]
    wanted = [row[0] for row in keys.select(bucket_of(key, state.buckets).alias(BUCKET)).distinct().collect()]
    rows = state.in_buckets[name]
    return rows.filter(F.col(BUCKET).isin(wanted) if wanted else F.lit(False)).drop(BUCKET)


def check_path(spark: SparkSession, path: str) -> None:
    """Fail before the run if the cache could not be written after it."""
    if scratch.path_kind(spark, path) == "file":
        raise ValueError(f"{path} is a file; the cache is a folder of tables")
    parent = os.path.dirname(path.rstrip("/"))
    if scratch.path_kind(spark, path) is None and parent and scratch.path_kind(spark, parent) != "folder":
        raise ValueError(f"{parent}, the parent folder of the cache, does not exist")


def fresh_urls(urls: DataFrame, ttl_hours: int, as_of: dt.datetime) -> DataFrame:
    """Entries younger than the limit; one exactly that old is stale.

    The bound is a literal, so the Parquet reader can skip row groups by it.
    """
    bound = as_of - dt.timedelta(hours=ttl_hours)
    return urls.filter(F.col("last_valid") > F.lit(bound))


def _markers(spark: SparkSession, path: str, slot: str) -> list:
    """Versions of a slot; one small row each, and few of them between two replacements."""
    try:
        return spark.read.schema(MARKER_SCHEMA).parquet(f"{path}/{slot}/marker").collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def load(spark: SparkSession, path: str | None) -> CacheState:
    """The state in force; empty tables where there is no cache yet."""
    found = {slot: markers for slot in SLOTS if path and (markers := _markers(spark, path, slot))}
    if not found:
        return CacheState(spark.createDataFrame([], URL_SCHEMA), spark.createDataFrame([], DOI_SCHEMA))
    slot = max(found, key=lambda name: max(marker["version"] for marker in found[name]))
    newest = max(found[slot], key=lambda marker: marker["version"])

    def table(name: str, schema: str) -> DataFrame:
        rows = spark.read.schema(f"{schema}, {VERSION} long, {BUCKET} int").parquet(f"{path}/{slot}/{name}")
        return rows.filter(F.col(VERSION) <= newest["version"]).drop(VERSION)

    tables = {"urls": table("urls", URL_SCHEMA), "dois": table("dois", DOI_SCHEMA)}
    plain = {name: rows.drop(BUCKET) for name, rows in tables.items()}
    return CacheState(
        **plain,
        version=newest["version"],
        slot=slot,
        run_key=newest["run_key"],
        depth=len(found[slot]),
        n_rows=sum(marker["n_rows"] for marker in found[slot]),
        buckets=newest["buckets"],
        in_buckets=tables,
    )


def _write(path: str, slot: str, version: int, tables: dict[str, DataFrame], run_key: str, buckets: int, whole: bool) -> None:
    spark = tables["urls"].sparkSession
    for name, rows in tables.items():
        key = KEYS[name]
        dealt = rows.withColumn(BUCKET, bucket_of(key, buckets))
        if buckets > 1:  # a bucket in few files, however many tasks hold rows of it
            dealt = dealt.hint("rebalance", F.col(BUCKET)).sortWithinPartitions(BUCKET, key)
        if whole:
            dealt.withColumn(VERSION, F.lit(version)).write.mode("overwrite").option(
                "partitionOverwriteMode", "static"
            ).partitionBy(VERSION, BUCKET).parquet(f"{path}/{slot}/{name}")
        else:
            dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/{slot}/{name}/{VERSION}={version}")
    # Counted by the footers of the files.
    written = spark.read.schema(f"{URL_SCHEMA}, {VERSION} long, {BUCKET} int").parquet(f"{path}/{slot}/urls")
    n_rows = written.filter(F.col(VERSION) == version).count()
    marker = spark.createDataFrame([(version, run_key, buckets, n_rows)], MARKER_SCHEMA).coalesce(1)
    if whole:
        marker.withColumn(VERSION, F.lit(version)).write.mode("overwrite").option(
            "partitionOverwriteMode", "static"
        ).partitionBy(VERSION).parquet(f"{path}/{slot}/marker")
    else:
        marker.write.mode("overwrite").parquet(f"{path}/{slot}/marker/{VERSION}={version}")


def replace(path: str, state: CacheState, urls: DataFrame, dois: DataFrame, run_key: str) -> None:
    """Put new tables in force; ``state`` is what the run had loaded."""
    slot = SLOTS[1] if state.slot == SLOTS[0] else SLOTS[0]
    _write(path, slot, state.version + 1, {"urls": urls, "dois": dois}, run_key, buckets_for(state.n_rows), whole=True)


def add(path: str, state: CacheState, new_urls: DataFrame, new_dois: DataFrame, run_key: str) -> None:
    """Put new rows in force beside those of the slot that ``state`` was loaded from."""
    _write(path, state.slot or SLOTS[0], state.version + 1, {"urls": new_urls, "dois": new_dois}, run_key, state.buckets, whole=False)
