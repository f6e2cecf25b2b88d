"""What a run has read of a tree, so that the next one reads only what has changed since.

A snapshot is two tables: the files with size and time of change, and their findings. A
file of the same name, size and time is taken as unchanged: it is neither read nor parsed,
and its findings are taken over. Snapshots are kept in numbered folders; the marker is
written last, and of older ones the last is kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefwarden import scratch
from hrefwarden.operators import extract

FILES, FINDINGS, MARKER = "files", "findings", "marker"
#: To be raised when extraction finds other things in the same text.
EXTRACTION = 1
MARKER_SCHEMA = "extraction int, suffixes string, folder string, snapshot long"
SAME = ("path", "size", "modified")


@dataclass
class Snapshot:
    number: int
    files: DataFrame | None = None
    findings: DataFrame | None = None


def load(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> Snapshot:
    """The last snapshot; one without tables if there is none, or none of this extraction and these formats."""
    if not scratch.path_kind(spark, f"{path}/{MARKER}"):
        return Snapshot(0)
    markers = spark.read.schema(MARKER_SCHEMA).parquet(f"{path}/{MARKER}")
    last = markers.orderBy(F.desc("snapshot")).first()
    if last is None:
        return Snapshot(0)
    if (last["extraction"], last["suffixes"]) != (EXTRACTION, " ".join(suffixes)):
        return Snapshot(last["snapshot"])
    return Snapshot(last["snapshot"], *(spark.read.parquet(f"{path}/{last['folder']}/{name}") for name in (FILES, FINDINGS)))


def changed(listing: DataFrame, before: Snapshot) -> DataFrame:
    """Files that are new or not as they were; one whose time is unknown is always among them."""
    return listing if before.files is None else listing.join(before.files, list(SAME), "left_anti")


def _troubled(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("kind") == extract.PROBLEM).select("path").distinct()


def refreshed(
    spark: SparkSession, path: str, listing: DataFrame, suffixes: tuple[str, ...], folder: str, read: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The findings of the whole tree, as a table; ``read(listing)`` gives those of the files that have changed.

    Files with problems are not kept as read: the next run tries them again.
    """
    before = load(spark, path, suffixes)
    named = f"snapshot-{before.number + 1}"
    to_read = scratch.stage(changed(listing, before), folder, "changed")
    found = extract.numbered(scratch.stage(read(to_read), folder, "read"))
    if before.files is not None:
        # Few as a rule, so that the findings before are not shuffled: files changed or gone, and those with problems.
        stale = before.files.join(listing, list(SAME), "left_anti").select("path").unionByName(_troubled(before.findings))
        stale = scratch.stage(stale, folder, "stale")
        found = found.unionByName(before.findings.join(stale, "path", "left_anti").select(*found.columns))
    findings = scratch.stage(found, f"{path}/{named}", FINDINGS, by="kind")
    known = listing.filter(F.col("modified").isNotNull()).select(*SAME).join(_troubled(findings), "path", "left_anti")
    scratch.stage(known, f"{path}/{named}", FILES)
    marker = spark.createDataFrame([(EXTRACTION, " ".join(suffixes), named, before.number + 1)], MARKER_SCHEMA)
    marker.coalesce(1).write.mode("append").parquet(f"{path}/{MARKER}")
    if before.number > 1:
        scratch.release(spark, f"{path}/snapshot-{before.number - 1}")
    return findings
