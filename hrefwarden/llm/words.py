"""Columns shared by the operators on words, and where their tables are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefwarden import scratch, shipping

BLANKS = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def workspace(spark: SparkSession) -> str:
    """A folder of its own in the cluster's shared folder; the workers get the package."""
    shipping.ship(spark)
    return scratch.run_folder(spark)


def whole(text: Column) -> Column:
    """A text; a missing one counts as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"([^{BLANKS}]+)"), F.lit(0))


def windows(found: str, width: int, of) -> Column:
    """``of(first, ..., last)`` for every window of so many words of the array column ``found``, in order."""
    last = F.size(found) - width
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), last), lambda i: of(*[F.col(found)[i + k] for k in range(width)])),
    ).otherwise(F.array())
