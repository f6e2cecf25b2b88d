"""From links to the URLs that have to be asked."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefwarden import scratch
from hrefwarden.functions import urls


def link_queue(links: DataFrame) -> DataFrame:
    """Links that can be checked, with host and normalised URL; the URL as found stays."""
    http = links.filter(F.col("url").startswith("http"))
    return urls.with_normalized_url(http).select(
        "path", "pos", urls.hostname(F.col("url")).alias("hostname"), "url", "normalized_url", "linktext"
    )


def scheme_counts(links: DataFrame) -> DataFrame:
    return links.groupBy(urls.scheme_class(F.col("url")).alias("scheme")).agg(F.count("*").alias("links"))


def doi_queue(dois: DataFrame) -> DataFrame:
    return dois.select("path", "pos", "doi", "description")


def url_targets(queue: DataFrame) -> DataFrame:
    """Distinct normalised URLs with the number of links to each.

    The count costs nothing beside the distinct and is what later tells the hot
    URLs. Map-side aggregation folds a hot URL before the shuffle.
    """
    return (
        queue.groupBy("normalized_url")
        .agg(F.count("*").alias("n_links"))
        .withColumn("hostname", urls.hostname(F.col("normalized_url")))
    )


def distinct_urls(queue: DataFrame) -> DataFrame:
    return queue.select("normalized_url").distinct()


def distinct_dois(dois: DataFrame) -> DataFrame:
    return dois.select("doi").distinct()


def _ignored(spark: SparkSession, ignore: Iterable[str], key: str) -> DataFrame:
    # A list the user typed: Spark knows the size of the local relation and
    # broadcasts it only below its threshold.
    return spark.createDataFrame([(url,) for url in sorted(set(ignore))], f"{key} string")


def without_ignored(targets: DataFrame, ignore: Iterable[str]) -> DataFrame:
    """Drop the URLs of the user's list, matched exactly as normalised."""
    return targets.join(_ignored(targets.sparkSession, ignore, "normalized_url"), "normalized_url", "left_anti")


def known_keys(cached: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Keys of ``wanted`` that the cache holds, each once; of the cache nothing else is shuffled."""
    return cached.select(key).join(wanted.select(key), key, "left_semi").distinct()


def mark_skipped(targets: DataFrame, cached: DataFrame, key: str, ignore: Iterable[str] = ()) -> DataFrame:
    """Add ``skipped``: 'ignored', 'cached', or NULL for what has to be asked.

    Skipped keys stay in the table for their counts: a hot one among them must
    be known as hot when link rows are joined later. Give ``targets`` as a written
    table: its size is then known, and a small one is broadcast to a scan of the cache.
    """
    known = known_keys(cached, targets, key).withColumn("_cached", F.lit(True))
    marked = targets.join(known, key, "left")
    reason = F.when(F.col("_cached"), "cached")
    if ignore:
        listed = _ignored(targets.sparkSession, ignore, key).withColumn("_ignored", F.lit(True))
        marked = marked.join(listed, key, "left")
        reason = F.when(F.col("_ignored"), "ignored").otherwise(reason)
    return marked.select(*targets.columns, reason.alias("skipped"))


def to_ask(marked: DataFrame) -> DataFrame:
    return marked.filter(F.col("skipped").isNull()).drop("skipped")


def without_cached(rows: DataFrame, cached: DataFrame, key: str, hot=None) -> DataFrame:
    """Rows whose key is not in the cache; rows without a key stay.

    ``hot`` (see ``spread.hot_keys``) keeps the rows of hot keys out of the
    shuffle.
    """
    from hrefwarden.operators import spread

    return spread.anti_lookup(rows, cached.select(key), key, hot)


def prune_counts(rows: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Rows before pruning, rows the cache answers, rows left.

    Counted per key first, so that the join sees each key once and a hot key
    weighs no more than any other. The counts are written, as both the search of the
    cache and the join read them.
    """
    spark = rows.sparkSession
    per_key = scratch.stage(rows.groupBy(key).agg(F.count("*").alias("n")), scratch.run_folder(spark), "per_key")
    known = known_keys(cached, per_key, key).withColumn("hit", F.lit(True))
    n, hit = F.col("n"), F.col("hit").isNotNull()
    total = F.coalesce(F.sum(n), F.lit(0))
    skipped = F.coalesce(F.sum(F.when(hit, n).otherwise(0)), F.lit(0))
    return per_key.join(known, key, "left").agg(
        total.alias("rows_before"), skipped.alias("rows_skipped"), (total - skipped).alias("rows_after")
    )
