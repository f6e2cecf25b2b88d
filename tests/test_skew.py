"""Hot keys: a third of all rows on one key, checked against plain joins and brute force."""

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from hrefwarden import scratch
from hrefwarden.operators import queue, report, spread, verdict


@pytest.fixture(scope="module")
def skewed(spark):
    """3000 links, 1000 of them to one URL and 1000 in one file."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 1, "/hot.md").otherwise(F.concat(F.lit("/"), F.col("id").cast("string"), F.lit(".md"))).alias("path"),
        F.col("id").cast("int").alias("pos"),
        F.when(F.col("id") % 3 == 0, "http://hot/").otherwise(F.concat(F.lit("http://e/"), (F.col("id") % 500).cast("string"))).alias("url"),
        F.lit("text").alias("linktext"),
    )
    return rows.withColumn("normalized_url", F.col("url"))


@pytest.fixture(scope="module")
def judged(spark, skewed):
    targets = queue.url_targets(skewed)
    bad = F.when(F.col("normalized_url").contains("hot") | F.col("normalized_url").endswith("7"), "error").otherwise("fine")
    rows = targets.select(
        "normalized_url", "n_links", F.lit(404).alias("status"), bad.alias("outcome"), F.lit(None).cast("string").alias("reason")
    )
    return scratch.stage(rows, scratch.run_folder(spark), "judged")


def as_set(df):
    rows = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    return sorted(rows, key=str)


def test_hot_keys_are_few_by_construction(judged):
    hot = spread.hot_keys(judged, "normalized_url", "n_links", min_rows=100)
    assert hot.count == 1 and [r[0] for r in hot.keys.collect()] == ["http://hot/"]
    assert spread.hot_floor(10**12, 50_000) == 5 * 10**6  # at most 200,000 keys hold as many of 1e12 rows
    assert spread.hot_keys(judged, "normalized_url", "n_links") is None
    assert hot.fans is None
    large = spread.hot_keys(judged, "normalized_url", "n_links", min_rows=100, max_bytes=3)
    assert [r["_fan"] for r in large.fans.collect()] == [2]  # a third of the rows on 4 partitions


def test_fans_follow_the_share_of_a_key(spark):
    links, partitions = 10**12, 50_000
    keys = [("third", links // 3), ("tenth", links // 10), ("just hot", spread.hot_floor(links, partitions))]
    fans = spark.createDataFrame(keys, "key string, n long").select("key", spread.fan_of(F.col("n"), links, partitions).alias("fan"))
    fans = {r["key"]: r["fan"] for r in fans.collect()}
    assert fans == {"third": 16_667, "tenth": 5_000, "just hot": 1}
    # a task has the rows of an average partition at most, and all fans together are few
    assert all(-(-n // fans[key]) <= links // partitions for key, n in keys)
    most = [spread.hot_floor(links, partitions)] * (spread.KEYS_PER_PARTITION * partitions)
    assert sum(most) <= links and sum(-(-n * partitions // links) for n in most) <= 5 * partitions


def test_only_hot_keys_are_repeated(spark, skewed, judged):
    hot = spread.hot_keys(judged, "normalized_url", "n_links", min_rows=100, max_bytes=3)
    facts = judged.select("normalized_url", "outcome")
    again = spread.repeated(facts, ["normalized_url"], hot.fans)
    parts = {(r["normalized_url"], r["_part"]) for r in again.collect()}
    assert len(parts) == facts.count() + 1 and {p for key, p in parts if key == "http://hot/"} == {0, 1}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(spread.lookup(skewed, facts, "normalized_url", hot))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # one join of everything, and only the hashes of the hot keys are broadcast
    assert plan.count("SortMergeJoin Inner") <= 2 and plan.count("BroadcastHashJoin LeftOuter") >= 2


@pytest.mark.parametrize("how", ["inner", "left_semi", "left", "left_anti"])
def test_hot_keys_too_large_to_broadcast_are_dealt(skewed, judged, how):
    hot = spread.hot_keys(judged, "normalized_url", "n_links", min_rows=100, max_bytes=3)
    facts = judged.filter("outcome = 'error'").select("normalized_url", *(["outcome"] if how in ("inner", "left") else []))
    rows = skewed.unionByName(skewed.limit(1).withColumn("normalized_url", F.lit(None).cast("string")))
    dealt = spread.anti_lookup(rows, facts, "normalized_url", hot) if how == "left_anti" else spread.lookup(rows, facts, "normalized_url", hot, how)
    assert as_set(dealt) == as_set(rows.join(facts, "normalized_url", how))
    assert "_part" in plan_of(dealt)


@pytest.mark.parametrize("how", ["inner", "left_semi", "left"])
def test_split_join_equals_plain_join(skewed, judged, how):
    hot = spread.hot_keys(judged, "normalized_url", "n_links", min_rows=100)
    facts = judged.filter("outcome = 'error'").select("normalized_url", "outcome")
    split = spread.lookup(skewed, facts, "normalized_url", hot, how)
    assert as_set(split) == as_set(skewed.join(facts, "normalized_url", how))
    assert split.count() >= 1000


def test_split_anti_join_keeps_rows_without_a_key(spark, skewed, judged):
    hot = spread.hot_keys(judged, "normalized_url", "n_links", min_rows=100)
    rows = skewed.unionByName(skewed.limit(1).withColumn("normalized_url", F.lit(None).cast("string")))
    for cached in (
        judged.filter("outcome = 'error'"),
        judged.filter("outcome = 'fine'"),
        judged.select("normalized_url").unionByName(spark.createDataFrame([(None,)], "normalized_url string")),
    ):
        pruned = queue.without_cached(rows, cached, "normalized_url", hot)
        assert as_set(pruned) == as_set(rows.join(cached.select("normalized_url"), "normalized_url", "left_anti"))
        assert pruned.filter("normalized_url is null").count() == 1


def test_rows_of_hot_keys_are_not_shuffled(spark, skewed, judged):
    hot = spread.hot_keys(judged, "normalized_url", "n_links", min_rows=100)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(report.defects(skewed, judged, hot))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Beyond the size check the cold rows go the shuffled way, the hot ones do not.
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") >= 2


def test_counts_and_listing_of_a_hot_file(spark, skewed, judged):
    hot = spread.hot_keys(judged, "normalized_url", "n_links", min_rows=100)
    rows = scratch.stage(report.defects(skewed, judged, hot), scratch.run_folder(spark), "defects")
    counts = scratch.stage(report.counts_by_file(rows), scratch.run_folder(spark), "counts")
    expected = [r for r in skewed.collect() if r["url"] == "http://hot/" or r["url"].endswith("7")]
    assert rows.count() == len(expected)
    hot_files = spread.hot_keys(counts, report.FILE_KEY, "n", min_rows=50)
    assert [tuple(r) for r in hot_files.keys.collect()] == [("error", "/hot.md")]
    listed = report.listing(rows, verdict.ERROR, counts, hot_files)
    assert as_set(listed) == as_set(report.listing(rows, verdict.ERROR, counts))
    per_file = {}
    for r in expected:
        per_file[r["path"]] = per_file.get(r["path"], 0) + 1
    assert {(r["path"], r["n"]) for r in listed.collect()} == set(per_file.items())
    by_count = report.count_by_file(skewed, judged, verdict.ERROR, hot)
    assert {(r["path"], r["n"]) for r in by_count.collect()} == set(per_file.items())


def test_nested_parts_are_bounded_and_whole(spark, skewed, judged):
    rows = report.defects(skewed, judged)
    nested = report.nested_listing(report.listing(rows, verdict.ERROR))
    parts = nested.filter("path = '/hot.md'").collect()
    assert len(parts) == 3 and all(len(p["items"]) <= report.POSITIONS_PER_PART for p in parts)
    assert sum(len(p["items"]) for p in nested.collect()) == rows.count()


def test_prune_counts_match_the_pruned_rows(skewed, judged):
    cached = judged.filter("outcome = 'error'")
    counts = queue.prune_counts(skewed, cached, "normalized_url").first()
    left = queue.without_cached(skewed, cached, "normalized_url").count()
    assert (counts["rows_before"], counts["rows_after"], counts["rows_skipped"]) == (3000, left, 3000 - left)
    twice = cached.unionByName(cached)
    assert queue.prune_counts(skewed, twice, "normalized_url").first() == counts
