"""Joins of many rows with a unique-key table when some keys are hot.

One URL may be the target of a third of all links. Its rows must not meet in
one task, so hot keys are joined by broadcast, where the rows stay where they
are, and all other keys by an ordinary join, which Spark broadcasts or shuffles
by the size of the table. Every row takes exactly one of the two ways.

A key is hot if it holds a quarter of the rows a shuffle partition has on average, so
there are at most four hot keys a partition. Their bytes are added up before
they are used. If they are too many to broadcast, hot rows are shuffled too, but each hot
key is dealt to as many tasks as it has partitions' worth of rows, and its row of the
unique-key table is repeated for these. Which keys those are is broadcast as hashes: 16
bytes a hot key, whatever the keys' own length. All other rows and keys go once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS_PER_PARTITION = 4
MIN_HOT_ROWS = 1_000_000
MAX_HOT_BYTES = 64 * 1024 * 1024


Key = str | tuple[str, ...]


def _names(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


@dataclass
class HotKeys:
    keys: DataFrame
    count: int
    #: (_hash, _fan): tasks among which the rows of a hot key are dealt; None where hot keys are broadcast.
    fans: DataFrame | None = None


def hot_floor(total: int, partitions: int, min_rows: int = MIN_HOT_ROWS, keys: int = KEYS_PER_PARTITION) -> int:
    """Rows from which a key is hot; at most ``keys`` keys a shuffle partition can have as many, and none under ``min_rows``."""
    return max(min_rows, -(-total // max(1, keys * partitions)))


def fan_of(n: Column, total: int, partitions: int) -> Column:
    """Tasks for a key's rows: so many that each has the rows of an average partition at most.

    All hot keys together have five times as many as there are partitions at most: their
    shares add up to one time, and each of the four a partition is rounded up.
    """
    return F.ceil(n * F.lit(partitions) / F.lit(max(1, total))).cast("int")


def hot_keys(
    counts: DataFrame,
    key: Key,
    n: str,
    min_rows: int = MIN_HOT_ROWS,
    max_bytes: int = MAX_HOT_BYTES,
    keys: int = KEYS_PER_PARTITION,
) -> HotKeys | None:
    """The keys of ``counts(key, n)`` that hold too many rows for one task.

    ``counts`` should be a written table: it is read here and again in the join.
    Four numbers come to the driver; where no key is hot, one small job tells.
    """
    names = _names(key)
    total, largest = counts.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    floor = hot_floor(total, partitions, min_rows, keys)
    if largest < floor:
        return None
    hot = counts.filter(F.col(n) >= floor)
    size = sum((F.octet_length(name) for name in names), F.lit(0))
    found, total_size = hot.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if total_size <= max_bytes:
        return HotKeys(hot.select(*names), found)
    fans = hot.groupBy(F.xxhash64(*names).alias("_hash")).agg(F.max(fan_of(F.col(n), total, partitions)).alias("_fan"))
    return HotKeys(hot.select(*names), found, fans)


def _with_fan(rows: DataFrame, names: list[str], fans: DataFrame) -> DataFrame:
    marked = rows.withColumn("_hash", F.xxhash64(*names)).join(F.broadcast(fans), "_hash", "left")
    return marked.withColumn("_fan", F.coalesce("_fan", F.lit(1))).drop("_hash")


def repeated(facts: DataFrame, names: list[str], fans: DataFrame) -> DataFrame:
    """``facts`` with ``_part``: a hot key's row once for each of its tasks, any other once."""
    parts = F.explode(F.sequence(F.lit(0), F.col("_fan") - 1))
    return _with_fan(facts, names, fans).withColumn("_part", parts).drop("_fan")


def _dealt(rows: DataFrame, facts: DataFrame, names: list[str], how: str, fans: DataFrame) -> DataFrame:
    """The join with the rows of hot keys dealt to several tasks each, by what else is in a row."""
    part = F.pmod(F.xxhash64(*rows.columns), F.col("_fan")).cast("int")
    dealt = _with_fan(rows, names, fans).withColumn("_part", part).drop("_fan")
    return dealt.join(repeated(facts, names, fans), [*names, "_part"], how).drop("_part")


def lookup(rows: DataFrame, facts: DataFrame, key: Key, hot: HotKeys | None = None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts``, which has each key once; how: inner, left_semi or left."""
    names = _names(key)
    if hot is None:
        return rows.join(facts, names, how)
    if hot.fans is not None:
        return _dealt(rows, facts, names, how, hot.fans)
    keys = F.broadcast(hot.keys)
    hot_facts = F.broadcast(facts.join(keys, names, "left_semi"))
    cold = rows.join(keys, names, "left_anti").join(facts, names, how)
    if how == "left":
        warm = rows.join(keys, names, "left_semi").join(hot_facts, names, how)
    else:
        warm = rows.join(hot_facts, names, how)
    return cold.unionByName(warm)


def anti_lookup(rows: DataFrame, facts: DataFrame, key: Key, hot: HotKeys | None = None) -> DataFrame:
    """Rows without a partner in ``facts``; a NULL key never has one."""
    names = _names(key)
    if hot is None:
        return rows.join(facts, names, "left_anti")
    if hot.fans is not None:
        return _dealt(rows, facts.select(*names).distinct(), names, "left_anti", hot.fans)
    keys = F.broadcast(hot.keys)
    hot_facts = F.broadcast(facts.join(keys, names, "left_semi").distinct())
    cold = rows.join(keys, names, "left_anti").join(facts, names, "left_anti")
    warm = rows.join(keys, names, "left_semi").join(hot_facts, names, "left_anti")
    return cold.unionByName(warm)
