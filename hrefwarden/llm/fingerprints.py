"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range. Since
the limit is the same for all texts, the sketch of a union is the union of the
sketches, and the share of one sketch's hashes found in another estimates
containment however unequal the two texts are. Where no hash is below the limit,
the smallest one is kept, so that only a text without words has an empty sketch. What
such a text is contained in, or a group of nothing else, its sketch cannot tell: unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hrefwarden import scratch
from hrefwarden.llm import words as W

SHINGLE_WORDS = 5
#: Hex digits of a kept hash.
DIGITS = 16
#: A hash stays if it sorts below this, and as a number below the other: two sixteenths of the range.
LIMIT, LIMIT_NUMBER = "2", 1 << 61


def shingle_hashes(words: str, width: int = SHINGLE_WORDS) -> Column:
    """Hashes of all shingles of the array column; with fewer words, of the whole sequence; none without words."""

    def hashed(*parts):
        return F.substring(F.md5(F.concat_ws(" ", *parts).cast("binary")), 1, DIGITS)

    short = F.when(F.size(words) > 0, F.array(hashed(F.col(words)))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(words) >= width, W.windows(words, width, hashed)).otherwise(short)


def retained(hashes: Column) -> Column:
    """The sketch of an array of hashes: what stays, ascending, as numbers."""
    low = F.sort_array(F.array_distinct(F.filter(hashes, lambda h: h < LIMIT)))
    least = F.when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(hashes)
    kept = F.transform(F.array(low), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(least))[0]
    return F.transform(kept, lambda h: F.conv(h, 16, -10).cast("long"))


def written(sketch: Column) -> Column:
    """A sketch as text: its hashes' digits, one after the other."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), DIGITS, "0"))), "")


def sketched(rows: DataFrame, text: str, into: str) -> DataFrame:
    """``rows`` with the sketch of a text column, an ascending array of numbers, in ``into``."""
    found, hashes = f"__words_{into}", f"__hashes_{into}"
    lowered = F.lower(F.col(text))
    rows = rows.withColumn(found, W.words(lowered)).withColumn(hashes, shingle_hashes(found))
    return rows.withColumn(into, retained(F.col(hashes))).drop(found, hashes)


def likeness(a: Column, b: Column) -> Column:
    """Shared part of two sketches' union; two empty ones are equal texts."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union).cast("double")


def _below_limit(sketch: str | Column) -> Column:
    return F.filter(sketch, lambda h: (h >= 0) & (h < LIMIT_NUMBER))


def containment(a: Column, b: Column) -> Column:
    """Share of ``a`` that is in ``b``, as estimated by their sketches; null, unknown, if no hash of ``a`` is below the limit."""
    known = F.size(F.array_intersect(a, b)) / F.size(a)
    return F.when(F.size(a) == 0, 1.0).when(F.size(_below_limit(a)) > 0, known).cast("double")


def merged(rows: DataFrame, by: str, sketch: str = "sketch") -> DataFrame:
    """(by, hash): the union sketch of each group, one row a hash, so that no group is gathered in one row.

    A group that has words but no hash below the limit has one row, its hash null.
    """
    low = _below_limit(sketch)
    groups = rows.groupBy(by).agg(F.max(F.size(low)).alias("low"), F.max(F.size(sketch)).alias("all"))
    unknown = groups.where((F.col("low") <= 0) & (F.col("all") > 0)).select(by, F.lit(None).cast("long").alias("hash"))
    return rows.select(by, F.explode(low).alias("hash")).distinct().unionByName(unknown)


def merged_containment(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, containment) of every group of ``left`` in every group of ``right`` that it shares a hash with.

    A group of ``left`` whose hash is null has one row, its containment and ``b`` null: unknown.
    """
    sizes = left.groupBy(a).agg(F.count("*").alias("hashes"))
    shared = left.join(right, "hash").groupBy(a, b).agg(F.count("*").alias("shared"))
    found = shared.join(sizes, a).select(a, b, (F.col("shared") / F.col("hashes")).alias("containment"))
    unknown = left.where(F.col("hash").isNull()).select(a, F.lit(None).cast(right.schema[b].dataType).alias(b), F.lit(None).cast("double").alias("containment"))
    return found.unionByName(unknown)


def _neighbours(ids: DataFrame, folder: str) -> DataFrame:
    """(doc_id, prev_id, reach): which id comes before each, and its reach; before the first comes the last.

    ``ids``: distinct doc_id with reach. Ids are dealt by ranges; within a
    range a window knows the one before, and the first of a range takes the last of
    the nearest range before that has any: one row for each range.
    """
    ranged = ids.repartitionByRange(F.col("doc_id").asc_nulls_first()).withColumn("part", F.spark_partition_id())
    ranged = scratch.stage(ranged, folder, "ids")
    within = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first())
    rows = ranged.withColumns(
        {
            "first": F.row_number().over(within) == 1,
            "prev": F.lag(F.struct("doc_id", "reach")).over(within),
        }
    )
    lasts = ranged.groupBy("part").agg(F.max_by(F.struct("doc_id", "reach"), F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("last"))
    ranges = Window.orderBy("part")
    edge = lasts.select(
        F.col("part").alias("edge_part"),
        F.coalesce(F.lag("last").over(ranges), F.last("last").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("edge"),
    )
    rows = rows.join(edge, F.col("part") == F.col("edge_part"), "left")
    before = F.when(F.col("first"), F.col("edge")).otherwise(F.col("prev"))
    return rows.select("doc_id", before["doc_id"].alias("prev_id"), before["reach"].alias("reach"))


def with_next(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, text, sketch, next_piece, next_sketch): each row with the sketch of the next document and its first part.

    The next document is the one of the next greater doc_id, after the last the
    first; null ids come first and are one document. Where rows repeat a doc_id, its
    text as a neighbour is that of the least SHA-256, and each row has its own result.
    Only a quarter's length of the neighbour's text travels. Texts are shuffled once: both
    joins are left joins of the same rows on the same key, so they share the exchange.
    """
    rows = docs.select("doc_id", W.whole(F.col("text")).alias("text"))
    rows = sketched(rows, "text", "sketch")
    reach = F.floor(F.length(W.whole(F.col("text"))) / 4).cast("long")
    ids = docs.select("doc_id", reach.alias("reach")).groupBy("doc_id").agg(F.max("reach").alias("reach"))
    near = scratch.stage(_neighbours(ids, folder).withColumnRenamed("doc_id", "near_id"), folder, "near")
    own = rows.join(near, rows.doc_id.eqNullSafe(near.near_id), "left")
    piece = F.substring(F.col("text"), F.lit(1), F.col("reach").cast("int"))
    pieces = own.select("prev_id", F.struct(piece.alias("text"), "sketch").alias("piece"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    pieces = pieces.groupBy("prev_id").agg(F.min_by("piece", "sha").alias("piece"))
    found = rows.join(pieces, rows.doc_id.eqNullSafe(pieces.prev_id), "left")
    return found.select("doc_id", "text", "sketch", F.col("piece.text").alias("next_piece"), F.col("piece.sketch").alias("next_sketch"))


def op4_fingerprints(spark, sf_dir) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are; a null text is empty."""
    rows = with_next(W.table(spark, sf_dir, "documents"), W.workspace(spark))
    n = F.length("text")
    reach = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - reach), F.substring(F.col("next_piece"), F.lit(1), reach))
    rows = sketched(rows.withColumn("edited", edited), "edited", "edited_sketch")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def _sketch_sql(text: str) -> str:
    words = f"regexp_extract_all(lower({text}), '[^\\x20\\x09-\\x0D]+')"
    return (
        f"list_transform([{words}], lambda w: CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [md5(array_to_string(w, ' '))[1:16]] "
        "ELSE list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' '))[1:16]) END)[1]"
    )


_KEEP = "CASE WHEN len(list_filter({0}, lambda h: h < '2')) > 0 THEN list_sort(list_distinct(list_filter({0}, lambda h: h < '2'))) WHEN len({0}) > 0 THEN [list_min({0})] ELSE {0} END"
_LIKE = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({0}, {1}))::DOUBLE / len(list_distinct(list_concat({0}, {1}))) END"
SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
following AS (
  SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next_text FROM docs),
edits AS (
  SELECT *, left(text, (length(text) - length(text) // 4)::BIGINT) || left(next_text, (length(text) // 4)::BIGINT) AS edited FROM following),
hashed AS (SELECT *, {_sketch_sql("text")} AS a, {_sketch_sql("edited")} AS b, {_sketch_sql("next_text")} AS c FROM edits),
kept AS (SELECT doc_id, text, edited, {_KEEP.format("a")} AS a, {_KEEP.format("b")} AS b, {_KEEP.format("c")} AS c FROM hashed)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint,
  array_to_string(b, '') AS edited_fingerprint, {_LIKE.format("a", "b")} AS near_edited, {_LIKE.format("a", "c")} AS near_next
FROM kept"""
