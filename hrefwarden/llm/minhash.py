"""Near duplicates: SuperMinHash signatures, banding, verification on whole shingle sets, union-find.

* Signatures: each shingle visits the signature's places in a random order of its
  own; at its j-th place it offers j plus a fraction. Offers are thus spread evenly
  over the places, which lowers the variance, and once every place holds less than
  j, no later offer can win and the document is done.
* Texts of equal sets are one node from the start, so copies cost nothing later.
* Bands of the signature give buckets. Of each document in a bucket with others it is
  counted how many of its shingles no other such document has. They bound its likeness
  to any other from above; where the bound is below a link, nothing is compared.
* In each bucket the document with the fewest such shingles, the likeliest original, is
  compared with the others: one comparison a member, not one a pair.
* What that leaves open are pairs of one bucket in different components that could still
  be linked: they share at most the smaller of what they share with the bucket's first
  document, and of the rest at most the smaller part that is not theirs alone; and
  their distances to it differ by no more than a link allows (Jaccard distance is a
  metric). Those are compared too, so that no link of a bucket is lost.
* All comparisons are of whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefwarden import scratch
from hrefwarden.llm import arrow_text
from hrefwarden.llm import words as W
from hrefwarden.llm.components import components

SHINGLE_WORDS = 5
#: A link: this many hundredths of the union are shared.
LINK_PERCENT = 75
#: Places of a signature (a prime), and rows a band. A link at the limit is in no common
#: bucket with a probability of (1 - 0.75 ** 3) ** 32, 2 in 100 million.
PLACES, BAND_ROWS = 97, 3
BANDS = PLACES // BAND_ROWS

_SIGNED = "doc_id long, version long, n_shingles long, set_a long, set_b long, buckets array<long>"


def signatures(hashes: np.ndarray, bounds: np.ndarray, places: int = PLACES) -> np.ndarray:
    """SuperMinHash signatures of sets of 64-bit hashes, one row a set; a set's hashes are hashes[bounds[i]:bounds[i+1]].

    The order in which an element visits the places is an affine permutation drawn
    from its hash; an offer is the turn in the upper bits above a random fraction.
    """
    sets = len(bounds) - 1
    signature = np.full((sets, places), np.iinfo(np.uint64).max, dtype=np.uint64)
    owner = np.repeat(np.arange(sets), np.diff(bounds))
    element = hashes
    drawn = arrow_text.mixed(element ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    step = (np.uint64(1) + drawn % np.uint64(places - 1)).astype(np.int64)
    place = ((drawn >> np.uint64(32)) % np.uint64(places)).astype(np.int64)
    flat = signature.reshape(-1)
    for turn in range(places):
        if not len(owner):
            break
        fraction = arrow_text.mixed(element + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(7)
        np.minimum.at(flat, owner * places + place, fraction | np.uint64(turn << 57))
        settled = signature.max(axis=1) < np.uint64(turn + 1 << 57)
        going = ~settled[owner]
        owner, element, step, place = owner[going], element[going], step[going], place[going]
        place = (place + step) % places
    return signature


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in arrow_text.batch_pieces(batch, "text"):
            data, offsets = arrow_text.text_bytes(part.column("text"))
            hashes, bounds = arrow_text.shingle_hashes(*arrow_text.word_hashes(data, offsets), SHINGLE_WORDS)
            sizes = np.diff(bounds)
            filled = sizes > 0
            signature = signatures(hashes, bounds)
            buckets = np.zeros((len(sizes), BANDS), dtype=np.uint64)
            for k in range(BAND_ROWS):
                buckets = arrow_text.mixed(buckets + signature[:, k : k + BANDS * BAND_ROWS : BAND_ROWS] + np.uint64(k))
            buckets = arrow_text.mixed(buckets + np.arange(BANDS, dtype=np.uint64))[filled]
            ends = np.concatenate(([0], np.cumsum(filled * BANDS))).astype(np.int32)
            digests = []
            for salt in (1, 2):
                sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
                np.cumsum(arrow_text.mixed(hashes * np.uint64(2 * salt + 1) + np.uint64(salt)), out=sums[1:])
                digests.append(arrow_text.mixed(sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("version"),
                    pa.array(sizes),
                    *[pa.array(d) for d in digests],
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(buckets.reshape(-1).view(np.int64))),
                ],
                names=["doc_id", "version", "n_shingles", "set_a", "set_b", "buckets"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in arrow_text.batch_pieces(batch, "text"):
            data, offsets = arrow_text.text_bytes(part.column("text"))
            hashes, bounds = arrow_text.shingle_hashes(*arrow_text.word_hashes(data, offsets), SHINGLE_WORDS)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "shingles"])


def _compared(pairs: DataFrame, sets: DataFrame, folder: str, name: str) -> DataFrame:
    """(a, b, shared, total): the sizes of both sets' intersection and union for every pair."""
    of_b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b"))
    of_a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a"))
    rows = pairs.join(of_b, "b").join(of_a, "a")
    rows = rows.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("shared"), (F.size("of_a") + F.size("of_b")).alias("sizes"))
    return scratch.stage(rows.select("a", "b", "shared", (F.col("sizes") - F.col("shared")).alias("total")), folder, name)


def _linked(percent: int) -> Column:
    return F.col("shared") * 100 >= F.col("total") * percent


def version_of(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def kept(docs: DataFrame, folder: str, percent: int = LINK_PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with the columns they came with; equal rows become one."""
    names = docs.columns
    gone = near_duplicates(docs, folder, percent).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("version").alias("gone_version"))
    rows = docs.withColumn("__version", version_of(F.col("text")))
    left = rows.join(gone, (F.col("doc_id") == F.col("gone_id")) & (F.col("__version") == F.col("gone_version")), "left_anti")
    return left.dropDuplicates(["doc_id", "__version"]).select(*names)


def near_duplicates(docs: DataFrame, folder: str, percent: int = LINK_PERCENT) -> DataFrame:
    """(doc_id, version, n_shingles, component_id, kept) of every row of docs(doc_id, text); version is the text's hash.

    Texts without words (null, empty, blanks only) have no shingles and are linked
    with nothing; nor are rows without doc_id, whose component is null and which
    stay. Rows that repeat a doc_id are judged by their own texts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), version_of(F.col("text")).alias("version"), F.col("text").cast("string").alias("text"))
    signed = scratch.stage(docs.mapInArrow(_signed, _SIGNED), folder, "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    firsts = scratch.stage(full.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("first")), folder, "firsts")
    members = full.join(firsts.withColumnRenamed("first", "doc_id"), ["set_a", "set_b", "n_shingles", "doc_id"], "left_semi")
    bucketed = members.select("doc_id", F.explode("buckets").alias("bucket"))

    shared = bucketed.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    crowded = scratch.stage(bucketed.join(shared.select("bucket"), "bucket", "left_semi").distinct(), folder, "crowded")
    wanted = crowded.select("doc_id").distinct()
    sets = scratch.stage(docs.drop("version").join(wanted, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, shingles array<long>"), folder, "sets")
    able = scratch.stage(_able(sets, percent), folder, "able")
    placed = crowded.join(able, "doc_id")
    hub = F.min(F.struct("lone", "doc_id", "n")).alias("hub")
    hubs = placed.groupBy("bucket").agg(hub, F.count("*").alias("members")).where("members > 1")
    placed = placed.join(hubs.select("bucket", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("doc_id", "lone", "n")]), "bucket")
    placed = scratch.stage(placed, folder, "placed")
    stars = placed.where((F.col("doc_id") != F.col("hub_doc_id")) & _may_link("hub_", "", percent))
    stars = stars.select(F.col("hub_doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()

    by_hub = _compared(stars, sets, folder, "by_hub")
    links = by_hub.where(_linked(percent)).select("a", "b")
    found = components(links, f"{folder}/stars")
    rest = scratch.stage(_open_pairs(placed, by_hub, found, percent), folder, "open_pairs")
    by_pair = _compared(rest, sets, folder, "by_pair")
    more = by_pair.where(_linked(percent)).select("a", "b")
    merged = components(links.union(more), f"{folder}/all")

    of_set = firsts.join(merged, F.col("first") == F.col("node"), "left")
    of_set = of_set.select("set_a", "set_b", "n_shingles", F.coalesce("component", "first").alias("of_set"))
    rows = signed.select("doc_id", "version", "n_shingles", "set_a", "set_b").join(of_set, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("of_set")).otherwise(F.col("doc_id"))
    rows = rows.select("doc_id", "version", "n_shingles", component.alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _able(sets: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, lone) of the documents that can be linked: size of the set, and how many shingles it alone has.

    A doc_id that stands for several sets has no bound: n is null.
    """
    shingles = sets.select("doc_id", F.explode("shingles").alias("shingle"))
    alone = shingles.groupBy("shingle").agg(F.count("*").alias("holders"), F.min("doc_id").alias("doc_id")).where("holders = 1")
    lone = alone.groupBy("doc_id").agg(F.count("*").alias("lone"))
    sizes = sets.groupBy("doc_id").agg(F.count("*").alias("sets"), F.max(F.size("shingles")).cast("long").alias("n"))
    rows = sizes.join(lone, "doc_id", "left").select(
        "doc_id", F.when(F.col("sets") == 1, F.col("n")).alias("n"), F.when(F.col("sets") == 1, F.coalesce("lone", F.lit(0))).otherwise(0).alias("lone")
    )
    return rows.where(F.col("n").isNull() | (F.col("lone") * 100 <= F.col("n") * (100 - percent)))


def _may_link(one: str, other: str, percent: int) -> Column:
    """False if two sets cannot be alike enough: they share at most the smaller of their shared parts, and their union has all the rest."""
    (n1, l1), (n2, l2) = ((F.col(f"{p}n"), F.col(f"{p}lone")) for p in (one, other))
    most = F.least(n1 - l1, n2 - l2)
    union = F.greatest(n1 - l1, n2 - l2) + l1 + l2
    return F.coalesce(most * 100 >= union * percent, F.lit(True))


def _open_pairs(placed: DataFrame, by_hub: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket the comparisons with its hub leave open; see the module's text.

    One side of each pair is outside its hub's component. A pair is made in the first
    bucket it shares and in no other: a link would meet the bounds in every one.
    """
    measured = by_hub.select(F.col("a").alias("hub_doc_id"), F.col("b").alias("doc_id"), "shared", (1 - F.col("shared") / F.col("total")).alias("far"))
    rest = placed.where("doc_id <> hub_doc_id").join(measured, ["hub_doc_id", "doc_id"], "left")
    named = found.select(F.col("node").alias("doc_id"), "component")
    hubs = found.select(F.col("node").alias("hub_doc_id"), F.col("component").alias("of_hub"))
    rest = rest.join(named, "doc_id", "left").join(hubs, "hub_doc_id", "left")
    rest = rest.select(
        "bucket", "doc_id", "n", "lone", "far", "shared",
        F.coalesce("component", "doc_id").alias("component"), F.coalesce("of_hub", "hub_doc_id").alias("of_hub"),
    )
    mine = rest.groupBy("doc_id").agg(F.collect_set("bucket").alias("mine"))  # as many as there are bands
    rest = rest.join(mine, "doc_id")
    apart = rest.where("component <> of_hub").select("bucket", *[F.col(c).alias(f"other_{c}") for c in ("doc_id", "n", "lone", "far", "shared", "component", "mine")])
    most = 1 - percent / 100 + 1e-9
    beside = [F.col(f"{p}n") - F.col(f"{p}shared") - F.col(f"{p}lone") for p in ("", "other_")]
    common = F.least("shared", "other_shared") + F.least(*beside)
    fits = common * 100 >= (F.col("n") + F.col("other_n") - common) * percent
    pairs = rest.join(apart, "bucket").where(
        (F.col("component") != F.col("other_component"))
        & F.coalesce(F.abs(F.col("far") - F.col("other_far")) <= most, F.lit(True))
        & F.when(F.col("shared").isNull() | F.col("other_shared").isNull(), _may_link("", "other_", percent)).otherwise(F.coalesce(fits, F.lit(True)))
        & ((F.col("component") == F.col("of_hub")) | (F.col("doc_id") < F.col("other_doc_id")))
        & (F.col("bucket") == F.array_min(F.array_intersect("mine", "other_mine")))
    )
    return pairs.select(F.least("doc_id", "other_doc_id").alias("a"), F.greatest("doc_id", "other_doc_id").alias("b")).distinct()


def op8_minhash(spark, sf_dir) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(W.table(spark, sf_dir, "documents"), W.workspace(spark)).drop("version")
