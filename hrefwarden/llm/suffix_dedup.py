"""Removal of long repeated byte strings with suffix arrays.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts elsewhere,
in the same text or another. No text is compared with all others:

* Each window of ``LENGTH`` bytes is assigned to one of the ``GRAM``-byte strings in
  it, that of the least hash: its anchor. Equal windows have equal anchors. Windows
  that share an anchor follow one another; they and their bytes are the anchor's
  context, some 275 bytes.
* Only contexts whose anchor occurs again matter. Equal contexts are folded into
  one with a count: all windows of a context that occurs twice are repeated.
* What remains to be found are windows that a context which occurs once shares with
  other contexts of its anchor. Contexts are dealt out by anchor, laid end to end and sorted by a
  suffix array over symbols of ``SYMBOL`` bytes counted from the anchor; windows that begin
  neighbouring suffixes and agree in all bytes are repeated.
* An anchor with more than ``MOST`` different contexts would not fit a task. Its
  windows are counted by their digests instead, which is as exact and may be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrefwarden import scratch
from hrefwarden.llm import arrow_text
from hrefwarden.llm import words as W
from hrefwarden.llm.grouping import suffix_array
from hrefwarden.operators import spread

LENGTH, GRAM = 200, 50
SPAN = LENGTH - GRAM + 1
#: Bytes of a symbol of the suffix array, and how many symbols each window holds whole at least.
SYMBOL = 8
SYMBOLS = (LENGTH - SYMBOL + 1) // SYMBOL
#: Contexts of one anchor that one suffix array takes, and bytes it is made of.
MOST, SORTED_BYTES = 10_000, 1 << 18
#: Rows from which an anchor or context may be joined apart from the others.
HOT_ROWS = 100_000

_OCCURRENCES = "doc_id long, row long, anchors array<long>, contexts array<long>, starts array<int>, windows array<int>, places array<int>"


def anchored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """The contexts of all texts: their anchors' and their own hashes, first window, number of windows, anchor's place in them, text.

    The least hash of each window is found by doubling: the minimum over 2k places is
    that of two minima over k. The lower bits hold the place, so the leftmost of equal
    strings wins, and the place comes with it.
    """
    none = np.zeros(0, dtype=np.int64)
    first_windows = offsets[:-1]
    last_windows = offsets[1:] - LENGTH + 1  # end of the places where a window of the text can begin
    if not (last_windows > first_windows).any():
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    sums = arrow_text.running_sums(data)
    grams = np.arange(len(data) - GRAM + 1)
    hashes = arrow_text.stretch_hashes(sums, grams, grams + GRAM)
    bits = np.uint64(max(1, int(len(hashes)).bit_length()))
    least = hashes >> bits << bits | grams.astype(np.uint64)
    width = 1
    while width < SPAN:
        step = min(width, SPAN - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    edge = np.zeros(len(data) + 1, dtype=np.int64)
    some = last_windows > first_windows
    edge[first_windows[some]] += 1
    edge[last_windows[some]] -= 1
    starts = np.flatnonzero(np.cumsum(edge)[: len(place)] > 0)
    text = np.searchsorted(offsets, starts, side="right") - 1
    anchor = place[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    windows = np.diff(np.concatenate((at, [len(starts)])))
    begin = starts[at]
    contexts = arrow_text.stretch_hashes(sums, begin, begin + windows + LENGTH - 1)
    # where the anchor stands in its context tells contexts apart that hold equal bytes
    contexts = arrow_text.mixed(contexts + (anchor[at] - begin).astype(np.uint64))
    return hashes[anchor[at]], contexts, begin, windows, anchor[at] - begin, text[at]


def _occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in arrow_text.batch_pieces(batch, "text"):
            data, offsets = arrow_text.text_bytes(part.column("text"))
            anchors, contexts, begin, windows, places, text = anchored(data, offsets)
            ends = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32))
            lists = [anchors.view(np.int64), contexts.view(np.int64), (begin - offsets[text]).astype(np.int32), windows.astype(np.int32), places.astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row"), *[pa.ListArray.from_arrays(ends, pa.array(x)) for x in lists]],
                names=["doc_id", "row", "anchors", "contexts", "starts", "windows", "places"],
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, context, n, place, bytes) of the contexts that rows (text, wanted) ask for."""
    for batch in batches:
        texts = [t.encode() for t in batch.column("text").to_pylist()]
        rows = [
            (w["anchor"], w["context"], w["n"], w["place"], text[w["start"] : w["start"] + w["windows"] + LENGTH - 1])
            for text, wanted in zip(texts, batch.column("wanted").to_pylist(), strict=True)
            for w in wanted
        ]
        if rows:
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["anchor", "context", "n", "place", "bytes"])


def repeated_windows(contexts: list[bytes], places: list[int]) -> list[np.ndarray]:
    """For each context, at which of its windows begins a string that one of them also has elsewhere.

    Equal windows have their anchor at the same distance, so it is enough to sort the
    suffixes that begin every ``SYMBOL`` bytes from it, ``SYMBOL`` bytes being one symbol;
    a symbol below all others parts the contexts. Neighbours in the suffix array that agree in
    ``SYMBOLS`` symbols are of one class. A window holds that many, the first of them
    less than ``SYMBOL`` bytes behind its begin: windows are equal if class, distance to
    it and the ``SYMBOL`` bytes around are.
    """
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    lengths = np.array([len(c) for c in contexts])
    begins = np.concatenate(([0], np.cumsum(lengths)))
    phase = np.asarray(places) % SYMBOL
    counts = np.maximum(lengths - phase, 0) // SYMBOL
    owner = np.repeat(np.arange(len(contexts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begins[owner] + phase[owner] + SYMBOL * nth
    _, symbols = np.unique(_packed(data, at[:, None] + np.arange(SYMBOL)), return_inverse=True)
    # one place more behind each context, for the symbol that parts them
    joined = np.zeros(len(owner) + len(contexts), dtype=np.int64)
    where = np.arange(len(owner)) + owner
    joined[where] = symbols + 1
    first = np.full(len(joined), -1)
    first[where[nth + SYMBOLS <= counts[owner]]] = at[nth + SYMBOLS <= counts[owner]]
    order = np.asarray(suffix_array(joined.tolist()), dtype=np.int64)
    order = order[first[order] >= 0]
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    for k in range(SYMBOLS):
        same &= joined[order[:-1] + k] == joined[order[1:] + k]
    kind = np.concatenate(([0], np.cumsum(~same)))[: len(order)]
    shared = np.bincount(kind)[kind] > 1 if len(kind) else np.zeros(0, dtype=bool)
    kind, start = kind[shared], first[order[shared]]
    low, high = begins[np.searchsorted(begins, start, side="right") - 1], begins[np.searchsorted(begins, start, side="right")]
    windows, keys, around = [], [], []
    for lead in range(SYMBOL):
        fits = (start - lead >= low) & (start - lead + LENGTH <= high)
        beside = np.concatenate((np.arange(-lead, 0), np.arange(SYMBOL * SYMBOLS, LENGTH - lead)))
        windows.append(start[fits] - lead)
        keys.append(kind[fits] * SYMBOL + lead)
        around.append(_packed(data, start[fits][:, None] + beside))
    windows, keys, around = (np.concatenate(x) for x in (windows, keys, around))
    order = np.lexsort((around, keys))
    equal = (keys[order[:-1]] == keys[order[1:]]) & (around[order[:-1]] == around[order[1:]])
    twice = np.zeros(len(data), dtype=bool)
    twice[windows[order[:-1][equal]]] = twice[windows[order[1:][equal]]] = True
    return [np.flatnonzero(twice[x:y]) for x, y in zip(begins, begins[1:])]


def _packed(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ``SYMBOL`` bytes at each row of places as one number."""
    return np.ascontiguousarray(data[at]).view(">u8").ravel().astype(np.uint64)


def _sorted_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, context, spans) of rows (anchor, context, n, place, bytes) that come anchor by anchor."""
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if rows and size >= SORTED_BYTES and rows[-1][0] != row[0]:
                yield _spans(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[4])
    if rows:
        yield _spans(rows)


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    """What contexts that occur once share with others; those that occur more often are whole already."""
    spans: dict[int, list] = {k: [] for k, r in enumerate(rows) if r[2] == 1}
    for row, found in enumerate(repeated_windows([r[4] for r in rows], [r[3] for r in rows])):
        if row in spans and len(found):
            breaks = np.flatnonzero(np.diff(found) > 1)
            ends = zip(found[np.concatenate(([0], breaks + 1))], found[np.concatenate((breaks, [-1]))])
            spans[row] = [{"first": int(a), "last": int(b)} for a, b in ends]
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    names = [pa.array([rows[k][i] for k in spans], pa.int64()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([*names, pa.array(list(spans.values()), kind)], names=["anchor", "context", "spans"])


_SPANS = "array<struct<first:int,last:int>>"


def _counted(crowded: DataFrame) -> DataFrame:
    """(anchor, context, spans) of the contexts of crowded anchors, by counting their windows' digests."""
    places = F.sequence(F.lit(0), F.length("bytes") - LENGTH)
    windows = crowded.select("anchor", "context", "n", "bytes", F.explode(places).alias("at"))
    digest = F.sha2(F.substring(F.col("bytes"), F.col("at") + 1, F.lit(LENGTH)), 256)
    windows = windows.select("anchor", "context", "n", "at", F.unhex(F.substring(digest, 1, 32)).alias("digest"))
    twice = windows.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest")
    found = windows.join(twice, "digest").select("anchor", "context", F.struct(F.col("at").alias("first"), F.col("at").alias("last")).alias("span"))
    return found.groupBy("anchor", "context").agg(F.collect_list("span").alias("spans"))


def repeated_spans(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, row, spans) of docs(doc_id, row, text): the bytes to remove, each [first, last), in order and disjoint."""
    found = scratch.stage(docs.mapInArrow(_occurring, _OCCURRENCES), folder, "anchors")
    again = found.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    again = scratch.stage(again, folder, "again")
    parts = F.arrays_zip("anchors", "contexts", "starts", "windows", "places")
    rows = found.select("doc_id", "row", F.inline(parts)).withColumnsRenamed({"anchors": "anchor", "contexts": "context", "starts": "start", "places": "place"})
    hot = spread.hot_keys(again, "anchor", "n", HOT_ROWS)
    rows = scratch.stage(spread.lookup(rows, again.select("anchor"), "anchor", hot), folder, "occurrences")
    scratch.release(docs.sparkSession, f"{folder}/anchors")

    first = F.min(F.struct("doc_id", "row", "start", "windows", "place")).alias("at")
    folded = scratch.stage(rows.groupBy("anchor", "context").agg(F.count("*").alias("n"), first), folder, "folded")
    kinds = folded.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
    kinds = scratch.stage(kinds.where("kinds > 1 and least = 1").drop("least"), folder, "kinds")
    whole = folded.where("n > 1").select(
        "anchor", "context", F.array(F.struct(F.lit(0).alias("first"), (F.col("at.windows") - 1).alias("last"))).cast(_SPANS).alias("spans")
    )
    wanted = folded.join(kinds, "anchor", "left_semi").select("at.doc_id", "at.row", "anchor", "context", "n", "at.start", "at.windows", "at.place")
    wanted = wanted.groupBy("doc_id", "row").agg(F.collect_list(F.struct("anchor", "context", "n", "start", "windows", "place")).alias("wanted"))
    wanted = wanted.select(F.col("doc_id").alias("wanted_id"), F.col("row").alias("wanted_row"), "wanted")
    asked = docs.join(wanted, (F.col("row") == F.col("wanted_row")) & F.col("doc_id").eqNullSafe(F.col("wanted_id")))
    cut = asked.select("text", "wanted").mapInArrow(_cut, "anchor long, context long, n long, place int, bytes binary")
    cut = scratch.stage(cut.dropDuplicates(["anchor", "context"]).join(kinds, "anchor"), folder, "cut")
    few = cut.where(F.col("kinds") <= MOST).select("anchor", "context", "n", "place", "bytes")
    dealt = few.repartition("anchor").sortWithinPartitions("anchor", "context")
    by_sorting = dealt.mapInArrow(_sorted_together, f"anchor long, context long, spans {_SPANS}")
    by_counting = _counted(cut.where(F.col("kinds") > MOST))
    spans = scratch.stage(whole.unionByName(by_sorting).unionByName(by_counting), folder, "spans").where(F.size("spans") > 0)

    # a hot context is one that occurs again, so it has one span
    hot = spread.hot_keys(folded, ("anchor", "context"), "n", HOT_ROWS)
    covered = spread.lookup(rows, spans, ("anchor", "context"), hot).select("doc_id", "row", "start", F.inline("spans"))
    covered = covered.select("doc_id", "row", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last") + LENGTH).alias("last"))
    merged = covered.distinct().groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))
    return scratch.stage(merged, folder, "removed")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in arrow_text.batch_pieces(batch, "text"):
            kept, sizes, removed, runs = [], [], [], []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                data = text.encode()
                pieces, at, n = [], 0, 0
                for first, last in _disjoint(spans or ()):
                    pieces.append(data[at:first])
                    at, n = last, n + 1
                pieces.append(data[at:])
                kept.append(b"".join(pieces))
                sizes.append(len(data))
                removed.append(len(data) - len(kept[-1]))
                runs.append(n)
            numbers = [pa.array(x, pa.int64()) for x in (sizes, removed, runs)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *numbers, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            )


def _disjoint(spans) -> Iterator[tuple[int, int]]:
    """Ordered spans with what overlaps or touches made one."""
    first = last = None
    for span in spans:
        if last is None or span["first"] > last:
            if last is not None:
                yield first, last
            first, last = span["first"], span["last"]
        else:
            last = max(last, span["last"])
    if last is not None:
        yield first, last


def deduplicated(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row of docs(doc_id, text).

    A null text is empty. Rows that repeat a text are copies of each other, also
    under one doc_id, and lose what they share; what is kept may end within a character.
    """
    text = W.whole(F.col("text"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("row"), text.alias("text"))
    spans = repeated_spans(docs, folder).withColumnsRenamed({"doc_id": "span_id", "row": "span_row"})
    rows = docs.join(spans, (F.col("row") == F.col("span_row")) & F.col("doc_id").eqNullSafe(F.col("span_id")), "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op7_suffix_dedup(spark, sf_dir) -> DataFrame:
    """Removed bytes of every document; null and empty texts have 0 bytes, repeated rows lose what they share."""
    rows = deduplicated(W.table(spark, sf_dir, "documents"), W.workspace(spark))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
