"""Quality classifier: histogram gradient-boosted trees over statistics of the text.

The statistics of every text are taken in one pass and stored; a bounded sample of
labelled rows is fetched from them, the trees are grown on histograms of binned
statistics, and flattened into arrays that score whole batches level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrefwarden import scratch
from hrefwarden.llm import arrow_text
from hrefwarden.llm import words as W

#: Labelled rows the trees are grown on, at most; those of the least hashes of the doc_id.
TRAIN_ROWS = 20_000
BINS, TREES, DEPTH, RATE, MIN_LEAF, SHRINK = 64, 60, 4, 0.15, 20, 1.0
THRESHOLD = 0.7

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digits": range(48, 58),
    "blanks": (9, 10, 11, 12, 13, 32),
    "newlines": (10,),
    "symbols": b"#*$%&|<>",
    "stops": b".?",
    "bangs": b"!",
    "commas": b",;:",
    "quotes": b"\"'()[]{}",
    "others": b"@/\\=_+-~^`",
    "controls": [*range(9), *range(14, 32), 127],
    "beyond": range(192, 256),
}
_MASKS = np.zeros((256, len(_CLASSES)))
for _k, _members in enumerate(_CLASSES.values()):
    _MASKS[list(_members), _k] = 1
STATISTICS = (
    "log_chars", "log_words", *_CLASSES, "mean_word", "short_words", "long_words", "distinct_words", "adjacent_words",
    "repeated_triples", "dup_lines", "line_words", "symbol_words", "least_entropy",
)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers for each text; shares lie between 0 and 1, an empty text has zeros."""
    rows = len(offsets) - 1
    counts = np.stack([np.bincount(data[a:b], minlength=256) for a, b in zip(offsets, offsets[1:])]) if rows else np.zeros((0, 256))
    chars = counts.sum(axis=1) - counts[:, 128:192].sum(axis=1)  # without continuation bytes
    many = np.maximum(chars, 1)
    share = counts / np.maximum(counts.sum(axis=1), 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1) / 8
    first, last, bounds = arrow_text.word_spans(data, offsets)
    sums = arrow_text.running_sums(data)
    words = arrow_text.stretch_hashes(sums, first, last)
    n = np.diff(bounds)
    some = np.maximum(n, 1)
    per_row = lambda marks: np.diff(np.concatenate(([0], np.cumsum(marks)))[bounds])
    length = last - first
    symbol = np.concatenate(([0], np.cumsum(_MASKS[data, list(_CLASSES).index("symbols")])))
    owner = np.repeat(np.arange(rows), n)
    inside = owner[1:] == owner[:-1]
    adjacent = np.concatenate((inside & (words[1:] == words[:-1]), [False])) if len(words) else np.zeros(0, dtype=bool)
    distinct, triples = np.zeros(rows), np.zeros(rows)
    three = arrow_text.mixed(arrow_text.mixed(words[:-2] * np.uint64(3) + words[1:-1]) + words[2:]) if len(words) > 2 else words[:0]
    for row in np.flatnonzero(n):
        a, b = bounds[row], bounds[row + 1]
        distinct[row] = _n_distinct(words[a:b])
        if b - a > 3:
            triples[row] = 1 - _n_distinct(three[a : b - 2]) / (b - a - 2)
    dup_lines, n_lines = _lines(data, offsets, sums)
    columns = [
        np.log1p(chars), np.log1p(n), *(counts @ _MASKS / many[:, None]).T, per_row(length) / some, per_row(length <= 3) / some,
        per_row(length >= 13) / some, distinct / some, per_row(adjacent) / some, triples, dup_lines / np.maximum(n_lines, 1),
        n / np.maximum(n_lines, 1), per_row(symbol[last] > symbol[first]) / some, entropy,
    ]
    return np.stack(columns, axis=1).astype(np.float32)


def _n_distinct(values: np.ndarray) -> int:
    ordered = np.sort(values)
    return int(1 + np.count_nonzero(ordered[1:] != ordered[:-1])) if len(values) else 0


def _lines(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the lines that equal another of it but for one each, and all lines with a character."""
    breaks = np.unique(np.concatenate((np.flatnonzero(data == 10), offsets[:-1] - 1, offsets[1:] - 1, [-1, len(data) - 1])))
    first, last = breaks[:-1] + 1, breaks[1:] + 1
    last = last - (data[np.maximum(last - 1, 0)] == 10 if len(data) else 0)
    keep = last > first
    first, last = first[keep], last[keep]
    hashes = arrow_text.stretch_hashes(sums, first, last)
    bounds = np.searchsorted(first, offsets)
    n = np.diff(bounds)
    dup = np.array([k - _n_distinct(hashes[a:b]) for k, a, b in zip(n, bounds, bounds[1:])], dtype=float)
    return dup, n


@dataclass
class Forest:
    """Trees laid end to end. A leaf points at itself; ``value`` is what a row that ends there adds."""

    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row of statistics: all trees go down a level at once."""
        out = np.empty(len(rows))
        for a in range(0, len(rows), 4096):
            block = rows[a : a + 4096]
            at = np.broadcast_to(self.roots, (len(block), len(self.roots)))
            for _ in range(self.depth):
                seen = np.take_along_axis(block, self.feature[at], axis=1)
                at = np.where(seen <= self.limit[at], self.left[at], self.right[at])
            out[a : a + 4096] = 1 / (1 + np.exp(-(self.start + self.value[at].sum(axis=1))))
        return out


def grown(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Trees fitted to the logistic loss; without rows of both labels, a constant.

    Statistics are binned by quantiles. A level of a tree is one histogram over
    (node, statistic, bin) of gradients and curvatures; each node takes the split of
    the greatest gain.
    """
    n, width = rows.shape
    share = (labels.sum() + 1) / (n + 2)
    start = float(np.log(share / (1 - share)))
    flat = {k: [] for k in ("feature", "limit", "left", "right", "value")}
    roots = []
    if 0 < labels.sum() < n:
        edges = [np.unique(np.quantile(rows[:, k], np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) for k in range(width)]
        binned = np.stack([np.searchsorted(e, rows[:, k], side="left") for k, e in enumerate(edges)], axis=1)
        margin = np.full(n, start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            roots.append(len(flat["feature"]))
            margin += _grow_tree(binned, edges, labels - p, p * (1 - p), depth, flat)
    arrays = {k: np.asarray(v, dtype=np.float32 if k == "limit" else np.float64 if k == "value" else np.int64) for k, v in flat.items()}
    return Forest(roots=np.asarray(roots, dtype=np.int64), start=start, depth=depth, **arrays)


def _grow_tree(binned, edges, gradient, curvature, depth: int, flat: dict) -> np.ndarray:
    """Add one tree to ``flat``; what it gives each row."""
    n, width = binned.shape

    def node(members_g, members_h) -> int:
        flat["feature"].append(0)
        flat["limit"].append(np.inf)
        here = len(flat["feature"]) - 1
        flat["left"].append(here)
        flat["right"].append(here)
        flat["value"].append(RATE * members_g / (members_h + SHRINK))
        return here

    nodes = np.array([node(gradient.sum(), curvature.sum())])
    at = np.zeros(n, dtype=np.int64)
    place = np.full(n, nodes[0])
    columns = np.arange(width) * BINS
    for _ in range(depth):
        live = at >= 0
        cells = ((at[live, None] * width * BINS) + columns + binned[live]).ravel()
        shape = (len(nodes), width, BINS)
        total = [np.bincount(cells, np.repeat(x, width), minlength=np.prod(shape)).reshape(shape).cumsum(axis=2) for x in (gradient[live], curvature[live])]
        size = np.bincount(cells, minlength=np.prod(shape)).reshape(shape).cumsum(axis=2)
        (g, h), all_g, all_h, all_n = total, total[0][:, :1, -1:], total[1][:, :1, -1:], size[:, :1, -1:]
        gain = g**2 / (h + SHRINK) + (all_g - g) ** 2 / (all_h - h + SHRINK) - all_g**2 / (all_h + SHRINK)
        gain[(size < MIN_LEAF) | (all_n - size < MIN_LEAF)] = -1
        best = gain.reshape(len(nodes), -1).argmax(axis=1)
        worth = gain.reshape(len(nodes), -1).max(axis=1) > 1e-6
        feature, cut = best // BINS, best % BINS
        fresh, target = [], np.full((len(nodes), 2), -1)
        for k in np.flatnonzero(worth):
            f, c = feature[k], cut[k]
            sides = (g[k, f, c], h[k, f, c]), (all_g[k, 0, 0] - g[k, f, c], all_h[k, 0, 0] - h[k, f, c])
            here = nodes[k]
            flat["feature"][here], flat["limit"][here] = f, edges[f][c]
            for side, name in enumerate(("left", "right")):
                made = node(*sides[side])
                flat[name][here] = made
                target[k, side] = len(fresh)
                fresh.append(made)
        if not fresh:
            break
        goes_right = binned[np.arange(n), feature[at]] > cut[at]
        moved = np.where(live, target[at, goes_right.astype(int)], -1)
        nodes = np.array(fresh)
        place = np.where(moved >= 0, nodes[moved], place)
        at = moved
    return np.asarray(flat["value"])[place]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in arrow_text.batch_pieces(batch, "text"):
            rows = statistics(*arrow_text.text_bytes(part.column("text")))
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS))
            lists = pa.ListArray.from_arrays(ends, pa.array(rows.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), lists], names=["doc_id", "stats"])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_measured, "doc_id long, stats array<float>")


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def fitted(measures: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS) -> Forest:
    """Trees from the rows of ``labels`` that are not held out, at most so many."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
    chosen = chosen.groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = measures.join(chosen, "doc_id").select("label", "stats").limit(2 * most).toArrow()
    rows = np.asarray(found["stats"].combine_chunks().flatten(), dtype=np.float32).reshape(-1, len(STATISTICS))
    return grown(rows, np.asarray(found["label"], dtype=np.float64))


def scored(measures: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = measures.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column("stats").flatten(), dtype=np.float32).reshape(-1, len(STATISTICS))
            scores = shared.value.scores(values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    return measures.mapInArrow(run, "doc_id long, score double")


def op10_quality_trees(spark, sf_dir) -> DataFrame:
    """The quality score of every document; null and empty texts are scored by their zero statistics.

    Rows without doc_id are scored, count as not held out and are never learnt from.
    """
    folder = W.workspace(spark)
    measures = scratch.stage(measured(W.table(spark, sf_dir, "documents")), folder, "measures")
    forest = fitted(measures, W.table(spark, sf_dir, "labels"))
    out = F.coalesce(held_out(), F.lit(False)).alias("held_out")
    return scored(measures, forest).select("doc_id", out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
