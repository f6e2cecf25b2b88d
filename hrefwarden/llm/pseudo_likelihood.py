"""Masked pseudo-likelihood of documents.

A window network sees the words on both sides of a place, but not the word itself,
and gives the probability of every word of the vocabulary to stand there. A
document's score is the sum of the log-probabilities of its own words. The network
is trained in numpy inside tasks: each task starts from the shared weights, runs
over all its documents and sends back what it arrived at; Spark sums the weights,
many in a row. The rounds learn from disjoint parts of the places, which together are
all places of all documents. What is gathered grows with the number of tasks.

The output has three factors: the class of the word (words of like frequency), the
place within it, and the word's share of its place. The most frequent words have places
of their own; the others share places by their hash, and their share is their count
over that of the place, from the counts of all words, which stay a table and are
joined. The number of places of both kinds grows with the distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrefwarden import scratch
from hrefwarden.llm import arrow_text
from hrefwarden.llm import words as W

#: Least number of classes, which is also that of places a class; the distinct words up to which it does; all places then.
CLASSES, FEW_WORDS = 64, 1 << 17
WORDS = CLASSES * CLASSES
#: Words seen on each side, and numbers an inner layer has.
SIDE, WIDTH = 2, 24
#: Rounds of training, places a step, and its length.
ROUNDS, STEP_PLACES, STEP_LENGTH = 2, 16384, 0.06
#: Places scored at once, and logits made at once, which are to stay in the cache of a core.
SCORED, BLOCK_CELLS = 1 << 17, 1 << 17
#: Weights that tasks send in one row.
CELLS = 32
#: Logits up to which sums of exponentials stay within 32 bits.
LARGEST_LOGIT = 80

_OFFSETS = [k for k in range(-SIDE, SIDE + 1) if k]
_EDGE = -1  # stands before the first and after the last word of a document; the last row of its weights


def classes_for(distinct: int) -> int:
    """How many classes, and places in each, a vocabulary of so many words has: places grow with the cube root."""
    return max(CLASSES, round(CLASSES * (distinct / FEW_WORDS) ** (1 / 6)))


def own_places(words: int) -> int:
    """How many of all places belong to one word; the others are shared."""
    return words * 3 // 4


@dataclass
class Network:
    """Weights by name, the vocabulary and the counts it is made of.

    The hashes of the words with places of their own, ascending, with these places; the
    words each shared place was seen with; (word, n) of the words that share places and occur again.
    """

    weights: dict[str, np.ndarray]
    hashes: np.ndarray
    places: np.ndarray
    totals: np.ndarray
    counts: DataFrame | None = None

    @property
    def own(self) -> int:
        return len(self.weights["word"]) - len(self.totals)

    def __post_init__(self):
        # Words are looked up by the leading bits of their hashes, so many that few slots hold two words.
        bits = max(8, (8 * len(self.hashes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))

    def words_of(self, hashed: np.ndarray) -> np.ndarray:
        """The vocabulary's number of each word hash."""
        words = self.own + hashed.view(np.int64) % np.int64(len(self.totals))
        slot = (hashed >> self.shift).astype(np.int64)
        at, ends = self.slots[slot], self.slots[slot + 1]
        left = np.flatnonzero(at < ends)
        at, ends = at[left], ends[left]
        while len(left):
            found = self.hashes[at] == hashed[left]
            words[left[found]] = self.places[at[found]]
            at += 1
            more = ~found & (at < ends)
            left, at, ends = left[more], at[more], ends[more]
        return words

    def least_shares(self, words: np.ndarray) -> np.ndarray:
        """Log of the share of its place that a word seen once or never has; n times that for a word seen n times."""
        return -np.log1p(self.totals[words - self.own])


def started(counts: list[tuple[int, int]], total: int, classes: int = CLASSES, totals: np.ndarray | None = None) -> Network:
    """A network that knows how frequent words are and nothing else.

    ``counts``: (hash, n) of words with places of their own, most frequent first; ``totals``: the
    words of each shared place, all alike if not given.
    """
    rng = np.random.default_rng(11)
    words = classes * classes
    own = own_places(words)
    if totals is None:
        totals = np.full(words - own, max(0, total - sum(c for _, c in counts)) / (words - own))
    n = np.full(words, 0.5)
    n[: len(counts)] += [c for _, c in counts]
    n[own:] += totals
    share = n.reshape(classes, classes)
    weights = {
        "seen": rng.normal(0, 0.3, (words + 1, WIDTH)),
        "offset": np.ones((len(_OFFSETS), WIDTH)) / SIDE,
        "inner": np.zeros(WIDTH),
        "class": np.zeros((classes, WIDTH)),
        "class_bias": np.log(share.sum(axis=1) / n.sum()),
        "word": np.zeros((words, WIDTH)),
        "word_bias": np.log(share / share.sum(axis=1, keepdims=True)).ravel(),
    }
    hashes = np.array([h for h, _ in counts], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Network({k: v.astype(np.float32) for k, v in weights.items()}, hashes[order], order, np.asarray(totals, dtype=np.float64))


def padded(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with edges around each document, and where each word then stands."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(len(words)) + SIDE * (owner + 1)
    out = np.full(len(words) + SIDE * len(bounds), _EDGE, dtype=np.int64)
    out[at] = words
    return out, at


def drawn(hashed: np.ndarray, bounds: np.ndarray, turn: int) -> np.ndarray:
    """Which places a round learns from: each place of a document belongs to one round, however texts are batched."""
    n = np.diff(bounds)
    within = np.arange(len(hashed)) - np.repeat(bounds[:-1], n)
    return arrow_text.mixed(hashed + within.astype(np.uint64)) % np.uint64(ROUNDS) == np.uint64(turn)


# Of logits and what is made of them, each column is a place. Biases are the last weight of each row, which meets a
# one after the numbers of the inner layer, so that products add them.


def _layer(w: dict, layer: str) -> tuple[np.ndarray, bool]:
    """Weights and biases of a layer, and whether logits can get so large that exponentials need the largest subtracted."""
    rows = np.column_stack((w[layer], w[f"{layer}_bias"]))
    largest = (np.abs(rows) @ np.ones(WIDTH + 1, dtype=rows.dtype)).max()  # as the inner layer is within -1 and 1
    return rows, not largest <= LARGEST_LOGIT


def _blocks(n: int, rows: int) -> Iterator[slice]:
    step = max(1, BLOCK_CELLS // rows)
    for a in range(0, n, step):
        yield slice(a, min(a + step, n))


def _within(parts: list[tuple[int, int, slice]], block: slice) -> Iterator[tuple[slice, slice, slice]]:
    """What a block has of each part: where in the block, where among all places, and the rows of the part."""
    for first, last, own in parts:
        a, b = max(first, block.start), min(last, block.stop)
        if a < b:
            yield slice(a - block.start, b - block.start), slice(a, b), own


def _logits(rows: np.ndarray, shifted: bool, h: np.ndarray, found: list[tuple[slice, slice, slice]]) -> np.ndarray:
    logits = np.empty((found[0][2].stop - found[0][2].start, found[-1][0].stop), dtype=h.dtype)
    for here, places, own in found:
        np.matmul(rows[own], h[places].T, out=logits[:, here])
    if shifted:
        logits -= logits.max(axis=0)
    return logits


def _column_sums(x: np.ndarray) -> np.ndarray:
    return np.ones(len(x), dtype=x.dtype) @ x


def _log_shares(layer: tuple[np.ndarray, bool], h: np.ndarray, number: np.ndarray, parts: list[tuple[int, int, slice]]) -> np.ndarray:
    """The log of the share that the row ``number`` of its part has of each place."""
    out = np.empty(len(h), dtype=h.dtype)
    for block in _blocks(len(h), parts[0][2].stop - parts[0][2].start):
        logits = _logits(*layer, h, list(_within(parts, block)))
        found = logits[number[block], np.arange(logits.shape[1])]
        out[block] = found - np.log(_column_sums(np.exp(logits, out=logits)))
    return out


def _gradients_of(layer: tuple[np.ndarray, bool], h: np.ndarray, number: np.ndarray, parts: list[tuple[int, int, slice]]) -> tuple[np.ndarray, np.ndarray]:
    """The gradients of a layer's rows and of the inner layer."""
    rows, _ = layer
    weights, back = np.zeros_like(rows), np.empty((len(h), WIDTH), dtype=h.dtype)
    for block in _blocks(len(h), parts[0][2].stop - parts[0][2].start):
        found = list(_within(parts, block))
        off = _logits(*layer, h, found)
        np.exp(off, out=off)
        total = _column_sums(off)
        off[number[block], np.arange(len(total))] -= total  # now the shares less the word's own, times the total
        share = (1 / total)[:, None]
        scaled = h[block] * share
        for here, places, own in found:
            np.matmul(off[:, here].T, rows[own, :WIDTH], out=back[places])
            weights[own] += off[:, here] @ scaled[here]
        back[block] *= share
    return weights, back


def _levels(w: dict, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[tuple[str, np.ndarray, list]]]:
    """The order of places by the class of their words, and for each layer in that order: numbers within the rows that
    can be there, and (first, last, these rows) of places that have them in common."""
    classes = len(w["class"])
    size = len(w["word"]) // classes
    kind, number = np.divmod(text[at].astype(np.int32), np.int32(size))
    order = np.argsort(kind.astype(np.uint16), kind="stable")
    kind, number = kind[order], number[order]
    ends = np.searchsorted(kind, np.arange(classes + 1))
    parts = [(ends[k], ends[k + 1], slice(k * size, (k + 1) * size)) for k in np.flatnonzero(np.diff(ends))]
    return order, [("class", kind, [(0, len(at), slice(0, classes))]), ("word", number, parts)]


def _inner(w: dict, text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The inner layer at places, and a one after it."""
    h = np.ones((len(at), WIDTH + 1), dtype=w["seen"].dtype)
    sent = [w["seen"] * offset for offset in w["offset"]]
    sent[0] += w["inner"]
    for part in _blocks(len(at), WIDTH):
        here = at[part]
        total = np.take(sent[0], text[here + _OFFSETS[0]], axis=0)  # an edge, -1, has the last row
        for k in range(1, len(_OFFSETS)):
            total += np.take(sent[k], text[here + _OFFSETS[k]], axis=0)
        h[part, :WIDTH] = np.tanh(total, out=total)
    return h


def log_probabilities(w: dict, text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-probability of the vocabulary's number at each place, given its neighbours."""
    out = np.empty(len(at))
    layers = {name: _layer(w, name) for name in ("class", "word")}
    for first in range(0, len(at), SCORED):
        here = at[first : first + SCORED]
        order, levels = _levels(w, text, here)
        h = _inner(w, text, here[order])
        scores = np.zeros(len(h), dtype=h.dtype)
        for name, number, parts in levels:
            scores += _log_shares(layers[name], h, number, parts)
        out[first + order] = scores
    return out


def _gradients(w: dict, text: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    order, levels = _levels(w, text, at)
    at = at[order]
    h = _inner(w, text, at)
    g = {"offset": np.empty_like(w["offset"])}
    back = np.zeros((len(at), WIDTH), dtype=h.dtype)
    for name, number, parts in levels:
        weights, more = _gradients_of(_layer(w, name), h, number, parts)
        g[name], g[f"{name}_bias"] = weights[:, :WIDTH], weights[:, WIDTH]
        back += more
    h *= h
    back *= np.subtract(1, h, out=h)[:, :WIDTH]
    g["inner"] = _column_sums(back)
    for k, offset in enumerate(_OFFSETS):
        seen = np.take(w["seen"], text[at + offset], axis=0)
        g["offset"][k] = _column_sums(np.multiply(back, seen, out=seen))
    # What all places send to a neighbour meets there before it is summed by word.
    first = at.min() - SIDE
    near = text[first : at.max() + SIDE + 1]
    near = np.where(near < 0, len(w["seen"]) - 1, near)
    sent = np.zeros((len(near) + 2 * SIDE, WIDTH), dtype=back.dtype)
    sent[at - first + SIDE] = back
    towards, more = np.empty((2, len(near)), dtype=back.dtype)
    sums = np.empty((WIDTH, len(w["seen"])), dtype=back.dtype)
    for d, column in enumerate(np.ascontiguousarray(sent.T)):
        towards[:] = 0
        for k, offset in enumerate(_OFFSETS):
            towards += np.multiply(column[SIDE - offset : SIDE - offset + len(near)], w["offset"][k, d], out=more)
        sums[d] = np.bincount(near, towards, minlength=len(w["seen"]))
    g["seen"] = np.ascontiguousarray(sums.T)
    return g


def _keep_freed_memory() -> None:
    """Have the C library keep the memory that steps free and take again; it goes by the largest array freed, up to 32 MB."""
    np.empty((32 << 20) - (1 << 16), dtype=np.uint8)


class Trainer:
    """Adaptive gradient steps from given weights; ``places`` counts what it has learnt from."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = {k: v.copy() for k, v in weights.items()}
        self.squares = {k: np.full_like(v, 1e-6) for k, v in weights.items()}
        self.places = 0

    def learn(self, text: np.ndarray, at: np.ndarray) -> None:
        for first in range(0, len(at), STEP_PLACES):
            here = at[first : first + STEP_PLACES]
            for name, g in _gradients(self.weights, text, here).items():
                g /= len(here)
                self.squares[name] += g * g
                self.weights[name] -= STEP_LENGTH * g / np.sqrt(self.squares[name])
            self.places += len(here)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in arrow_text.batch_pieces(batch, "text"):
            hashed, _ = arrow_text.word_hashes(*arrow_text.text_bytes(part.column("text")))
            words, n = np.unique(hashed, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])


def vocabulary(docs: DataFrame) -> Network:
    """Word counts over all documents; the most frequent words and the totals of the shared places come to the driver."""
    counts = docs.select("text").mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = scratch.stage(counts, scratch.run_folder(docs.sparkSession), "counts")
    distinct, total = counts.agg(F.count("*"), F.sum("n")).first()
    classes = classes_for(distinct)
    own = own_places(classes * classes)
    shared = classes * classes - own
    top = counts.orderBy(F.desc("n"), "word").limit(own).collect()
    totals = np.zeros(shared)
    for place, n in counts.groupBy(F.pmod("word", F.lit(shared)).alias("place")).agg(F.sum("n")).collect():
        totals[place] = n
    for word, n in top:
        totals[word % shared] -= n
    network = started([(r.word, r.n) for r in top], total or 0, classes, totals)
    least = top[-1].n if top else 0
    return replace(network, counts=counts.where(F.col("n").between(2, least)))


def _flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _sent(weights: dict[str, np.ndarray], places: int) -> Iterator[pa.RecordBatch]:
    """Rows of a task's weights times the places it learnt from; these places are the last number of the last row."""
    flat = _flat(weights)
    values = np.zeros((len(flat) // CELLS + 1, CELLS))  # one number more at least
    np.multiply(flat, places, out=values.ravel()[: len(flat)], dtype=np.float64)
    values[-1, -1] = places
    rows = np.arange(len(values))
    for a in range(0, len(rows), 2_000):
        part = slice(a, a + 2_000)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[part], *np.ascontiguousarray(values[part].T))], names=["row", *_cells()])


def _averaged(sums: pa.Table, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    values = np.empty((sums.num_rows, CELLS))
    values[np.asarray(sums["row"])] = np.column_stack([np.asarray(sums[cell]) for cell in _cells()])
    return _shaped(values.ravel() / values[-1, -1], like)


def _cells() -> list[str]:
    return [f"cell{k}" for k in range(CELLS)]


def trained(docs: DataFrame, network: Network, turn: int) -> Network:
    """One round: every task learns from its documents, the weights are averaged by the places learnt from."""
    shared = docs.sparkSession.sparkContext.broadcast(replace(network, counts=None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_freed_memory()
        own = shared.value
        trainer = Trainer(own.weights)
        for batch in batches:
            for part in arrow_text.batch_pieces(batch, "text"):
                hashed, bounds = arrow_text.word_hashes(*arrow_text.text_bytes(part.column("text")))
                text, at = padded(own.words_of(hashed), bounds)
                trainer.learn(text, at[drawn(hashed, bounds, turn)])
        if trainer.places:
            yield from _sent(trainer.weights, trainer.places)

    rows = docs.select("text").mapInArrow(run, "row long, " + ", ".join(f"{cell} double" for cell in _cells()))
    sums = rows.groupBy("row").agg(*[F.sum(cell).alias(cell) for cell in _cells()]).toArrow()
    return replace(network, weights=_averaged(sums, network.weights)) if sums.num_rows else network


def fitted(docs: DataFrame) -> Network:
    docs = docs.select(F.col("text").cast("string").alias("text"))
    network = vocabulary(docs)
    for turn in range(ROUNDS):
        network = trained(docs, network, turn)
    return network


def _sharing(hashed: np.ndarray, owner: np.ndarray, n_rows: int) -> tuple[pa.Array, pa.Array]:
    """The distinct words of each row and how often they occur in it, as lists; ``owner``: the row of each word, ascending."""
    order = np.argsort(hashed)
    order = order[np.argsort(owner[order].astype(np.uint16 if n_rows <= 1 << 16 else np.int64), kind="stable")]
    hashed, owner = hashed[order], owner[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.concatenate((at, [len(order)])))
    ends = pa.array(np.searchsorted(owner[at], np.arange(n_rows + 1)).astype(np.int32))
    return tuple(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (hashed[at].view(np.int64), n.astype(np.int32)))


def scored(docs: DataFrame, network: Network) -> DataFrame:
    """(doc_id, n_tokens, log_prob) of every row; a text without words has no tokens and scores 0.

    Tasks score places and what a word seen once or never has of a shared place; the logs of
    the counts of words seen more often come from a join with the counts, summed per row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(replace(network, counts=None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_freed_memory()
        own = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in arrow_text.batch_pieces(batch, "text"):
                hashed, bounds = arrow_text.word_hashes(*arrow_text.text_bytes(part.column("text")))
                words = own.words_of(hashed)
                scores = log_probabilities(own.weights, *padded(words, bounds))
                rare = np.flatnonzero(words >= own.own)
                scores[rare] += own.least_shares(words[rare])
                n = np.diff(bounds)
                owner = np.repeat(np.arange(len(n)), n)
                sums = np.bincount(owner, scores, minlength=len(n)).astype(np.float64)
                rows = pa.array(np.arange(row, row + len(n)))
                row += len(n)
                yield pa.RecordBatch.from_arrays(
                    [rows, part.column("doc_id").cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(sums), *_sharing(hashed[rare], owner[rare], len(n))],
                    names=["row", "doc_id", "n_tokens", "log_prob", "words", "times"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(run, "row long, doc_id long, n_tokens long, log_prob double, words array<long>, times array<int>")
    if network.counts is None:
        return rows.select("doc_id", "n_tokens", "log_prob")
    rows = scratch.stage(rows, scratch.run_folder(docs.sparkSession), "scored")
    words = rows.select("row", F.inline(F.arrays_zip("words", "times"))).withColumnRenamed("words", "word")
    # The counts are the smaller side, so that the many words of the rows need not be sorted.
    counts = network.counts.select("word", F.log("n").alias("log_n")).hint("shuffle_hash")
    more = words.join(counts, "word").groupBy("row").agg(F.sum(F.col("times") * F.col("log_n")).alias("more"))
    return rows.join(more, "row", "left").select("doc_id", "n_tokens", (F.col("log_prob") + F.coalesce("more", F.lit(0.0))).alias("log_prob"))


def op2_pseudo_likelihood(spark, sf_dir) -> DataFrame:
    """Log-probability of every document and its mean over the words, null without words."""
    W.workspace(spark)
    docs = W.table(spark, sf_dir, "documents")
    rows = scored(docs, fitted(docs))
    return rows.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
