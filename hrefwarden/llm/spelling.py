"""Spellings of a word: words one edit apart, and the form the rarer ones stand for.

Two words one edit apart agree in their first half or in their last half, so words meet
by these halves, those of one length and of the next in one group. Within a group words
are rows of letter counts: products of two blocks of them give squared distances, of
which one edit leaves two at most, and the pairs that keep to that are compared letter
by letter. Groups of very many words are dealt to tiles, each a task's work of its own.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrefwarden import scratch
from hrefwarden.llm import arrow_text
from hrefwarden.llm import words as W
from hrefwarden.operators import spread

#: Shortest word in code points, its least occurrences, and the least ratio of a form's occurrences to its word's.
MIN_LETTERS, MIN_COUNT, FORM_RATIO = 5, 3, 2
#: One of so many runs, by its checksum, loses a letter.
SLIP = 97
#: Distinct words a task counts before it passes them on.
HELD = 1 << 18
#: Words of a tile, about, of a block of letter counts, and of the small groups that share one.
TILE_WORDS, BLOCK_WORDS, PACKED_WORDS = 1 << 13, 1 << 11, 1 << 8
#: Places of the letter counts; letters beyond share them.
LETTERS = 96

# Every letter is one byte of Latin-1; all other bytes become blanks, A-Z lower-cased.
_RUNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs_of(text: str) -> list[bytes]:
    """Lower-cased runs of letters, in Latin-1."""
    return text.encode("latin-1", errors="replace").translate(_RUNS).split()


def slipped(run: bytes, prefix: int) -> bytes:
    """The run as it counts: one letter short if its checksum says so; ``prefix`` is that of the id and colon."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, n) of every distinct word of ``MIN_LETTERS`` letters, slips included.

    A null text has no words; a null key counts as an empty one; repeated rows count each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def given():
            words = pa.array([word.decode("latin-1") for word in held], pa.string())
            counts = pa.array(held.values(), pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([words, counts], names=["word", "n"])

        for batch in batches:
            for part in arrow_text.batch_pieces(batch, text):
                for name, value in zip(part.column(key).to_pylist(), part.column(text).to_pylist()):
                    if not value:
                        continue
                    prefix = zlib.crc32(f"{'' if name is None else name}:".encode())
                    for found, n in Counter(runs_of(value)).items():
                        if len(found) >= MIN_LETTERS:
                            word = slipped(found, prefix)
                            if len(word) >= MIN_LETTERS:
                                held[word] += n
                    if len(held) >= HELD:
                        yield given()
        if held:
            yield given()

    chosen = docs.select(F.col(key).cast("string").alias(key), F.col(text).cast("string").alias(text))
    return chosen.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def halves(words: DataFrame, shortest: int = 1) -> DataFrame:
    """(side, size, half, word, n): each word under both halves of its length and of the length before.

    A pair of lengths m and m, or m and m + 1, meets under size m: it agrees in its first
    m // 2 letters or in its last m - m // 2. No word has fewer than ``shortest`` letters.
    """
    length = F.length("word")
    sized = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("size")).where(F.col("size") >= shortest)
    sides = F.array(
        F.struct(F.lit("first").alias("side"), F.expr("left(word, cast(size div 2 as int))").alias("half")),
        F.struct(F.lit("last").alias("side"), F.expr("right(word, size - cast(size div 2 as int))").alias("half")),
    )
    rows = sized.select("word", "n", "size", F.explode(sides).alias("s"))
    return rows.select("s.side", "size", "s.half", "word", "n")


def _dealt(grouped: DataFrame, folder: str, tile_words: int) -> DataFrame:
    """``grouped`` with tiles (row, col, mine): the words of a group are dealt to as many tiles as it is large.

    Tile (row, col) compares the words dealt to ``row`` with those dealt to ``col``; a word
    is copied once for each tile of its row and column. Groups of one tile, nearly all,
    are not copied.
    """
    group = ["side", "size", "half"]
    counts = grouped.groupBy(*group).agg(F.count("*").alias("members")).where(F.col("members") > tile_words)
    large = scratch.stage(counts.withColumn("tiles", F.ceil(F.col("members") / tile_words).cast("int")), folder, "large_groups")
    known = spread.lookup(grouped, large, tuple(group), spread.hot_keys(large, tuple(group), "members"), "left")
    tiles = F.coalesce("tiles", F.lit(1))
    known = known.select(*group, "word", "n", tiles.alias("tiles"), F.pmod(F.xxhash64("word"), tiles).cast("int").alias("mine"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    spreaded = known.select(*group, "word", "n", "mine", other)
    return spreaded.select(*group, F.least("mine", "other").alias("row"), F.greatest("mine", "other").alias("col"), "mine", "word", "n")


def letter_counts(words: list[str]) -> np.ndarray:
    """One row a word: how often it has each letter. 32 bits hold products of ordinary words exactly."""
    data = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    lengths = np.array([len(word) for word in words])
    rows = np.repeat(np.arange(len(words)), lengths)
    flat = np.bincount(rows * LETTERS + data % LETTERS, minlength=len(words) * LETTERS)
    wide = lengths.max(initial=0) >= 1 << 11
    return flat.reshape(-1, LETTERS).astype(np.float64 if wide else np.float32)


def one_edit(a: str, b: str) -> bool:
    """One letter inserted, deleted or replaced; ``b`` is as long as ``a`` or longer by one."""
    at = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if len(a) == len(b):
        return at < len(a) and a[at + 1 :] == b[at + 1 :]
    return a[at:] == b[at + 1 :]


@dataclass
class Block:
    """Words of some groups that are compared together; every array has an item a word."""

    words: list[str]
    counts: list[int]
    group: np.ndarray
    size: np.ndarray
    first_half: np.ndarray
    row: np.ndarray
    col: np.ndarray
    mine: np.ndarray

    def near(self) -> Iterator[tuple[int, int]]:
        """Pairs of places of words of one group that are one edit apart and are the block's to tell."""
        lengths = np.array([len(word) for word in self.words])
        letters = letter_counts(self.words)
        for longer in (0, 1):
            left, right = (np.flatnonzero(lengths == self.size + more) for more in (0, longer))
            for i, j in close_pairs(letters[left], letters[right], self.group[left], self.group[right]):
                i, j = left[i], right[j]
                one_tile = self.row[i] == self.col[i]
                if longer:
                    told = one_tile | (self.mine[i] != self.mine[j])
                else:
                    told = np.where(one_tile, i < j, self.mine[i] < self.mine[j])
                for x, y in zip(i[told].tolist(), j[told].tolist()):
                    a, b, half = self.words[x], self.words[y], int(self.size[x]) // 2
                    # A pair that agrees in both halves is told under the first.
                    if (self.first_half[x] or a[:half] != b[:half]) and one_edit(a, b):
                        yield x, y


def close_pairs(left: np.ndarray, right: np.ndarray, left_group: np.ndarray, right_group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows of one group at a squared distance of two at most, block by block."""
    own, other = (left * left).sum(axis=1), (right * right).sum(axis=1)
    for i in range(0, len(left), BLOCK_WORDS):
        rows = slice(i, i + BLOCK_WORDS)
        for j in range(0, len(right), BLOCK_WORDS):
            cols = slice(j, j + BLOCK_WORDS)
            far = own[rows, None] + other[None, cols] - 2 * (left[rows] @ right[cols].T)
            a, b = np.nonzero((far <= 2) & (left_group[rows, None] == right_group[None, cols]))
            yield a + i, b + j


def _blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    """Groups of a batch: small ones together, so that a product is worth its call, others alone."""
    members = batch.column("members")
    offsets = members.offsets.to_numpy()
    offsets = offsets - offsets[0]
    flat = members.flatten()
    for first, last in arrow_text.pieces(offsets, PACKED_WORDS):
        part = flat.slice(offsets[first], offsets[last] - offsets[first])
        group = np.repeat(np.arange(first, last), np.diff(offsets[first : last + 1]))

        def of(name):
            return batch.column(name).to_numpy(zero_copy_only=False)[group]

        yield Block(
            part.field("word").to_pylist(), part.field("n").to_pylist(), group, of("size"), of("side") == "first",
            of("row"), of("col"), part.field("mine").to_numpy(),
        )


def near_pairs(words: DataFrame, folder: str, shortest: int = 1, tile_words: int = TILE_WORDS) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words one edit apart, once.

    ``words`` has rows (word, n), each word once, none empty or shorter than ``shortest``.
    """
    tiles = _dealt(halves(words, shortest), folder, tile_words)
    tile = tiles.groupBy("side", "size", "half", "row", "col")
    # Words alone in their group, the most, need no worker.
    groups = tile.agg(F.collect_list(F.struct("word", "n", "mine")).alias("members")).where(F.size("members") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch):
                found = list(block.near())
                both = found + [(j, i) for i, j in found]
                columns = [[of[pair[k]] for pair in both] for k in (0, 1) for of in (block.words, block.counts)]
                arrays = [pa.array(values, kind) for values, kind in zip(columns, (pa.string(), pa.int64()) * 2)]
                yield pa.RecordBatch.from_arrays(arrays, names=["word", "n", "near", "near_n"])

    return groups.mapInArrow(run, "word string, n long, near string, near_n long")


def forms(words: DataFrame, folder: str, shortest: int = 1, ratio: int = FORM_RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n): near words, and the most frequent of them if it is ``ratio`` times as frequent.

    Of equally frequent ones it is the first in the order of code points.
    """
    pairs = near_pairs(words, folder, shortest)
    alone = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.when(F.col("near").isNotNull(), F.struct(-F.col("near_n"), F.col("near")))
    rows = pairs.unionByName(alone).groupBy("word").agg(
        F.max("n").alias("n"), F.count("near").alias("n_near"), F.min(best).alias("best")
    )
    most = -F.col("best.col1")
    fits = most >= ratio * F.col("n")
    return rows.select("word", "n", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, most).alias("form_n"))


def roots(links: DataFrame, folder: str) -> DataFrame:
    """(word, root) of rows (word, form): the last of the forms that follow one another.

    The occurrences at least double from form to form, so there are no circles and chains
    are short; each round doubles how far a link reaches. A word many others have for
    their form is joined as a hot key.
    """
    reach = scratch.stage(links.select("word", F.col("form").alias("root")), folder, "roots_0")
    step = 0
    while True:
        step += 1
        ahead = reach.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        named = scratch.stage(reach.groupBy("root").agg(F.count("*").alias("n")), folder, f"root_sizes_{step}")
        joined = spread.lookup(reach, ahead, "root", spread.hot_keys(named, "root", "n"), "left")
        reach = scratch.stage(joined.select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), folder, f"roots_{step}")
        if not reach.where("moved").head(1):
            return reach.drop("moved")
        reach = reach.drop("moved")


def spellings(docs: DataFrame, folder: str) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``MIN_COUNT`` occurrences or more.

    Texts without words, null texts and empty tables give no word.
    """
    words = scratch.stage(word_counts(docs).where(F.col("n") >= MIN_COUNT), folder, "words")
    found = scratch.stage(forms(words, folder, MIN_LETTERS), folder, "forms")
    ends = roots(found.where("form is not null"), folder)
    rows = found.join(ends, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir) -> DataFrame:
    """Every word of ``documents``, its form and root, its occurrences and near words; null texts have no words."""
    folder = W.workspace(spark)
    return spellings(W.table(spark, sf_dir, "documents").select("doc_id", "text"), folder)
