"""BPE encoding and decoding with forced boundaries.

Two neighbouring symbols that occur side by side inside no token of the vocabulary
can never be merged across: every merge makes a token. A piece of text is cut at
all such places, the fragments are merged independently, and their ids are put
one after the other. Fragments recur far more often than pieces, and short ones
are merged once per worker.

The vocabulary is that of a file of the ``tokenizers`` library, which is sent to
the workers as it is; normalising and splitting follow the file: white space
separates, letters are lowered, the last symbol of a piece carries the word end.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hrefwarden.llm import arrow_text
from hrefwarden.llm import words as W

#: Pieces whose ids a worker remembers, and the longest that is remembered.
REMEMBERED, REMEMBERED_CHARS = 500_000, 40
#: Shorter fragments are merged by scanning, longer ones with a heap.
SCANNED = 24

# --- fixed values: the splitting pattern of the vocabulary file, for texts of Latin letters
_LETTERS = "a-zªµºß-öø-ÿĀ-ſ"
_DIGITS = "0-9²³¹¼½¾"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^ \\t\\n\\x0b\\x0c\\r\\xa0{_LETTERS}{_DIGITS}]+")
#: What the pattern above is right for: the rest goes the way of the library's own components.
_BEYOND = re.compile("[^\\t\\n\\x0b\\x0c\\r\\x20-\\x7e\\xa0-\\u012f\\u0131-\\u0148\\u014a-\\u017e]")


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is one, else from U+0100 on in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256))
    return [chr(b) if b in own else chr(0x100 + next(others)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and the cuts that follow from them."""

    def __init__(self, source: str):
        file = json.loads(source)
        model = file["model"]
        self.suffix = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: token for token, i in self.ids.items()}
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens |= {i: content for content, i in added.items()}
        self.added = added
        self.added_pattern = re.compile("(" + "|".join(re.escape(t) for t in added) + ")") if added else None
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: k for k, pair in enumerate(pairs)}
        self.joined = self._pairs_inside(self.ids, self.suffix)
        self.symbols = _byte_symbols()
        self.pieces: dict[str, list[int]] = {}
        self.components = None
        self.source = source

    @staticmethod
    def _pairs_inside(tokens, suffix: str) -> set[str]:
        """Pairs of neighbouring symbols that some token holds."""
        bare = (t.removesuffix(suffix) for t in tokens)
        return {t[i : i + 2] for t in bare for i in range(len(t) - 1)}

    def fragments(self, piece: str) -> list[str]:
        """The piece, in symbols, cut wherever no token reaches across."""
        joined = self.joined
        cuts = [i for i, pair in enumerate(map(str.__add__, piece, piece[1:]), 1) if pair not in joined]
        if not cuts:
            return [piece]
        return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)], strict=True)]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece in byte symbols."""
        parts = self.fragments(piece)
        ids: list[int] = []
        for k, part in enumerate(parts):
            units = list(part)
            if k == len(parts) - 1:
                units[-1] += self.suffix
            ids += [self.ids[u] for u in self._merged(units)]
        return ids

    def _merged(self, units: list[str]) -> list[str]:
        return self._by_scanning(units) if len(units) <= SCANNED else self._by_heap(units)

    def _by_scanning(self, units: list[str]) -> list[str]:
        """The leftmost pair of the lowest rank again and again; only its neighbours' ranks change."""
        get, none = self.ranks.get, len(self.ranks)
        ranks = [get(pair, none) for pair in zip(units, units[1:])]
        while ranks and (best := min(ranks)) != none:
            at = ranks.index(best)
            units[at : at + 2] = [units[at] + units[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get((units[at - 1], units[at]), none)
            if at < len(ranks):
                ranks[at] = get((units[at], units[at + 1]), none)
        return units

    def _by_heap(self, units: list[str]) -> list[str]:
        """The same merges, lowest rank and then leftmost first, in n log n."""
        ranks, n = self.ranks, len(units)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank, i, units[i], units[i + 1]) for i in range(n - 1) if (rank := ranks.get((units[i], units[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if units[i] else n
            if units[i] != left or j >= n or units[j] != right:
                continue
            units[i], units[j] = left + right, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (rank := ranks.get((units[a], units[b]))) is not None:
                    heapq.heappush(heap, (rank, a, units[a], units[b]))
        return [u for u in units if u]

    def _ids_of(self, piece: str, key: str) -> list[int]:
        ids = self.encode_piece(piece)
        if len(key) <= REMEMBERED_CHARS:
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            self.pieces[key] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; the added tokens' own strings stand for themselves."""
        out: list[int] = []
        parts = self.added_pattern.split(text) if self.added_pattern and "<|" in text else (text,)
        for part in parts:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                self._encode_plain(part, out)
        return out

    def _encode_plain(self, text: str, out: list[int]) -> None:
        if _BEYOND.search(text):
            known = self.pieces
            for piece in self._library_pieces(text):
                key = "\n" + piece
                out += known.get(key) or self._ids_of(piece, key)
            return
        known, symbols = self.pieces, self.symbols
        for word in _PIECE.findall(text.lower()):
            out += known.get(word) or self._ids_of("".join([symbols[b] for b in word.encode()]), word)

    def _library_pieces(self, text: str) -> list[str]:
        """Pieces in byte symbols as the library's normaliser and splitter give them, for letters beyond Latin."""
        if self.components is None:
            from tokenizers import Tokenizer

            loaded = Tokenizer.from_str(self.source)
            self.components = loaded.normalizer, loaded.pre_tokenizer
        normalizer, splitter = self.components
        return [piece for piece, _ in splitter.pre_tokenize_str(normalizer.normalize_str(text)) if piece]

    def decode(self, ids: list[int]) -> str:
        """As the library does where the file names no decoder: the tokens, one blank between them."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])


@functools.lru_cache(maxsize=2)
def _vocabulary(source: str) -> Vocabulary:
    return Vocabulary(source)


def _source(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def _mapped(rows: DataFrame, path: str, column: str, into: str, kind: T.DataType, of) -> DataFrame:
    """``rows`` with one more column; ``of(vocabulary, value)`` makes it, null for null."""
    source = rows.sparkSession.sparkContext.broadcast(_source(path))
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != into), T.StructField(into, kind, True)])
    arrow_kind = pa.list_(pa.int32()) if isinstance(kind, T.ArrayType) else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(source.value)
        for batch in batches:
            for part in _parts(batch, column):
                made = [None if v is None else of(vocabulary, v) for v in part.column(column).to_pylist()]
                columns = [part.column(f.name) for f in schema.fields[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(made, arrow_kind)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    values = batch.column(column)
    if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
        yield from arrow_text.batch_pieces(batch, column)
    else:
        lengths = values.offsets.to_numpy()
        for first, last in arrow_text.pieces(lengths - lengths[0], arrow_text.PIECE_BYTES // 4):
            yield batch.slice(first, last - first)


def encoded(rows: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``rows`` with the ids of their texts, array<int>: null for null, empty for a text without pieces.

    ``path`` is the vocabulary file's on the driver. Every other column stays; one
    named like ``into`` is replaced.
    """
    return _mapped(rows, path, text, into, T.ArrayType(T.IntegerType()), Vocabulary.encode)


def decoded(rows: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text their ids decode to; ids the vocabulary lacks are left out, as the library does."""
    return _mapped(rows, path, ids, into, T.StringType(), Vocabulary.decode)


def op6_bpe(spark, sf_dir) -> DataFrame:
    """Token counts and digests of every document's ids and of the text they decode to; a null text is empty."""
    import public_tokenizers

    W.workspace(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = W.table(spark, sf_dir, "documents").select("doc_id", W.whole(F.col("text")).alias("text"))
    rows = decoded(encoded(docs, path).drop("text"), path)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
