"""Lines that many documents share leave all of them.

Lines are compared by the 128-bit hash of their key: blanks stripped at both ends, A-Z
lower-cased. Tasks count the documents of each hash and fold their counts before the
shuffle. The hashes found often enough are dealt to shards; each shard is a minimal
perfect hash with arrays of fingerprints and counts. Documents do not meet the lines in
a join: every task looks its lines up in the arrays.

The shards go to all tasks while their bytes, which are added up first, allow it. Beyond
that only those of the most frequent lines do, at most a few a shuffle partition; the
hashes of the other lines travel to the shards, which answer with the texts that hold a
frequent line.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrefwarden import scratch
from hrefwarden.llm import arrow_text
from hrefwarden.llm import words as W
from hrefwarden.llm.perfect_hash import PACKED, PerfectHash
from hrefwarden.operators import spread

#: Documents from which on a line is dropped.
MIN_DOCUMENTS = 10
#: Keys of a shard, about, and bytes of all shards that every task may hold.
SHARD_KEYS, MAX_BYTES = 1 << 17, 64 << 20
#: Distinct lines a task counts before it passes them on.
HELD = 1 << 18

BLANK_BYTES = b" \t\n\x0b\x0c\r"
_LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def digests_of(text: bytes) -> list[bytes | None]:
    """The hash of every line's key, in order; None for a line of blanks alone."""
    keys = [line.strip(BLANK_BYTES) for line in text.translate(_LOWERED).split(b"\n")]
    return [hashlib.blake2b(key, digest_size=16).digest() if key else None for key in keys]


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for part in arrow_text.batch_pieces(batch, column):
        yield part, part.column(column).cast(pa.large_binary()).to_pylist()


def _numbers(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=np.uint64).reshape(-1, 2)


def line_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h1, h2, n): the hash of each distinct line that is not blank, and how many rows hold it.

    Rows that repeat a document count each; a line counts once a row. No row for an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def given():
            keys = _numbers(list(held)).view(np.int64)
            counts = pa.array(held.values(), pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), counts], names=["h1", "h2", "n"])

        for batch in batches:
            for _, texts in _texts(batch, text):
                for value in texts:
                    for key in set(digests_of(value or b"")):
                        if key is not None:
                            held[key] = held.get(key, 0) + 1
                    if len(held) >= HELD:
                        yield given()
        if held:
            yield given()

    found = docs.select(F.col(text).cast("string").alias(text)).mapInArrow(run, "h1 long, h2 long, n long")
    return found.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def _built(table: pa.Table) -> pa.Table:
    keys = np.stack([table.column(name).to_numpy().view(np.uint64) for name in ("h1", "h2")], axis=1)
    made = PerfectHash.build(keys, table.column("n").to_numpy()).packed()
    row = {"shard": table.column("shard")[0].as_py(), **made}
    kinds = {"shard": pa.int64(), "sizes": pa.list_(pa.int64()), "width": pa.int32()}
    return pa.table({name: pa.array([value], kinds.get(name, pa.binary())) for name, value in row.items()})


def index(lines: DataFrame, shards: int) -> DataFrame:
    """(shard, bits, fingerprints, counts, ...), one perfect hash a row, of rows (h1, h2, n).

    Hashes spread the keys, so a shard has about as many as any other.
    """
    dealt = lines.select(F.pmod("h1", F.lit(shards)).alias("shard"), "h1", "h2", "n")
    return dealt.groupBy("shard").applyInArrow(_built, f"shard long, {PACKED}")


class Shards:
    """Shards of an index in one process."""

    def __init__(self, rows: list[dict], shards: int):
        self.shards = shards
        self.by_number = {row["shard"]: PerfectHash.unpacked(row) for row in rows}

    def counts_of(self, keys: np.ndarray) -> np.ndarray:
        numbers = np.mod(keys[:, 0].view(np.int64), self.shards)
        out = np.zeros(len(keys), dtype=np.uint64)
        for number in np.unique(numbers):
            if number in self.by_number:
                mine = numbers == number
                out[mine] = self.by_number[number].counts_of(keys[mine])
        return out


class _Shared:
    """Shards sent to all tasks, unpacked once a process."""

    _here: dict[str, Shards] = {}

    def __init__(self, table: DataFrame, shards: int):
        rows = [row.asDict() for row in table.collect()]
        self.name = uuid.uuid4().hex
        self.value = table.sparkSession.sparkContext.broadcast((rows, shards))

    def shards(self) -> Shards:
        if self.name not in self._here:
            self._here.clear()
            self._here[self.name] = Shards(*self.value.value)
        return self._here[self.name]


def _bytes_of(table: DataFrame) -> int:
    size = sum((F.octet_length(name) for name in ("bits", "rest", "fingerprints", "counts")), F.lit(0))
    return table.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def _probes(docs: DataFrame, text: str, shared: _Shared) -> DataFrame:
    """(_text_id, h1, h2) of the lines of each distinct text a task meets that the shared shards do not hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = shared.shards()
        for batch in batches:
            for part, texts in _texts(batch, text):
                own = [list({d for d in digests_of(value or b"") if d is not None}) for value in texts]
                keys = _numbers([d for digests in own for d in digests])
                rows = np.repeat(np.arange(len(own)), [len(digests) for digests in own])
                unknown = shards.counts_of(keys) == 0
                found, keys = rows[unknown], keys[unknown].view(np.int64)
                ids = part.column("_text_id").take(pa.array(found))
                yield pa.RecordBatch.from_arrays([ids, pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=["_text_id", "h1", "h2"])

    chosen = docs.select("_text_id", F.col(text).cast("string").alias(text)).dropDuplicates(["_text_id"])
    return chosen.mapInArrow(run, "_text_id binary, h1 long, h2 long")


def _routed(probes: DataFrame, table: DataFrame, shards: int, least: int) -> DataFrame:
    """(_text_id, gone): hashes of the lines to drop, as the shards they travel to tell."""
    sent = probes.withColumn("shard", F.pmod("h1", F.lit(shards)))
    both = table.unionByName(sent, allowMissingColumns=True).repartition("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, mine = None, None
        for batch in batches:
            numbers, is_shard = batch.column("shard").to_numpy(), batch.column("_text_id").is_null().to_numpy(False)
            edges = np.flatnonzero(is_shard | np.concatenate(([True], numbers[1:] != numbers[:-1])))
            for first, last in zip(edges, [*edges[1:], len(numbers)]):
                if is_shard[first]:
                    number, mine = numbers[first], PerfectHash.unpacked(batch.slice(first, 1).to_pylist()[0])
                    first += 1
                if number != numbers[min(first, last - 1)] or first == last:
                    continue
                part = batch.slice(first, last - first)
                keys = np.stack([part.column(name).to_numpy().view(np.uint64) for name in ("h1", "h2")], axis=1)
                hit = np.flatnonzero(mine.counts_of(keys) >= least)
                gone = pa.array([keys[k].tobytes() for k in hit], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("_text_id").take(pa.array(hit)), gone], names=["_text_id", "gone"])

    ordered = both.sortWithinPartitions("shard", F.col("_text_id").asc_nulls_first())
    hits = ordered.mapInArrow(run, "_text_id binary, gone binary")
    return hits.groupBy("_text_id").agg(F.collect_list("gone").alias("gone"))


def _without(rows: DataFrame, text: str, shared: _Shared, least: int, given: bool) -> DataFrame:
    kept = [f for f in rows.schema.fields if f.name != "gone"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_lines long", "n_dropped long"])
    columns = [f"`{f.name}`" for f in kept] + (["gone"] if given else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = shared.shards()
        for batch in batches:
            for part, texts in _texts(batch, text):
                digests = [digests_of(value or b"") for value in texts]
                flat = [d for own in digests for d in own]
                named = np.array([d is not None for d in flat], dtype=bool)
                drop = np.zeros(len(flat), dtype=bool)
                drop[named] = shards.counts_of(_numbers([d for d in flat if d is not None])) >= least
                hits = part.column("gone").to_pylist() if given else [None] * len(texts)
                made, at = [], 0
                dropped = np.zeros(len(texts), dtype=np.int64)
                for row, (value, own, gone) in enumerate(zip(texts, digests, hits)):
                    out = drop[at : at + len(own)]
                    if gone:
                        gone = set(gone)
                        out = out | np.array([d in gone for d in own])
                    at += len(own)
                    dropped[row] = out.sum()
                    if dropped[row]:
                        value = b"\n".join([line for line, no in zip(value.split(b"\n"), out) if not no])
                    made.append(value)
                kind = part.column(text).type
                new = pa.array(made, pa.large_binary()).cast(pa.large_string()).cast(kind)
                arrays = [new if f.name == text else part.column(f.name) for f in kept]
                lines = pa.array([len(own) for own in digests], pa.int64())
                yield pa.RecordBatch.from_arrays([*arrays, lines, pa.array(dropped)], names=[*(f.name for f in kept), "n_lines", "n_dropped"])

    return rows.select(*columns).mapInArrow(run, schema)


def without_common_lines(
    docs: DataFrame, folder: str, text: str = "text", least: int = MIN_DOCUMENTS, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """``docs`` with the lines gone that ``least`` rows or more hold, and ``n_lines``, ``n_dropped``.

    A null text has one empty line and stays null; blank lines are never dropped; rows that
    repeat a document count each and are all returned. A text of dropped lines alone becomes
    empty. An empty table gives no row. Other columns stay, but for those named ``n_lines``,
    ``n_dropped`` and ``gone``.
    """
    docs = docs.drop("n_lines", "n_dropped", "gone").withColumn(text, F.col(text).cast("string"))
    lines = scratch.stage(line_counts(docs, text).where(F.col("n") >= least), folder, "frequent_lines")
    keys, total = lines.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(1, -(-keys // SHARD_KEYS))
    table = scratch.stage(index(lines, shards), folder, "line_index")
    if _bytes_of(table) <= max_bytes:
        return _without(docs, text, _Shared(table, shards), least, False)
    spark = docs.sparkSession
    floor = spread.hot_floor(total, int(spark.conf.get("spark.sql.shuffle.partitions")), least)
    shared = _Shared(scratch.stage(index(lines.where(F.col("n") >= floor), 1), folder, "hot_line_index"), 1)
    known = docs.withColumn("_text_id", F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)))
    hits = scratch.stage(_routed(_probes(known, text, shared), table, shards, least), folder, "line_hits")
    copies = scratch.stage(known.groupBy("_text_id").agg(F.count("*").alias("n")), folder, "line_texts")
    hot = spread.hot_keys(copies, "_text_id", "n")
    return _without(spread.lookup(known, hits, "_text_id", hot, "left").drop("_text_id"), text, shared, least, True)


def op13_line_dedup(spark, sf_dir) -> DataFrame:
    """Lines before and dropped, and the digest of what stays, for every document; a null text is one empty line."""
    folder = W.workspace(spark)
    docs = W.table(spark, sf_dir, "documents").select("doc_id", W.whole(F.col("text")).alias("text"))
    return without_common_lines(docs, folder).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), split AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS nth FROM docs
), keyed AS (
  SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split
), common AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= {MIN_DOCUMENTS}
), judged AS (
  SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r
"""
