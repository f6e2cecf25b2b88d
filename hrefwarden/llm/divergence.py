"""How far the sources of a language differ in the terms they use.

The share of a term in a source follows from its count there alone, so terms of one
count are one bitmap: (source, count, bits). The terms in which one source has count a
and another count b are the bits of both; their number is a popcount, and it is
multiplied by the difference of the two shares. Terms a source lacks are the complement
of its bitmaps. Terms are numbered by frequency, so that few counts meet in a block of 64.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hrefwarden import scratch
from hrefwarden.llm import arrow_text
from hrefwarden.llm import words as W
from hrefwarden.operators import spread

#: Documents of its language a term is kept from, and the terms told of each source.
MIN_DOCUMENTS, TOP_TERMS = 30, 50
#: Shares are whole numbers of this; every term counts as if found so often more.
SCALE, SMOOTHING = 1_000_000_000, 5
#: Terms a task counts before it passes them on.
HELD = 1 << 18
#: Sources of a language that one task compares with all others of it.
SOURCES_A_TASK = 256

# Letters of ASCII and all bytes beyond it make terms; A-Z are lower-cased, the rest are blanks.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, df): occurrences of a term in a source, and the rows there that hold it.

    Missing values count as empty ones. Rows whose term is null show the pairs of language
    and source some task saw without any term. Repeated rows count each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def given():
            for (of_lang, of_source), (counts, rows) in held.items():
                names = [term.decode() for term in counts] or [None]
                same = [pa.array([value] * len(names), pa.string()) for value in (of_lang, of_source)]
                numbers = [pa.array([*of.values()] or [0], pa.int64()) for of in (counts, rows)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(names, pa.string()), *numbers], names=["lang", "source", "term", "n", "df"])
            held.clear()

        for batch in batches:
            for part in arrow_text.batch_pieces(batch, "text"):
                texts = part.column("text").cast(pa.large_binary()).to_pylist()
                for of_lang, of_source, value in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), texts):
                    counts, rows = held.setdefault((of_lang, of_source), (Counter(), Counter()))
                    own = Counter(value.translate(_TERMS).split())
                    counts.update(own)
                    rows.update(own.keys())
                # Both counters of a source have the same terms in the same order.
                if sum(len(counts) for counts, _ in held.values()) >= HELD:
                    yield from given()
        yield from given()

    columns = [W.whole(F.col(of)).alias(name) for of, name in ((text, "text"), (lang, "lang"), (source, "source"))]
    found = docs.select(*columns).mapInArrow(run, "lang string, source string, term string, n long, df long")
    return found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def kept_terms(counts: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, term, id, total, found): terms of ``least`` rows of their language or more, ``found`` an array of (source, n).

    Ids are numbers within a task, the frequent terms of a language first; 64 that follow
    one another make a block.
    """
    terms = counts.where("term is not null").groupBy("lang", "term").agg(
        F.sum("n").alias("total"), F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("found")
    )
    ordered = terms.where(F.col("df") >= least).drop("df").sortWithinPartitions("lang", F.desc("total"), "term")
    return ordered.withColumn("id", F.monotonically_increasing_id())


def group_totals(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, n_source, n_lang, n_terms) of every pair of language and source, those without kept terms too."""
    own = terms.select("lang", F.explode("found").alias("f")).groupBy("lang", F.col("f.source").alias("source"))
    nothing = counts.select("lang", "source", F.lit(0).cast("long").alias("n")).distinct()
    sums = own.agg(F.sum("f.n").alias("n")).unionByName(nothing).groupBy("lang", "source").agg(F.sum("n").alias("n_source"))
    of_lang = terms.groupBy("lang").agg(F.sum("total").alias("n_lang"), F.count("*").alias("n_terms"))
    zero = F.lit(0).cast("long")
    joined = sums.join(of_lang, "lang", "left")
    return joined.select("lang", "source", "n_source", F.coalesce("n_lang", zero).alias("n_lang"), F.coalesce("n_terms", zero).alias("n_terms"))


def share(n: str, total: str, terms: str) -> Column:
    """The smoothed share of a term, a whole number of ``SCALE``; exact, in decimals."""
    above = f"cast({SCALE} as decimal(10,0)) * cast({n} + {SMOOTHING} as decimal(20,0))"
    return F.expr(f"1 + ({above}) div (cast({total} as decimal(20,0)) + {SMOOTHING} * cast({terms} as decimal(18,0)))").cast("long")


def shares(n: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """As ``share``, for arrays; ``n`` and ``totals`` are objects where 64 bits do not hold the products."""
    return (1 + SCALE * (n + SMOOTHING) // (totals + SMOOTHING * terms)).astype(np.int64)


def bitmaps(terms: DataFrame) -> DataFrame:
    """(lang, block, source, n, bits): which of a block's 64 terms a source has with this count, none of count 0."""
    rows = terms.select("lang", "id", F.explode("found").alias("f"))
    bit = F.expr("shiftleft(1L, cast(id % 64 as int))")
    levels = rows.select("lang", F.expr("id div 64").alias("block"), "f.source", "f.n", bit.alias("bit"))
    return levels.groupBy("lang", "block", "source", "n").agg(F.bit_or("bit").alias("bits"))


def _wide(values: np.ndarray) -> np.ndarray:
    return values.astype(object) if values.max(initial=0) >= (1 << 62) // SCALE else values


def block_differences(first: np.ndarray, totals: np.ndarray, terms: int, at: np.ndarray, n: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Sums of differences of shares over a block's terms: one row for each source of ``first``, one column for each source.

    ``at``, ``n`` and ``bits`` are the block's bitmaps, ``at`` their sources' numbers; ``totals`` has every source.
    """
    everything = np.bitwise_or.reduce(bits) if len(bits) else np.uint64(0)
    held = np.zeros(len(totals), dtype=np.uint64)
    np.bitwise_or.at(held, at, bits)
    # The terms a source lacks are one more bitmap of it, with count 0.
    at = np.concatenate((at, np.arange(len(totals))))
    bits = np.concatenate((bits, everything & ~held))
    n = np.concatenate((n, np.zeros(len(totals), dtype=n.dtype)))
    order = np.argsort(at, kind="stable")
    at, bits, p = at[order], bits[order], shares(_wide(n), _wide(totals[at]), max(terms, 1))[order]
    starts = np.searchsorted(at, np.arange(len(totals) + 1))
    out = np.zeros((len(first), len(totals)), dtype=np.int64)
    for row, source in enumerate(first):
        mine = slice(starts[source], starts[source + 1])
        cells = np.bitwise_count(bits[mine, None] & bits[None, :]).astype(np.int64)
        sums = (cells * np.abs(p[mine, None] - p[None, :])).sum(axis=0)
        out[row] = np.add.reduceat(sums, starts[:-1])
    return out


def pair_differences(terms: DataFrame, groups: DataFrame, folder: str) -> DataFrame:
    """(lang, source, item, value): the sum of differences of shares of each two sources of a language, both ways round.

    A block of bitmaps meets the list of its language's sources, in parts of ``SOURCES_A_TASK``
    that are compared with the whole list. The result has a row for each two sources, so
    a language's list is taken to fit a row. Languages without kept terms have values 0.
    """
    levels = bitmaps(terms).groupBy("lang", "block").agg(F.collect_list(F.struct("source", "n", "bits")).alias("levels"))
    blank = groups.where("n_terms = 0").select("lang", F.lit(0).cast("long").alias("block")).distinct()
    blank = blank.withColumn("levels", F.array().cast("array<struct<source:string,n:bigint,bits:bigint>>"))
    blocks = scratch.stage(levels.unionByName(blank), folder, "blocks")
    listed = groups.groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("source", "n_source"))).alias("sources"), F.max("n_terms").alias("n_terms")
    )
    listed = scratch.stage(listed, folder, "sources")
    sizes = scratch.stage(blocks.groupBy("lang").agg(F.count("*").alias("n")), folder, "block_counts")
    parts = F.expr(f"sequence(0, (size(sources) - 1) div {SOURCES_A_TASK})")
    joined = spread.lookup(blocks, listed, "lang", spread.hot_keys(sizes, "lang", "n"))
    dealt = joined.select("lang", "n_terms", "sources", "levels", F.explode(parts).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int], tuple[list[str], np.ndarray, np.ndarray]] = {}
            for k in range(batch.num_rows):
                lang, part, terms_of = (batch.column(name)[k].as_py() for name in ("lang", "part", "n_terms"))
                levels, listed = batch.column("levels")[k].values, batch.column("sources")[k].values
                names = listed.field("source").to_pylist()
                numbers = {name: i for i, name in enumerate(names)}
                first = np.arange(part * SOURCES_A_TASK, min(len(names), (part + 1) * SOURCES_A_TASK))
                value = block_differences(
                    first,
                    listed.field("n_source").to_numpy(),
                    terms_of,
                    np.array([numbers[name] for name in levels.field("source").to_pylist()], dtype=np.int64),
                    levels.field("n").to_numpy(),
                    levels.field("bits").to_numpy().view(np.uint64),
                )
                _, _, before = sums.get((lang, part), (names, first, 0))
                sums[lang, part] = names, first, before + value
            for (lang, _), (names, first, values) in sums.items():
                for source, row in zip(first, values):
                    others = np.flatnonzero(np.arange(len(names)) != source)
                    same = [pa.array([value] * len(others), pa.string()) for value in (lang, names[source])]
                    items = pa.array([names[i] for i in others], pa.string())
                    yield pa.RecordBatch.from_arrays([*same, items, pa.array(row[others])], names=["lang", "source", "item", "value"])

    found = dealt.mapInArrow(run, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_differences(terms: DataFrame, groups: DataFrame, folder: str) -> DataFrame:
    """(lang, source, item, value): terms found in a source with a larger share than in its language."""
    rows = terms.select("lang", F.col("term").alias("item"), "total", F.explode("found").alias("f"))
    rows = rows.select("lang", "item", "total", "f.source", "f.n")
    sizes = terms.select("lang", F.explode("found.source").alias("source")).groupBy("lang", "source").agg(F.count("*").alias("n"))
    hot = spread.hot_keys(scratch.stage(sizes, folder, "group_sizes"), ("lang", "source"), "n")
    joined = spread.lookup(rows, groups, ("lang", "source"), hot).where("n > 0")
    value = share("n", "n_source", "n_terms") - share("total", "n_lang", "n_terms")
    return joined.select("lang", "source", "item", value.alias("value")).where("value > 0")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def divergence(docs: DataFrame, folder: str, least: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources by distance, and the terms a source has more of than its language.

    Missing texts, languages and sources count as empty ones. A language of one source has
    no pairs, an empty table no rows.
    """
    counts = scratch.stage(term_counts(docs), folder, "term_counts")
    terms = scratch.stage(kept_terms(counts, least), folder, "terms")
    groups = scratch.stage(group_totals(counts, terms), folder, "groups")
    pairs = _ranked(pair_differences(terms, groups, folder), "pair")
    return pairs.unionByName(_ranked(term_differences(terms, groups, folder), "term").where(F.col("rank") <= top))


def op11_source_divergence(spark, sf_dir) -> DataFrame:
    """Pairs of sources and leading terms of every source of ``documents``; ties by name, missing values as empty ones."""
    docs = W.table(spark, sf_dir, "documents").select("text", "lang", "source")
    return divergence(docs, W.workspace(spark))


_SHARE = "1 + (1000000000::HUGEINT * ({} + 5)) // ({} + 5 * v)"

SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), found AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS total FROM found GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCUMENTS}
), langs AS (
  SELECT d.lang, coalesce(any_value(k.v), 0) AS v, coalesce(any_value(k.n), 0) AS n
  FROM docs d LEFT JOIN (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang) k ON d.lang = k.lang GROUP BY d.lang
), own AS (
  SELECT f.lang, f.source, f.term, count(*) AS n FROM found f JOIN kept k ON f.lang = k.lang AND f.term = k.term GROUP BY ALL
), sums AS (
  SELECT g.lang, g.source, coalesce(sum(o.n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN own o ON g.lang = o.lang AND g.source = o.source GROUP BY ALL
), cells AS (
  SELECT s.lang, s.source, k.term, coalesce(o.n, 0) AS n, {_SHARE.format("coalesce(o.n, 0)", "s.total")} AS p, {_SHARE.format("k.total", "l.n")} AS q
  FROM sums s JOIN langs l ON s.lang = l.lang JOIN kept k ON s.lang = k.lang
  LEFT JOIN own o ON o.lang = s.lang AND o.source = s.source AND o.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM sums a JOIN sums b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM cells WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, part, item, value::BIGINT AS value,
         row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
