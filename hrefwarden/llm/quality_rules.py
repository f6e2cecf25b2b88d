"""Quality rules as a short-circuit cascade.

Each rule is a reject condition over the text. What a rule costs (seconds a row)
and what it rejects is estimated on a sample; the rules are then ordered by
rejection per cost, among the rows the earlier ones let pass, and evaluated as
one CASE chain, so that a row a cheap rule rejects never reaches a dear one. The
order changes the cost only: a document stays if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefwarden.llm import words as W

# --- fixed values: the base rules' limits
MIN_WORDS = 50
REPEAT_WINDOW = 3
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"

# Limits of the cascade's own rules.
MAX_SYMBOL_WORDS_PERCENT = 25
MAX_UPPER_PERCENT = 40
MAX_ADJACENT_PERCENT = 30
MAX_DUP_LINES_PERCENT = 50
MAX_MEAN_WORD = 24

#: Rows the cost of a rule is measured on, about; only the order of the rules depends on them.
SAMPLE_ROWS = 2_000


def _percent(part: Column, whole: Column, most: int) -> Column:
    return part.cast("long") * 100 > whole.cast("long") * most


def symbol_words(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: w.rlike("[#*$%&|<>]")))


def n_symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))


def _kept_chars(text: Column, dropped: str) -> Column:
    return F.length(F.regexp_replace(text, dropped, ""))


def upper_percent_over(text: Column, most: int) -> Column:
    return _percent(_kept_chars(text, "[^A-Z]+"), _kept_chars(text, "[^A-Za-z]+"), most)


def lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{W.BLANKS}]"))


def n_dup_lines(found: Column) -> Column:
    return F.size(found) - F.size(F.array_distinct(found))


def adjacent_words(text: Column) -> Column:
    """Words that are followed by themselves, counted without an array of the words."""
    once = f"(?<![^{W.BLANKS}])([^{W.BLANKS}]++)(?=[{W.BLANKS}]++\\1(?![^{W.BLANKS}]))"
    return F.regexp_count(text, F.lit(once))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{W.BLANKS}]+"))


def repeat_words(hashes: Column) -> Column:
    """Words covered by a window whose hash occurs twice or more in the array of a text's window hashes.

    The windows are sorted with their places, so that equal ones are neighbours; the
    places of those are sorted again and each adds what the next does not cover.
    """
    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    held = F.transform(F.array(F.sort_array(placed)), _repeated_places)[0]
    covered = F.transform(F.array(held), lambda at: _covered(at))[0]
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(F.lit(0)).cast("long")


def _repeated_places(ordered: Column) -> Column:
    def twin(x, i):
        return F.coalesce(x["h"] == F.get(ordered, i - 1)["h"], F.lit(False)) | F.coalesce(
            x["h"] == F.get(ordered, i + 1)["h"], F.lit(False)
        )

    marked = F.transform(ordered, lambda x, i: F.when(twin(x, i), x["i"]))
    return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))


def _covered(at: Column) -> Column:
    width = F.lit(REPEAT_WINDOW)
    share = F.transform(at, lambda p, i: F.least(width, F.coalesce(F.get(at, i + 1) - p, width)))
    return F.aggregate(share, F.lit(0), lambda total, x: total + x)


@dataclass(frozen=True)
class Rule:
    """A name and the condition, over the text, under which it rejects."""

    name: str
    rejects: Callable[[Column], Column]


def _too_repetitive(text: Column) -> Column:
    def over(found):
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(found) - REPEAT_WINDOW),
            lambda i: F.xxhash64(*[found[i + k] for k in range(REPEAT_WINDOW)]),
        )
        hashes = F.when(F.size(found) >= REPEAT_WINDOW, hashes).otherwise(F.array())
        return F.transform(F.array(hashes), lambda h: _percent(repeat_words(h), F.size(found), MAX_REPEAT_PERCENT))[0]

    return F.transform(F.array(W.words(text)), over)[0]


def _symbol_words_over(text: Column) -> Column:
    found = F.regexp_count(text, F.lit(f"[^{W.BLANKS}#*$%&|<>]*+[#*$%&|<>][^{W.BLANKS}]*+"))
    return _percent(found, n_words(text), MAX_SYMBOL_WORDS_PERCENT)


def _dup_lines_over(text: Column) -> Column:
    return F.transform(F.array(lines(text)), lambda found: _percent(n_dup_lines(found), F.size(found), MAX_DUP_LINES_PERCENT))[0]


#: The base rules, as rules of the cascade.
BASE_RULES = (
    Rule("few_words", lambda text: n_words(text) < MIN_WORDS),
    Rule("repetitive", _too_repetitive),
)
#: What the method adds.
RULES = (
    Rule("symbol_words", _symbol_words_over),
    Rule("upper_case", lambda text: upper_percent_over(text, MAX_UPPER_PERCENT)),
    Rule("adjacent_words", lambda text: _percent(adjacent_words(text), n_words(text), MAX_ADJACENT_PERCENT)),
    Rule("dup_lines", _dup_lines_over),
    Rule("long_words", lambda text: _kept_chars(text, f"[{W.BLANKS}]+").cast("long") > n_words(text).cast("long") * MAX_MEAN_WORD),
)


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: float


def ordered_rules(docs: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """The rules in the order of rejection per cost, each with its estimate.

    The sample is spread over the whole table. One aggregate counts which rules
    reject together, so that a rule's share is that among the rows that are left
    when its turn comes; a timed run of each rule gives its cost.
    """
    if len(rules) < 2:
        return [Estimate(rule, 0.0, 0.0) for rule in rules]
    share = min(1.0, 1.2 * sample_rows / max(1, docs.count()))
    sample = docs.select(W.whole(F.col(text)).alias("sampled")).sample(share, seed=7).persist()
    try:
        rows = max(1, sample.count())
        seconds = [_timed(sample, rule) / rows for rule in rules]
        bits = [F.when(F.coalesce(rule.rejects(F.col("sampled")), F.lit(False)), 1 << k).otherwise(0) for k, rule in enumerate(rules)]
        mask = F.aggregate(F.array(*bits), F.lit(0), lambda a, b: a + b)
        together = {r["mask"]: r["n"] for r in sample.groupBy(mask.alias("mask")).agg(F.count("*").alias("n")).collect()}
    finally:
        sample.unpersist()
    return _greedy(rules, seconds, together)


def _timed(sample: DataFrame, rule: Rule) -> float:
    hits = sample.agg(F.sum(F.coalesce(rule.rejects(F.col("sampled")), F.lit(False)).cast("long")).alias("n"))
    hits.collect()  # compiled
    started = time.monotonic()
    hits.collect()
    return time.monotonic() - started


def _greedy(rules, seconds, together: dict[int, int]) -> list[Estimate]:
    left, order = dict(together), []
    waiting = list(range(len(rules)))
    while waiting:
        total = max(1, sum(left.values()))
        shares = {k: sum(n for mask, n in left.items() if mask >> k & 1) / total for k in waiting}
        best = max(waiting, key=lambda k: (shares[k] / max(seconds[k], 1e-9), -seconds[k], -k))
        order.append(Estimate(rules[best], seconds[best], shares[best]))
        left = {mask: n for mask, n in left.items() if not mask >> best & 1}
        waiting.remove(best)
    return order


def cascade(order: Sequence[Estimate], text: Column) -> Column:
    """The name of the first rule, in this order, that rejects; null if none does."""
    verdict = F.lit(None).cast("string")
    for estimate in reversed(order):
        verdict = F.when(F.coalesce(estimate.rule.rejects(text), F.lit(False)), F.lit(estimate.rule.name)).otherwise(verdict)
    return verdict


def kept(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + RULES, text: str = "text") -> DataFrame:
    """The rows no rule rejects, with the columns they came with.

    A missing or empty text has no words and is rejected by ``few_words``. Repeated
    rows are judged alike; other columns are not looked at.
    """
    return docs.where(cascade(ordered_rules(docs, rules, text), W.whole(F.col(text))).isNull())


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), W.whole(F.col(text)).alias("text"))
    rows = rows.withColumns({"words": W.words(F.col("text")), "lines": lines(F.col("text"))})
    hashes = W.windows("words", REPEAT_WINDOW, F.xxhash64)
    rows = rows.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": n_symbols(F.col("text")).cast("long"),
            "n_dup_lines": n_dup_lines(F.col("lines")).cast("long"),
            "hashes": hashes,
        }
    )
    rows = rows.withColumn("n_repeat_words", repeat_words(F.col("hashes")))
    return rows.select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op3_quality_rules(spark, sf_dir) -> DataFrame:
    """Measures and verdict of every document, nulls counted as empty texts.

    ``failed_rule`` names the first rule of the cascade that rejects a text the base
    rules let pass (which one may differ between runs where several do; the verdict does not).
    """
    W.workspace(spark)
    docs = W.table(spark, sf_dir, "documents")
    order = ordered_rules(docs, RULES)
    rows = measured(docs)
    failed = (F.col("n_words") < MIN_WORDS) | _percent(F.col("n_repeat_words"), F.col("n_words"), MAX_REPEAT_PERCENT)
    rows = rows.withColumn("base_failed", failed)
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(order, F.col("text")).isNull()).alias("kept"),
    )


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT row_id, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda line: regexp_matches(line, '[^\x20\x09-\x0D]')) AS lines
  FROM docs),
placed AS (SELECT row_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM parts),
nexts AS (
  SELECT row_id, place, word, lead(word, 1) OVER w AS second, lead(word, 2) OVER w AS third
  FROM placed WINDOW w AS (PARTITION BY row_id ORDER BY place)),
counted AS (
  SELECT row_id, place, third IS NOT NULL AND count(*) OVER (PARTITION BY row_id, word, second, third) > 1 AS twice,
    word = second AS again
  FROM nexts),
covered AS (
  SELECT row_id, again, twice OR coalesce(lag(twice, 1) OVER w, false) OR coalesce(lag(twice, 2) OVER w, false) AS repeated
  FROM counted WINDOW w AS (PARTITION BY row_id ORDER BY place)),
repeats AS (
  SELECT row_id, count(*) FILTER (repeated) AS n_repeat_words, count(*) FILTER (again) AS n_adjacent FROM covered GROUP BY row_id),
measures AS (
  SELECT doc_id, text, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_adjacent, 0) AS n_adjacent,
    len(list_filter(words, lambda word: regexp_matches(word, '[#*$%&|<>]'))) AS n_symbol_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM parts LEFT JOIN repeats USING (row_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbol_words > 25 * n_words OR 100 * n_upper > 40 * n_letters
    OR 100 * n_adjacent > 30 * n_words OR 100 * n_dup_lines > 50 * n_lines OR word_chars > 24 * n_words) AS kept
FROM measures
"""
