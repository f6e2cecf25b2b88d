"""Mixing to target weights with soft membership.

A classifier learnt from a labelled table gives each document a probability of
belonging to each domain. Documents then get nonnegative rates such that the
expected tokens of each domain, the sum of rate x tokens x probability, meet the
targets. The rates are found by projected gradient steps on least squares: the
state is one number a document, a step needs the domains' sums over all documents
and nothing else. Everything runs as DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefwarden import scratch
from hrefwarden.llm import words as W

#: Labelled rows the classifier learns from, about; those of the least hashes of the doc_id.
LABELLED_ROWS = 8_000
#: Words and marks it looks at: those that tell most about the domain.
VOCABULARY, LIFT = 120, 2.0
#: Log-odds are divided by this, as words of a text are far from independent.
TEMPERATURE = 1.5
#: Steps at most, the miss (in shares of all tokens) that ends them, and steps between written tables.
STEPS, CLOSE, WRITE_EVERY = 40, 1e-9, 8

#: The domains' log priors, and what the presence of a word or mark adds to each.
Model = tuple[dict[str, float], dict[str, list[float]]]

DOMAINS = ("clean", "poor", "toxic")
#: Target weights of the tokens by domain.
WEIGHTS = {"clean": 0.94, "poor": 0.03, "toxic": 0.03}


def label_domain() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")


def _marks(text: Column, words: Column) -> Column:
    """Words of the lowered text, each once, and marks of its style, which no word can equal as they hold a blank."""
    chars = F.length(text) + 1

    def share(pattern: str) -> Column:
        left = F.length(F.regexp_replace(text, pattern, ""))
        return F.floor((F.length(text) - left) * 12 / chars).cast("string")

    style = F.array(F.concat(F.lit("mark upper "), share("[A-Z]+")), F.concat(F.lit("mark symbols "), share("[#*$%&|<>]+")))
    once = F.array_distinct(words)
    repeats = F.floor(8 * F.size(once) / (F.size(words) + 1)).cast("string")
    return F.concat(once, style, F.array(F.concat(F.lit("mark distinct "), repeats)))


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, marks) of every row of docs(doc_id, text); tokens are words."""
    rows = docs.select("doc_id", W.whole(F.col("text")).alias("text"))
    rows = rows.withColumn("words", W.words(F.lower("text")))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_tokens"), _marks(F.col("text"), F.col("words")).alias("marks"))


def _labelled(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, domain), at most so many rows."""
    rows = labels.select("doc_id", label_domain().alias("domain")).where("doc_id is not null and domain is not null")
    return rows.groupBy("doc_id").agg(F.max("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def learnt(docs: DataFrame, labels: DataFrame, folder: str, most: int = LABELLED_ROWS) -> Model:
    """Naive Bayes over the words and marks a text has: the log prior of each domain and what a word's presence adds.

    What is absent counts too. The vocabulary holds what tells most about the domain among
    what is at least ``LIFT`` times as frequent in one domain as overall, which the common
    words of a language are not. The domain of a document is one of ``DOMAINS``; with
    nothing labelled, all are equally likely.
    """
    chosen = scratch.stage(_labelled(labels, most), folder, "labelled")  # bounded, so it can be broadcast
    seen = marked(docs.join(F.broadcast(chosen), "doc_id", "left_semi")).join(F.broadcast(chosen), "doc_id")
    seen = scratch.stage(seen.select("domain", "marks"), folder, "seen")
    sizes = {r.domain: r.n for r in seen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n = [sizes.get(d, 0) for d in DOMAINS]
    counts = seen.select("domain", F.explode("marks").alias("mark")).groupBy("mark")
    counts = counts.agg(*[F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(d) for d in DOMAINS])
    total = sum(n) + 1
    rates = [(F.col(d) + 0.5) / (k + 1) for d, k in zip(DOMAINS, n)]
    overall = (sum(F.col(d) for d in DOMAINS) + 0.5) / total
    told = sum(F.log(r / overall) * F.col(d) for r, d in zip(rates, DOMAINS))
    lifted = F.greatest(*[r / overall for r in rates]) >= LIFT
    top = counts.where(lifted).orderBy(told.desc(), "mark").limit(VOCABULARY).collect()
    priors = {d: float(np.log((k + 1) / (sum(n) + len(DOMAINS)))) for d, k in zip(DOMAINS, n)}
    adds = {}
    for row in top:
        p = [(row[d] + 0.5) / (k + 1) for d, k in zip(DOMAINS, n)]
        adds[row.mark] = [float(np.log(x / (1 - x))) for x in p]
        for d, x in zip(DOMAINS, p):
            priors[d] += float(np.log(1 - x))
    return priors, adds


def posteriors(marks: Column, model: Model) -> Column:
    """The probabilities of the domains, an array in their order, given the array of a document's marks."""
    priors, adds = model
    if adds:
        known = F.array(*[F.lit(mark) for mark in adds])
        weights = F.create_map(*[x for mark, w in adds.items() for x in (F.lit(mark), F.array(*[F.lit(v) for v in w]))])
        found = F.transform(F.array_intersect(marks, known), lambda mark: weights[mark])
        start = F.array(*[F.lit(priors[d]) for d in DOMAINS])
        logs = F.aggregate(found, start, lambda so_far, w: F.zip_with(so_far, w, lambda a, b: a + b))
    else:
        logs = F.array(*[F.lit(priors[d]) for d in DOMAINS])

    def softened(found: Column) -> Column:
        odds = F.transform(found, lambda x: F.exp((x - F.array_max(found)) / TEMPERATURE))
        sums = F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)
        return F.transform(F.array(odds), lambda o: F.transform(o, lambda x: x / sums))[0]

    return F.transform(F.array(logs), softened)[0]


def memberships(docs: DataFrame, model: Model, folder: str) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>...) of every row, as a written table."""
    rows = marked(docs)
    rows = rows.select("doc_id", "n_tokens", posteriors(F.col("marks"), model).alias("p"))
    rows = rows.select("doc_id", "n_tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)])
    return scratch.stage(rows, folder, "members")


def moved(rate: Column, shares: Sequence[Column], moves: Sequence[Sequence[float]]) -> Column:
    """A document's rate after steps along its domain shares, lifted to zero after each."""
    if not moves:
        return rate
    steps = F.array(*[F.array(*[F.lit(float(m)) for m in move]) for move in moves])
    along = lambda move: sum(p * move[k] for k, p in enumerate(shares))
    return F.aggregate(steps, rate, lambda r, move: F.greatest(F.lit(0.0), r - along(move)))


def _sums(rows: DataFrame, rate: Column) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of each domain, and the Gram matrix of the documents whose rate is above zero."""
    p = [F.col(f"p_{d}") for d in DOMAINS]
    n, k = F.col("n_tokens"), len(DOMAINS)
    expected = [F.sum(F.col("rate") * n * x) for x in p]
    live = F.when(F.col("rate") > 0, n).otherwise(0)
    gram = [F.sum(live * p[i] * p[j]) for i in range(k) for j in range(i, k)]
    found = rows.withColumn("rate", rate).agg(*expected, *gram).first()
    values = [float(v or 0) for v in found]
    matrix = np.zeros((k, k))
    matrix[np.triu_indices(k)] = values[k:]
    return np.array(values[:k]), matrix + np.triu(matrix, 1).T


def fitted_moves(members: DataFrame, folder: str, weights: Mapping[str, float] = WEIGHTS, total: float | None = None) -> list[list[float]]:
    """The steps that lead from rates of one to the targets; apply them with ``moved``.

    ``total`` is the number of tokens to reach; by default, as many as leave the first
    domain with what it has. A domain without any tokens cannot be reached and is left
    out. Each step moves every rate against the gradient of the squared misses,
    measured in the Gram matrix of the domains, and lifts negative rates to zero.
    """
    shares = [F.col(f"p_{d}") for d in DOMAINS]
    rows, moves, written = members.withColumn("rate", F.lit(1.0)), [], 0
    expected, gram = _sums(rows, F.col("rate"))
    wanted = np.array([weights.get(d, 0.0) for d in DOMAINS]) * (expected > 0)
    if not expected.sum() or not wanted.sum():
        return []
    wanted = wanted / wanted.sum()
    if total is None:
        total = expected[0] / wanted[0] if wanted[0] else expected.sum()
    target = wanted * total
    while len(moves) < STEPS:
        miss = expected - target
        if np.abs(miss).max() <= CLOSE * total:
            break
        ridge = 1e-9 * max(np.trace(gram), 1.0)
        moves.append([float(m) for m in np.linalg.solve(gram + ridge * np.eye(len(DOMAINS)), miss)])
        rate = moved(F.col("rate"), shares, moves[written:])
        if len(moves) % WRITE_EVERY == 0:
            rows = scratch.stage(rows.withColumn("rate", rate), folder, f"rates_{len(moves)}")
            rate, written = F.col("rate"), len(moves)
        expected, gram = _sums(rows, rate)
    return moves


def copies(rate: Column, key: Column) -> Column:
    """A whole number that is ``rate`` on average, the same for the same key."""
    chance = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 31)) / F.lit(float(1 << 31))
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mixed(docs: DataFrame, labels: DataFrame, folder: str, weights: Mapping[str, float] = WEIGHTS, keep: str | None = "clean") -> DataFrame:
    """``docs`` as often as their rates say, columns as they are; rows most likely of domain ``keep`` at least once."""
    model = learnt(docs, labels, folder)
    moves = fitted_moves(memberships(docs, model, folder), folder, weights)
    text = W.whole(F.col("text"))

    def shares(found: Column) -> Column:
        return posteriors(_marks(text, found), model)

    rows = docs.withColumn("__shares", F.transform(F.array(W.words(F.lower(text))), shares)[0])
    p = [F.col("__shares")[k] for k in range(len(DOMAINS))]
    n = copies(moved(F.lit(1.0), p, moves), F.xxhash64("doc_id", text))
    if keep is not None:
        likeliest = F.array_position("__shares", F.array_max("__shares")) == DOMAINS.index(keep) + 1
        n = F.when(likeliest, F.greatest(n, F.lit(1))).otherwise(n)
    rows = rows.withColumn("__copies", n).where("__copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select(*docs.columns)


def op5_mixing(spark, sf_dir) -> DataFrame:
    """Tokens, domain probabilities, rate and drawn number of copies of every document.

    Null and empty texts have no tokens; their rate follows from their probabilities.
    """
    folder = W.workspace(spark)
    docs = W.table(spark, sf_dir, "documents")
    members = memberships(docs, learnt(docs, W.table(spark, sf_dir, "labels"), folder), folder)
    rate = moved(F.lit(1.0), [F.col(f"p_{d}") for d in DOMAINS], fitted_moves(members, folder))
    rows = members.withColumn("rate", rate)
    return rows.withColumn("n_copies", copies(F.col("rate"), F.xxhash64("doc_id")))
