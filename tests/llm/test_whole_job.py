"""Operators do the whole job: what was once shared, sampled or dropped."""

import math

import numpy as np
from pyspark.sql import functions as F

from hrefwarden import scratch
from hrefwarden.llm import arrow_text, fingerprints, pseudo_likelihood, warc


def test_words_of_one_place_score_by_their_own_counts(spark):
    words = {f"w{k}": 1 + k % 3 for k in range(9000)}
    docs = spark.createDataFrame([(0, " ".join(w for w, n in words.items() for _ in range(n)))], "doc_id long, text string")
    network = pseudo_likelihood.vocabulary(docs)
    alone = spark.createDataFrame([(k, w) for k, w in enumerate(words)] + [(-1, "unseen"), (-2, "w1 w1 w4")], docs.schema)
    found = {r.doc_id: r.log_prob for r in pseudo_likelihood.scored(alone, network).collect()}
    assert len(found) == len(words) + 2 and all(math.isfinite(x) for x in found.values())
    # before, each word had the probability of its whole place
    assert 0.7 < sum(math.exp(found[k]) for k in range(len(words))) <= 1 + 1e-6
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    numbers = network.words_of(arrow_text.word_hashes(data, np.array([0, len(data)]))[0])
    rare = [k for k in range(len(words)) if numbers[k] >= network.own]
    assert len(rare) > 4000
    least: dict[int, float] = {}
    for k in rare:
        score = found[k] - math.log(words[f"w{k}"])
        assert math.isclose(least.setdefault(numbers[k], score), score, rel_tol=1e-5)
    held = np.bincount([numbers[k] - network.own for k in rare], [words[f"w{k}"] for k in rare], minlength=len(network.totals))
    assert (held == network.totals).all()


def test_places_grow_with_the_distinct_words(spark):
    few, many = (
        pseudo_likelihood.vocabulary(spark.range(20).selectExpr("id as doc_id", f"concat_ws(' ', transform(sequence(1, {n}), i -> concat(id, 'x', i))) as text"))
        for n in (1000, 20_000)
    )
    assert len(few.weights["word"]) == pseudo_likelihood.WORDS < len(many.weights["word"])
    assert many.own > few.own and len(many.totals) > len(few.totals) and many.totals.sum() == 400_000 - many.own


def test_rounds_learn_from_every_place_once():
    hashed = arrow_text.mixed(np.arange(1, 5001, dtype=np.uint64))
    bounds = np.array([0, 1, 1, 3, 900, 5000])
    turns = np.stack([pseudo_likelihood.drawn(hashed, bounds, turn) for turn in range(pseudo_likelihood.ROUNDS)])
    assert (turns.sum(axis=0) == 1).all()
    for a, b in zip(bounds, bounds[1:]):  # however documents are batched
        alone = [pseudo_likelihood.drawn(hashed[a:b], np.array([0, b - a]), turn) for turn in range(pseudo_likelihood.ROUNDS)]
        assert (np.stack(alone) == turns[:, a:b]).all()


def test_a_single_word_is_learnt_from(spark):
    for text in ("one", "two", "three"):  # a sample of an eighth misses most
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start, done = pseudo_likelihood.vocabulary(docs), pseudo_likelihood.fitted(docs)
        assert any((start.weights[k] != done.weights[k]).any() for k in start.weights), text


def test_containment_of_texts_without_low_hashes_is_unknown(spark):
    words = [f"w{k}" for k in range(3000)]
    texts = [("long", " ".join(words)), ("empty", "")] + [(f"s{k}", " ".join(words[k : k + 6])) for k in range(0, 300, 10)]
    docs = fingerprints.sketched(spark.createDataFrame(texts, "name string, text string"), "text", "sketch").cache()
    low = {r.name: any(0 <= h < fingerprints.LIMIT_NUMBER for h in r.sketch) for r in docs.collect()}
    short = [n for n in low if n.startswith("s")]
    assert {low[n] for n in short} == {True, False} and low["long"]
    long = docs.where("name = 'long'").select(F.col("sketch").alias("whole"))
    both = docs.crossJoin(long).select("name", fingerprints.containment(F.col("sketch"), F.col("whole")).alias("c"))
    # before, a short text without a low hash had containment 0 in the text that holds it whole
    assert {r.name: r.c for r in both.collect()} == {n: 1.0 if low[n] or n == "empty" else None for n in low}
    union = fingerprints.merged(docs, "name")
    assert {r.name for r in union.collect()} == set(low) - {"empty"}
    left, right = union.withColumnRenamed("name", "a"), union.where("name = 'long'").withColumnRenamed("name", "b")
    found = [tuple(r) for r in fingerprints.merged_containment(left, right, "a", "b").collect()]
    assert sorted(found, key=str) == sorted([(n, "long", 1.0) if low[n] else (n, None, None) for n in low if n != "empty"], key=str)
    group = fingerprints.merged(docs.withColumn("kind", F.substring("name", 1, 1)), "kind")
    assert group.where("hash is null").count() == 0 and {r.kind for r in group.collect()} == {"l", "s"}


def test_dictionary_is_trained_on_long_pages_too(spark):
    body = "<p>a paragraph of words that all pages have</p>" * 2000
    rows = [(k, f"http://l/{k}", f"<html><head><title>{k}</title></head>" + body.replace("words", f"words{k}")) for k in range(40)]
    assert min(len(h) for *_, h in rows) > warc.SAMPLE_RECORD_BYTES
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = scratch.run_folder(spark)
    plan = scratch.stage(warc.planned(pages, folder), folder, "plan")
    assert warc.trained_dictionary(pages, plan)  # before, it was empty
    found = {r.page_id: bytes(r.payload).decode() for r in warc.read(spark, warc.archive(pages, folder), folder).collect()}
    assert found == {k: html for k, _, html in rows}
