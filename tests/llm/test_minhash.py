import re

import numpy as np
import pytest

from hrefwarden import scratch
from hrefwarden.llm import arrow_text, minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def shingles(text):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)}


def brute_force(rows):
    """doc_id -> (n_shingles, component, kept) by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for pair in {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}:
        a, b = (sets[i] for i in pair)
        if 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted(map(root, pair))
            parent[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def grouped(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash.near_duplicates(docs, scratch.run_folder(spark)).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found}


def sentence(rng, n):
    return [f"w{k}" for k in rng.integers(0, 5000, n)]


def test_whole_table_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert grouped(spark, rows) == brute_force(rows)


def test_chains_strays_and_groups_of_copies(spark):
    rng = np.random.default_rng(5)
    base = sentence(rng, 120)
    rows = [(k, " ".join(base)) for k in range(40, 60)]
    changed = list(base)
    for k in range(60, 90):  # each differs from the one before by a word, the ends differ by much
        changed[(k * 7) % 120] = f"c{k}"
        rows.append((k, " ".join(changed)))
    for k in range(100, 130):  # about as far from the base as a link allows
        near = list(base)
        for at in rng.choice(120, 3, replace=False):
            near[at] = f"n{k}-{at}"
        rows.append((k, " ".join(near)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "a b"), (204, "A  B"), (205, "a b c d e"), (206, "a b c d e\n")]
    assert grouped(spark, rows) == brute_force(rows)


def test_edge_rows(spark):
    rows = [(None, "one two three four five six"), (1, "one two three four five six"), (1, "one two three four five six"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as bucket", "2 as hub", "'x' as shingles")
    found = sorted(map(str, minhash.near_duplicates(docs, scratch.run_folder(spark)).drop("version").collect()))
    assert found == [
        "Row(doc_id=1, n_shingles=2, component_id=1, kept=True)",
        "Row(doc_id=1, n_shingles=2, component_id=1, kept=True)",
        "Row(doc_id=2, n_shingles=0, component_id=2, kept=True)",
        "Row(doc_id=None, n_shingles=2, component_id=None, kept=True)",
    ]
    assert minhash.near_duplicates(docs.limit(0), scratch.run_folder(spark)).collect() == []


@pytest.mark.parametrize("likeness", [0.2, 0.5, 0.8])
def test_signatures_estimate_likeness(likeness):
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        n = 300
        shared = int(round(2 * n * likeness / (1 + likeness) / 2))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate((a[:shared], rng.integers(0, 1 << 63, n - shared, dtype=np.uint64)))
        signature = minhash.signatures(np.concatenate((a, b)), np.array([0, n, 2 * n]))
        errors.append((signature[0] == signature[1]).mean() - shared / (2 * n - shared))
    assert abs(np.mean(errors)) < 0.02
    plain = np.sqrt(likeness * (1 - likeness) / minhash.PLACES)
    assert np.std(errors) < 1.15 * plain


def test_byte_helpers():
    import pyarrow as pa

    arrow_text._cached.clear()  # as in a worker whose first texts are empty
    assert len(arrow_text.word_hashes(*arrow_text.text_bytes(pa.array([None, ""])))[0]) == 0

    texts = ["", None, "a", "A b", " x\ty z\n", "one two three four five six", "é ö"]
    data, offsets = arrow_text.text_bytes(pa.array(texts).slice(1))
    hashes, counts = arrow_text.word_hashes(data, offsets)
    assert list(np.diff(counts)) == [0, 1, 2, 3, 6, 2]
    assert hashes[0] == hashes[1]
    assert list(np.diff(arrow_text.shingle_hashes(hashes, counts, 5)[1])) == [0, 1, 1, 1, 2, 1]


def test_kept_rows(spark):
    text = "one two three four five six"
    rows = [(3, text, 1), (3, text, 1), (5, text.upper(), 2), (6, "another one", 3), (None, text, 4), (7, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, version int")
    found = minhash.kept(docs, scratch.run_folder(spark))
    assert found.columns == docs.columns
    assert sorted(r.version for r in found.collect()) == [1, 3, 4, 5]
