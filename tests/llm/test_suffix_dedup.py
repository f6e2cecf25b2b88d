import random
from collections import Counter

import pytest

from hrefwarden import scratch
from hrefwarden.llm import suffix_dedup
from hrefwarden.llm.grouping import suffix_array

SMALL = "/root/testdata/sf0.001"
LENGTH = suffix_dedup.LENGTH


def brute_force(texts):
    """(n_bytes, n_removed, n_spans, kept) of each text by counting every window of all texts."""
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + LENGTH] for d in data for i in range(len(d) - LENGTH + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - LENGTH + 1):
            if counts[d[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\1" * LENGTH
        runs = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), runs, bytes(b for b, x in zip(d, gone) if not x)))
    return out


def found(spark, rows, schema="doc_id long, text string"):
    docs = spark.createDataFrame(rows, schema)
    done = suffix_dedup.deduplicated(docs, scratch.run_folder(spark)).collect()
    return sorted((r.doc_id is not None, r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in done)


def expected(rows):
    return sorted((i is not None, i, *x) for (i, *_), x in zip(rows, brute_force([r[1] for r in rows])))


def test_suffix_array_against_sorting():
    rng = random.Random(1)
    for _ in range(3000):
        text = [rng.randint(0, rng.randint(0, 4)) for _ in range(rng.randint(0, 40))]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def passages():
    rng = random.Random(7)
    noise = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passage, other = noise(460), noise(230)
    texts = [noise(500) + passage + noise(300), passage, noise(90) + passage[30:] + noise(10), noise(700)]
    texts += [noise(20) + other + noise(50) + other + noise(40), other[:199], other[1:], other[:100] + "x" + other[100:]]
    texts += ["a" * 450, "a" * 200, "a" * 199, "ab" * 250, "", None, texts[0]]
    texts += [noise(rng.randint(0, 250)) + passage[rng.randint(0, 200) :][: rng.randint(200, 260)] + noise(60) for _ in range(40)]
    return texts


def test_passages_repeats_and_edges(spark):
    rows = list(enumerate(passages()))
    assert found(spark, rows) == expected(rows)


def test_crowded_anchors_are_counted(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST", 3)
    rows = list(enumerate(passages()))
    assert found(spark, rows) == expected(rows)


def test_hot_anchors_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 3)
    rows = list(enumerate(passages()))
    assert found(spark, rows) == expected(rows)


def test_windows_at_every_distance_from_the_anchor():
    """Contexts that share what ends or begins at any place, the anchor at the same distance."""
    rng = random.Random(3)
    noise = lambda n: bytes(rng.choice(b"abc") for _ in range(n))
    for _ in range(200):
        core = noise(rng.randint(200, 260))
        contexts, places = [], []
        for _ in range(rng.randint(1, 6)):
            first, last = rng.randint(0, 30), rng.randint(0, 30)
            before = noise(rng.randint(0, 20))
            contexts.append(before + core[first : len(core) - last] + noise(rng.randint(0, 20)))
            places.append(100 + len(before) - first)
        counts = Counter(c[i : i + LENGTH] for c in contexts for i in range(len(c) - LENGTH + 1))
        again = [[i for i in range(len(c) - LENGTH + 1) if counts[c[i : i + LENGTH]] > 1] for c in contexts]
        assert [x.tolist() for x in suffix_dedup.repeated_windows(contexts, places)] == again


def test_text_longer_than_a_piece(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range((1 << 20) + 70_000))
    rows = [(1, long), (2, "x" + long[(1 << 20) - 150 : (1 << 20) + 150] + "y"), (3, long[-210:])]
    assert found(spark, rows) == expected(rows)


def test_repeated_rows_and_odd_columns(spark):
    text = passages()[0]
    rows = [(1, text, 0, "x"), (1, text, 0, "x"), (None, text[100:], 0, "y"), (2, None, 0, None), (2, "short", 1, "z")]
    schema = "doc_id long, text string, row int, spans string"
    assert found(spark, rows, schema) == expected(rows)
    assert suffix_dedup.deduplicated(spark.createDataFrame([], schema), scratch.run_folder(spark)).collect() == []


@pytest.mark.parametrize("most", [2000])
def test_whole_table(spark, most):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert found(spark, rows) == expected(rows)
