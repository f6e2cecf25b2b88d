"""Spelling variants against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter

import __spark_entry__ as registered
from hrefwarden import scratch
from hrefwarden.llm import spelling

SF = "/root/testdata/sf0.001"


def near(a, b):
    """Edit distance one, by the letters that may be left out or replaced."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_words(docs):
    held = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            held[run] += 1
    return {w: n for w, n in held.items() if len(w) >= 5 and n >= 3}


def brute(words):
    by_length, forms, out = {}, {}, {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for w, n in words.items():
        close = [o for m in (-1, 0, 1) for o in by_length.get(len(w) + m, ()) if near(w, o)]
        best = min(close, key=lambda o: (-words[o], o), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = len(close)
    rows = []
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, forms[w], root, n, out[w], words[forms[w]] if forms[w] else None))
    return sorted(rows)


def rows_of(frame):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect())


def test_query_is_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    expected = brute(brute_words(docs))
    assert len(expected) > 500 and any(r[1] for r in expected)
    assert rows_of(registered.queries()["op12_spelling_variants"](spark, SF)) == expected


def test_odd_rows(spark, tmp_path):
    words = "spelling spellin speling spellling Àbcéÿ àbcéÿ ×÷×÷× abcd abcde abcdef " + "q" * 5000
    rows = [(None, words), (1, None), (2, ""), (3, "\U0001f600 \n"), (5, words), (5, words), (6, words.upper()), (7, "spelling,spelling;SPELLING_spelling" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'w' as word", "1 as n", "2 as size")
    docs.write.parquet(str(tmp_path / "odd/documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    query = registered.queries()["op12_spelling_variants"]
    found = rows_of(query(spark, str(tmp_path / "odd")))
    assert found == brute(brute_words(rows)) and len(found) > 8
    assert query(spark, str(tmp_path / "none")).collect() == []


def drawn(n):
    rng = random.Random(5)
    pool = {"".join(rng.choice("abcäЖ\U0001f600") for _ in range(rng.randint(1, 7))) for _ in range(n)}
    return {w: rng.randint(1, 9) for w in sorted(pool)}


def test_pairs_and_tiles(spark):
    words = drawn(900)
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    expected = sorted((a, words[a], b, words[b]) for a, b in itertools.permutations(words, 2) if near(a, b))
    for tile_words in (spelling.TILE_WORDS, 7):
        found = spelling.near_pairs(frame, scratch.run_folder(spark), tile_words=tile_words)
        assert sorted(tuple(r) for r in found.collect()) == expected


def test_small_blocks(spark, monkeypatch):
    words = drawn(500)
    expected = sorted((a, b) for a, b in itertools.permutations(words, 2) if near(a, b))
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 3)
    rows = [("first", 0, 0, 0, w) for w in words]
    for a, b in itertools.permutations(words, 2):
        assert (len(a) <= len(b) <= len(a) + 1 and spelling.one_edit(a, b)) == (near(a, b) and len(a) <= len(b))
    letters = spelling.letter_counts(list(words))
    import numpy as np

    one = np.zeros(len(rows), dtype=int)
    kept = {(i, j) for a, b in spelling.close_pairs(letters, letters, one, one) for i, j in zip(a, b)}
    number = {w: k for k, w in enumerate(words)}
    assert all((number[a], number[b]) in kept for a, b in expected)


def test_roots_follow_long_chains(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(20)] + [(f"v{k}", "w3") for k in range(50)]
    found = spelling.roots(spark.createDataFrame(chain, "word string, form string"), scratch.run_folder(spark))
    assert {(r.word, r.root) for r in found.collect()} == {(w, "w20") for w, _ in chain}
    none = spark.createDataFrame([], "word string, form string")
    assert spelling.roots(none, scratch.run_folder(spark)).collect() == []
