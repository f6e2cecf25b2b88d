"""Line dedup against brute force, on both ways to the arrays; the perfect hash alone."""

import hashlib
from collections import Counter

import numpy as np
import pytest

import check_oracle
import __spark_entry__ as registered
from hrefwarden import scratch
from hrefwarden.llm import line_dedup
from hrefwarden.llm.perfect_hash import PerfectHash

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(texts, least):
    lines = [(t or "").split("\n") for t in texts]
    held = Counter(k for own in lines for k in {key_of(x) for x in own} if k)
    kept = [[x for x in own if held[key_of(x)] < least] for own in lines]
    return [(len(a), len(a) - len(b), "\n".join(b)) for a, b in zip(lines, kept)]


@pytest.mark.parametrize("n,levels", [(0, 24), (1, 24), (2, 1), (5000, 24), (5000, 2)])
def test_perfect_hash_is_minimal_and_rejects_strangers(n, levels):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64)
    keys[: n // 10, 0] = 7  # equal first halves
    counts = np.arange(1, n + 1)
    made = PerfectHash.build(keys, counts, levels)
    assert sorted(made.indices(keys)) == list(range(n))
    again = PerfectHash.unpacked(made.packed())
    assert (again.counts_of(keys) == counts).all()
    strangers = keys.copy()
    strangers[:, 1] ^= np.uint64(1)
    assert not again.counts_of(strangers).any() and not again.counts_of(strangers[:0]).any()
    assert again.counts.dtype.itemsize == (1 if n < 256 else 2)


TEXTS = (
    ["\n".join(["Shared line ", f"own {k}", "", "\tSHARED LINE\r", " twice", "twice" if k % 2 else "x"]) for k in range(12)]
    + [None, "", "\n\n", "Shared line", "é Ä shared", "É ä shared", "long " * 30_000 + "\nshared LINE\n" + "y" * 100_000]
    + ["same\nshared line"] * 9
)


@pytest.mark.parametrize("max_bytes", [line_dedup.MAX_BYTES, 0])
def test_same_as_brute_force(spark, max_bytes):
    rows = [(k, t, "z", 1) for k, t in enumerate(TEXTS)] + [(None, "same", "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string, h1 int").repartition(3)
    for least in (2, 10, 13, 22, 10**6):
        found = line_dedup.without_common_lines(docs, scratch.run_folder(spark), least=least, max_bytes=max_bytes)
        assert found.columns == ["doc_id", "text", "h1", "n_lines", "n_dropped"]
        got = sorted((r.doc_id if r.doc_id is not None else len(TEXTS), r.n_lines, r.n_dropped, r.text or "") for r in found.collect())
        assert got == [(k, *row) for k, row in enumerate(brute([*TEXTS, "same"], least))]


@pytest.mark.parametrize("max_bytes", [line_dedup.MAX_BYTES, 0])
def test_empty_table(spark, max_bytes):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.without_common_lines(docs, scratch.run_folder(spark), max_bytes=max_bytes).collect() == []


def test_many_shards_on_both_ways(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 16)
    monkeypatch.setattr(line_dedup, "HELD", 50)
    texts = ["\n".join(f"line {(k * j) % 211}" for j in range(1, 60)) for k in range(1, 80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for max_bytes in (line_dedup.MAX_BYTES, 0):
        found = line_dedup.without_common_lines(docs, scratch.run_folder(spark), max_bytes=max_bytes)
        assert sorted((r.n_lines, r.n_dropped, r.text) for r in found.collect()) == sorted(brute(texts, 10))


def test_query(spark, tmp_path):
    con = check_oracle.connect(SF)
    assert check_oracle.differences(spark, con, SF, "op13_line_dedup") is None
    rows = [(k, t, 1) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, n_lines int").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in registered.queries()["op13_line_dedup"](spark, str(tmp_path)).collect())
    assert got == [(k, n, d, hashlib.sha256(t.encode()).hexdigest()) for k, (n, d, t) in enumerate(brute(TEXTS, 10))]
