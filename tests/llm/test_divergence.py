"""Source divergence against DuckDB and brute force."""

import re
from collections import Counter, defaultdict

import numpy as np

import check_oracle
import __spark_entry__ as registered
from hrefwarden import scratch
from hrefwarden.llm import divergence

SF = "/root/testdata/sf0.001"


def brute(docs, least, top):
    terms = [
        (lang or "", source or "", Counter("".join(c.lower() if c <= "Z" else c for c in t) for t in re.findall("[A-Za-z\x80-\U0010ffff]+", text or "")))
        for text, lang, source in docs
    ]
    rows, langs = [], defaultdict(lambda: defaultdict(Counter))
    for lang, source, own in terms:
        langs[lang][source].update(own)
    for lang, sources in langs.items():
        df = Counter(t for of, _, own in terms if of == lang for t in own)
        kept = {t for t, n in df.items() if n >= least}
        whole = sum(sources.values(), Counter())

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in sources.items()}, shares(whole)
        for s in sources:
            parts = {"pair": [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]}
            parts["term"] = [(q[t] - p[s][t], t.encode(), t) for t in kept if sources[s][t] and p[s][t] > q[t]]
            for part, items in parts.items():
                ranked = list(enumerate(sorted(items), 1))[: None if part == "pair" else top]
                rows += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in ranked]
    return sorted(rows)


def rows_of(frame):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in frame.collect())


ODD = (
    [("alpha beta Gamma beta", "en", "a")] * 4
    + [("alpha delta-delta_delta7éÉ \U0001f600", "en", "b")] * 3
    + [("beta " * 20_000, "en", None), (None, "en", "c"), ("", "en", "d"), ("1 2 3", "de", "a"), ("word", "de", "b"), (None, None, None)]
    + [("alpha ａ z", "en", "￿"), ("alpha \U00010000 z", "en", "\U00010000")] * 2
)


def test_query_is_sql(spark):
    assert check_oracle.differences(spark, check_oracle.connect(SF), SF, "op11_source_divergence") is None


def test_odd_rows(spark, monkeypatch):
    docs = spark.createDataFrame(ODD, "text string, lang string, source string").selectExpr("*", "1 as term", "2 as n", "3 as id").repartition(3)
    for held, part in ((divergence.HELD, divergence.SOURCES_A_TASK), (1, 2)):
        monkeypatch.setattr(divergence, "HELD", held)
        monkeypatch.setattr(divergence, "SOURCES_A_TASK", part)
        for least, top in ((1, 2), (2, 50), (99, 50)):
            assert rows_of(divergence.divergence(docs, scratch.run_folder(spark), least, top)) == brute(ODD, least, top)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert registered.queries()["op11_source_divergence"](spark, str(tmp_path)).collect() == []


def test_shares_are_exact_beyond_64_bits(spark):
    rows = [(10**15, 3 * 10**15, 1000), (0, 0, 1), (2 * 10**10, 2 * 10**10, 5)]
    expected = [1 + 10**9 * (n + 5) // (total + 5 * terms) for n, total, terms in rows]
    frame = spark.createDataFrame(rows, "n long, total long, terms long")
    assert [r.p for r in frame.select(divergence.share("n", "total", "terms").alias("p")).collect()] == expected
    for (n, total, terms), p in zip(rows, expected):
        wide = divergence._wide(np.array([n])), divergence._wide(np.array([total]))
        assert divergence.shares(*wide, terms).tolist() == [p]


def test_a_block_of_bitmaps_is_the_sum_over_its_terms():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 5, (7, 40))
    counts[2] = 0
    at, n, bits = [], [], []
    for source in range(7):
        for level in sorted(set(counts[source]) - {0}):
            at.append(source), n.append(level), bits.append(sum(1 << int(t) for t in np.flatnonzero(counts[source] == level)))
    present = counts.any(axis=0)
    totals = counts.sum(axis=1)
    p = np.stack([divergence.shares(counts[s], totals[s], 40) for s in range(7)])[:, present]
    expected = np.abs(p[:, None] - p[None]).sum(axis=2)
    got = divergence.block_differences(np.arange(7), totals, 40, np.array(at), np.array(n), np.array(bits, dtype=np.uint64))
    assert (got == expected).all()
