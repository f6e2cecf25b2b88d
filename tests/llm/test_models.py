"""Archives, mixing, trees, language model and the pipeline against brute force, round trips and held-out labels."""

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import __spark_entry__ as registered
import corpus_pipeline
from hrefwarden import scratch
from hrefwarden.llm import arrow_text, mixing, pseudo_likelihood, quality_trees, warc

SF = "/root/testdata/sf0.01"


@pytest.fixture
def empty(spark, tmp_path):
    for name, schema in (
        ("documents", "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", "doc_id long, quality int, toxic int"),
        ("pages", "page_id long, url string, html string"),
    ):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", [n for n in registered.queries() if n.startswith("op") or n == "pipeline"])
def test_empty_tables(spark, empty, name):
    assert registered.queries()[name](spark, empty).collect() == []


def test_archives_read_back(spark):
    page = "<html>" + "<p>a paragraph of some words</p>" * 60
    rows = [(1, "http://a/%0A\n", page), (2, None, page), (3, "http://c/", page + "é"), (3, "http://c/", page + "é"), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (None, "u", page)]
    rows += [(k, f"http://e/{k}", f"{page}{k}") for k in range(10, 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as digest")
    folder = scratch.run_folder(spark)
    manifest = warc.archive(pages, folder)
    found = warc.read(spark, manifest, folder).collect()
    assert manifest.agg(F.sum("records")).first()[0] == len(found) == len(rows)
    assert {(r.page_id, r.url) for r in found} == {(i, u) for i, u, _ in rows}
    for r in found:
        html = next(h or "" for i, u, h in rows if (i, u) == (r.page_id, r.url)).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha1(html).hexdigest())
        assert r.record_type == ("revisit" if r.page_id in (1, None) else "response") and r.refers_to == (2 if r.page_id in (1, None) else None)
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html
    files, root = warc.file_system(folder)
    archive = files.open_input_stream(f"{root}/{manifest.first().path}", compression=None).read()
    assert archive[:4] == (0x184D2A5D).to_bytes(4, "little")
    size = int.from_bytes(archive[4:8], "little")
    dictionary = zstandard.ZstdDecompressor().decompress(archive[8 : 8 + size])
    whole = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).stream_reader(archive[8 + size :], read_across_frames=True).read()
    assert whole == b"".join(warc.frames(archive)) and whole.startswith(b"WARC/1.1\r\n")


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(2)
    shares = rng.dirichlet([0.5, 0.3, 0.2], 400)
    rows = [(k, int(n), *map(float, p)) for k, (n, p) in enumerate(zip(rng.integers(1, 500, 400), shares))]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, p_clean double, p_poor double, p_toxic double")
    moves = mixing.fitted_moves(members, scratch.run_folder(spark), {"clean": 0.6, "poor": 0.3, "toxic": 0.1})
    rate = mixing.moved(F.lit(1.0), [F.col(f"p_{d}") for d in mixing.DOMAINS], moves)
    done = members.withColumn("rate", rate).toPandas()
    totals = [(done.n_tokens * done.rate * done[f"p_{d}"]).sum() for d in mixing.DOMAINS]
    assert np.allclose(np.array(totals) / sum(totals), [0.6, 0.3, 0.1], atol=1e-3) and done.rate.min() >= 0
    n = members.select(F.sum(mixing.copies(F.lit(0.25), F.col("doc_id")))).first()[0]
    assert 70 < n < 130


def test_domains_of_labelled_documents(spark):
    rows = registered.queries()["op5_mixing"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", mixing.label_domain().alias("domain"))
    found = rows.join(labels, "doc_id").toPandas()
    clean = found[found.domain == "clean"]
    assert rows.count() == 1000 and (clean.p_clean > 0.5).mean() > 0.95
    assert np.allclose(found.p_clean + found.p_poor + found.p_toxic, 1)


def test_trees_on_held_out_labels(spark):
    rows = registered.queries()["op10_quality_trees"](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert list(rows.held_out) == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]
    found = rows.merge(labels, on="doc_id")
    held = found[found.held_out]
    assert (held.predicted == held.quality).mean() > 0.93 and rows.score.between(0, 1).all()


@pytest.fixture
def odd(spark, tmp_path):
    """A folder of documents with missing, empty, long and repeated rows and clashing columns, and their labels."""
    good = [(k, f"The study number {k} shows how rivers carry fine sand to the sea, and why it settles there.") for k in range(40)]
    poor = [(k, f"BUY!!! now $$$ {k} ### click click click click >>> free $$$ {k}") for k in range(40, 80)]
    rows = [*good, *poor, (80, None), (81, ""), (82, " \n\t"), (83, "word " * 30_000), (None, good[0][1]), (1, good[1][1]), (1, good[1][1]), (84, good[1][1])]
    extra = ["'x' as stats", "1 as score", "0 as label", "2 as rate", "'t' as tokens", "true as held_out", "'en' as lang", "'web' as source"]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *extra).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, int(k < 40), 0) for k in range(80)] + [(None, 1, 0), (1, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), rows


def test_odd_rows_of_trees(spark, odd):
    sf, rows = odd
    found = registered.queries()["op10_quality_trees"](spark, sf).collect()
    assert sorted((r.doc_id for r in found), key=str) == sorted((i for i, _ in rows), key=str)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    scores = {}
    for r in found:  # equal texts have equal scores, null and empty ones too
        text = next((t or "") for i, t in rows if i == r.doc_id)
        assert scores.setdefault(text, r.score) == r.score
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[k].predicted == int(k < 40) for k in range(80))


def test_odd_rows_of_mixing(spark, odd):
    sf, rows = odd
    found = registered.queries()["op5_mixing"](spark, sf).collect()
    assert sorted((r.doc_id for r in found), key=str) == sorted((i for i, _ in rows), key=str)
    p = [f"p_{d}" for d in mixing.DOMAINS]
    assert all(math.isclose(sum(r[x] for x in p), 1.0, abs_tol=1e-9) and r.rate >= 0 and r.n_copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in found)
    same = [tuple(r[x] for x in (*p, "rate")) for r in found if r.doc_id in (1, 84)]
    assert len(same) == 4 and len(set(same)) == 1
    assert len({tuple(r[x] for x in (*p, "rate")) for r in found if r.doc_id in (80, 81)}) == 1


def test_flat_trees_equal_walked_ones():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(900, 6)).astype(np.float32)
    labels = ((rows[:, 0] > 0) ^ (rows[:, 3] > 0.4)).astype(float)
    forest = quality_trees.grown(rows, labels, trees=12)
    for row, score in zip(rows[:80], forest.scores(rows)):
        total = forest.start
        for at in forest.roots:
            while forest.left[at] != at:
                at = forest.left[at] if row[forest.feature[at]] <= forest.limit[at] else forest.right[at]
            total += forest.value[at]
        assert math.isclose(score, 1 / (1 + math.exp(-total)), rel_tol=1e-9)
    assert ((forest.scores(rows) > 0.5) == labels).mean() > 0.9
    assert set(quality_trees.grown(rows, np.ones(900)).scores(rows)) == {901 / 902}


def test_statistics_of_odd_texts():
    texts = ["", None, " \n", "a", "A A A a\nline\nline\n", "### $$$", "x" * 100_000, "é" * 7]
    rows = quality_trees.statistics(*arrow_text.text_bytes(pa.array(texts)))
    assert rows.shape == (len(texts), len(quality_trees.STATISTICS)) and np.isfinite(rows).all() and not rows[:2].any()
    named = dict(zip(quality_trees.STATISTICS, rows[4]))
    assert math.isclose(named["adjacent_words"], 3 / 6, rel_tol=1e-6) and math.isclose(named["dup_lines"], 1 / 3, rel_tol=1e-6)


def test_gradients_are_those_of_the_log_probability():
    rng = np.random.default_rng(4)
    network = pseudo_likelihood.started([(k, 50 - k) for k in range(40)], 4000)
    w = {k: v.astype(np.float64) + rng.normal(0, 0.1, v.shape) for k, v in network.weights.items()}
    text, at = pseudo_likelihood.padded(rng.integers(0, 200, 30), np.array([0, 12, 12, 30]))
    g = pseudo_likelihood._gradients(w, text, at)
    for name in w:
        place = np.unravel_index(np.abs(g[name]).argmax(), w[name].shape)
        for sign in (1, -1):
            w[name][place] += sign * 1e-5
            loss = -pseudo_likelihood.log_probabilities(w, text, at).sum()
            w[name][place] -= sign * 1e-5
            up, down = (loss, 0) if sign > 0 else (up, loss)
        assert math.isclose((up - down) / 2e-5, g[name][place], rel_tol=1e-3, abs_tol=1e-5), name


def test_large_logits_do_not_overflow_and_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    network = pseudo_likelihood.started([(k, 900 - k) for k in range(800)], 900_000)
    w = {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in network.weights.items()}
    text, at = pseudo_likelihood.padded(rng.integers(0, pseudo_likelihood.WORDS, 3000), np.array([0, 1200, 3000]))
    found, steps = pseudo_likelihood.log_probabilities(w, text, at), pseudo_likelihood._gradients(w, text, at)
    monkeypatch.setattr(pseudo_likelihood, "BLOCK_CELLS", 1000)  # 15 places at once
    far = w | {f"{layer}_bias": w[f"{layer}_bias"] + np.float32(100) for layer in ("class", "word")}
    for weights in (w, far):  # the same to all words, but beyond what an exponential can be
        assert np.allclose(pseudo_likelihood.log_probabilities(weights, text, at), found, atol=1e-3)
        g = pseudo_likelihood._gradients(weights, text, at)
        assert all(np.allclose(g[name], steps[name], atol=1e-2) for name in steps)


def test_a_layer_is_worked_on_across_its_parts(monkeypatch):
    rng = np.random.default_rng(7)
    rows, h, number = rng.normal(0, 0.5, (30, pseudo_likelihood.WIDTH + 1)), rng.normal(0, 0.5, (50, pseudo_likelihood.WIDTH + 1)), rng.integers(0, 10, 50)
    h[:, -1] = 1
    parts = [(0, 3, slice(0, 10)), (3, 4, slice(10, 20)), (4, 50, slice(20, 30))]
    own = np.concatenate([np.tile(rows[r], (b - a, 1, 1)) for a, b, r in parts])  # the rows of each place
    share = np.exp(np.einsum("prw,pw->pr", own, h))
    share /= share.sum(axis=1, keepdims=True)
    off = share.copy()
    off[np.arange(50), number] -= 1
    weights = np.concatenate([off[a:b].T @ h[a:b] for a, b, _ in parts])
    back = np.einsum("pr,prw->pw", off, own)[:, :-1]
    for cells in (70, 1000):  # seven places at once, and all
        monkeypatch.setattr(pseudo_likelihood, "BLOCK_CELLS", cells)
        for shifted in (False, True):
            assert np.allclose(pseudo_likelihood._log_shares((rows, shifted), h, number, parts), np.log(share[np.arange(50), number]))
            found = pseudo_likelihood._gradients_of((rows, shifted), h, number, parts)
            assert np.allclose(found[0], weights) and np.allclose(found[1], back)


def test_weights_travel_many_in_a_row():
    for size in (31, 32, 33, 70_000):
        weights = {"a": np.arange(size, dtype=np.float32), "b": np.ones((3, 1), dtype=np.float32)}
        sums = pa.Table.from_batches(pseudo_likelihood._sent(weights, 5))
        assert sums.num_rows == (size + 3) // pseudo_likelihood.CELLS + 1
        found = pseudo_likelihood._averaged(sums.take(np.arange(sums.num_rows)[::-1]), weights)
        assert all((found[k] == weights[k]).all() for k in weights)


def test_a_round_averages_what_its_tasks_learn(spark):
    docs = spark.range(40, numPartitions=2).selectExpr("concat_ws(' ', transform(sequence(0, id * 3), i -> concat('w', i * id % 17))) as text")
    network = pseudo_likelihood.vocabulary(docs)
    learnt = []
    for texts in (docs.where(f"size(split(text, ' ')) {half} 60").toArrow()["text"].combine_chunks() for half in ("<", ">")):
        hashed, bounds = arrow_text.word_hashes(*arrow_text.text_bytes(texts))
        text, at = pseudo_likelihood.padded(network.words_of(hashed), bounds)
        learnt.append(pseudo_likelihood.Trainer(network.weights))
        learnt[-1].learn(text, at[pseudo_likelihood.drawn(hashed, bounds, 1)])
    found = pseudo_likelihood.trained(docs, network, 1)
    total = sum(t.places for t in learnt)
    assert learnt[0].places != learnt[1].places
    for name, values in found.weights.items():
        assert np.allclose(values, sum(t.weights[name] * (t.places / total) for t in learnt), atol=1e-5), name


def test_words_are_found_by_the_leading_bits_of_their_hashes():
    rng = np.random.default_rng(6)
    near = (np.uint64(7) << np.uint64(60)) + np.arange(40, dtype=np.uint64)  # all in one slot
    hashes = np.concatenate([near, rng.integers(0, 1 << 64, 2000, dtype=np.uint64), np.array([0, (1 << 64) - 1], dtype=np.uint64)])
    network = pseudo_likelihood.started([(int(h), 9) for h in hashes.view(np.int64)], 100_000)
    other = np.concatenate([near + np.uint64(50), rng.integers(0, 1 << 64, 500, dtype=np.uint64)])
    assert (network.words_of(hashes) == np.arange(len(hashes))).all()
    assert (network.words_of(other) == network.own + other.view(np.int64) % len(network.totals)).all()
    assert not len(network.words_of(hashes[:0]))


def test_language_model_learns_and_scores_every_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, None), (-1, ""), (-2, "the")], docs.schema)
    start = pseudo_likelihood.vocabulary(docs.select("text"))
    fitted = pseudo_likelihood.fitted(docs)
    before, after = (pseudo_likelihood.scored(docs.union(odd), n).toPandas() for n in (start, fitted))
    assert len(after) == 1003 and after.log_prob.sum() > before.log_prob.sum()
    assert set(after[after.n_tokens == 0].log_prob) == {0.0}
    both = pseudo_likelihood.log_probabilities(fitted.weights, *pseudo_likelihood.padded(np.array([5, 9, 7]), np.array([0, 3])))
    # every word of the vocabulary in one place: probabilities sum to one
    total = 0.0
    for word in range(pseudo_likelihood.WORDS):
        text, at = pseudo_likelihood.padded(np.array([5, word, 7]), np.array([0, 3]))
        total += math.exp(pseudo_likelihood.log_probabilities(fitted.weights, text, at[1:2])[0])
    assert len(both) == 3 and abs(total - 1) < 1e-3


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1)).withColumn("words", F.lit("w"))
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    clean = set(labels[(labels.quality == 1) & (labels.toxic == 0)].doc_id)
    folder, before = scratch.run_folder(spark), {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = scratch.stage(stage(spark, docs, SF), folder, f"s{k}")
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= set(before) and (k == 4 or after.columns == docs.columns)
        if k == 0:
            assert all(len(before[i].split()) < 50 for i in clean - ids)
        if k == 1:
            assert {i for i, *_ in near_groups(before)} == ids
        if k == 2:
            assert not after.where(F.col("text").rlike("AKIA[A-Z0-9]{16}|[0-9a-f]{24}") | (F.col("n_chars") != F.length("text"))).count()
        if k == 3:
            assert clean & set(before) <= ids | {i for i in clean if i not in before}
        if k == 4:
            assert after.where(F.size("ids") != F.col("n_tokens")).count() == 0 and after.count() == docs.count()
        docs, before = after, {r.doc_id: r.text for r in after.collect()} if k < 4 else {}


def test_pipeline_stages_on_odd_rows(spark, odd):
    sf, rows = odd
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("n_chars", F.length("text").cast("long"))
    run = {name: stage(spark, docs, sf) for name, stage in corpus_pipeline.STAGES}
    ids = {name: sorted((r.doc_id for r in found.select("doc_id").collect()), key=str) for name, found in run.items()}
    every = sorted((i for i, _ in rows), key=str)
    assert ids["quality rules"] == []  # all have fewer than 50 words or repeat themselves
    # blank texts are linked with nothing
    assert {80, 81, 82, 83} <= set(ids["MinHash near-dedup"])
    assert 84 not in ids["MinHash near-dedup"] and 1 in ids["MinHash near-dedup"]
    assert ids["secret scans"] == every and ids["BPE encoding and decoding"] == every
    masked = run["secret scans"]
    assert masked.columns == docs.columns and masked.where("text is null").count() == 1
    assert {i for i in range(40)} <= set(ids["mixing sources to target weights"]) <= set(every)
    assert {r.n_tokens for r in run["BPE encoding and decoding"].where("doc_id in (80, 81)").collect()} == {0}


def near_groups(texts):
    from test_minhash import brute_force

    return [(i, c) for i, (_, c, kept) in brute_force(texts.items()).items() if kept]
