import datetime as dt
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from conftest import plan_of

from hrefwarden.functions import fixed
from hrefwarden.operators import queue
from hrefwarden.sources import cache, documents, files

NOW = dt.datetime(2024, 5, 1, 12, tzinfo=dt.timezone.utc)


@pytest.fixture
def tree(tmp_path):
    for name in (
        "a.tex", "b.md", "c.html", "d.htm", "no.txt",
        "sub/e.tex", "sub/f.md", "sub/noextension", "sub/g.htmlandmore", "sub/sub/h.bib",
        "_posts/i.md", ".hidden/j.md", "sub/_k.md", ".md", "with space/ü.md",
    ):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"<http://example.com/{name}>")
    (tmp_path / "folder.md").mkdir()
    return tmp_path


def names(df, base):
    return sorted(os.path.relpath(r["path"], base) for r in df.select("path").collect())


def test_discovery_takes_hidden_files_and_no_folders(spark, tree):
    found = names(files.list_files(spark, str(tree)), tree)
    assert found == sorted(
        ["a.tex", "b.md", "c.html", "d.htm", "sub/e.tex", "sub/f.md", "sub/sub/h.bib", "_posts/i.md", ".hidden/j.md", "sub/_k.md", "with space/ü.md"]
    )
    assert names(files.find_html_files(spark, str(tree)), tree) == ["c.html", "d.htm"]
    assert names(files.find_tex_files(spark, str(tree)), tree) == ["a.tex", "sub/e.tex"]
    assert len(names(files.find_markdown_files(spark, str(tree)), tree)) == 6


def test_folders_named_by_uri(spark, tree):
    """The way of remote file systems, tried on a local one."""
    found = {path: is_dir for path, is_dir, *_ in files._children(f"file://{tree}/sub")}
    assert found[f"file://{tree}/sub/f.md"] is False and found[f"file://{tree}/sub/sub"] is True
    assert files.read_one(f"file://{tree}/b.md") == ("<http://example.com/b.md>", None)
    assert files.read_one(f"file://{tree}/none.md") == (None, fixed.NOT_FOUND)
    assert files.absolute(f"file:{tree}") == files.absolute(f"file://{tree}") == str(tree)
    assert files.absolute("hdfs://host:8020/a/") == "hdfs://host:8020/a"


def test_what_goes_wrong_with_a_file_is_a_row(spark, tmp_path):
    (tmp_path / "good.md").write_bytes("één\r\ntwo\rthree\n".encode())
    (tmp_path / "bad.md").write_bytes(b"ab\xff")
    (tmp_path / "empty.md").write_bytes(b"")
    os.symlink(tmp_path / "gone", tmp_path / "dangling.md")
    got = {os.path.basename(r["path"]): r for r in files.open_path(spark, str(tmp_path)).collect()}
    assert got["good.md"]["content"] == "één\ntwo\nthree\n" and got["good.md"]["problem"] is None
    assert "invalid start byte" in got["bad.md"]["problem"] and got["bad.md"]["content"] is None
    assert got["dangling.md"]["problem"] == fixed.NOT_FOUND
    assert got["empty.md"]["content"] == "" and got["empty.md"]["problem"] is None
    problems = documents.access_errors(files.open_path(spark, str(tmp_path)))
    assert problems.count() == 2


@pytest.mark.parametrize(
    "error, problem",
    [
        (FileNotFoundError(), "file not found"),
        (PermissionError(), "permission error"),
        (TimeoutError(), "system timeout"),
        (BlockingIOError(), "blocking IO"),
        (OSError("odd"), "odd"),
    ],
)
def test_names_of_read_problems(monkeypatch, error, problem):
    def fail(path):
        raise error

    monkeypatch.setattr(files, "_opened", fail)
    assert files.read_one("x.md") == (None, problem)


def test_paths_that_cannot_be_checked(spark, tmp_path, caplog):
    with pytest.raises(FileNotFoundError):
        files.open_path(spark, str(tmp_path / "none.tex"))
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError):
        files.open_path(spark, str(tmp_path / "a.txt"))
    assert files.open_path(spark, str(tmp_path)) is None
    assert "holds no file to audit" in caplog.text
    (tmp_path / "b.md").write_text("x")
    assert files.open_path(spark, str(tmp_path / "b.md")).first()["content"] == "x"


def test_bytes_of_a_table(spark):
    raw = spark.createDataFrame([("a.md", b"ok"), ("b.md", b"\xff"), ("c.md", None)], "path string, data binary")
    got = {r["path"]: (r["content"], r["problem"]) for r in documents.decoded(raw).collect()}
    assert got == {"a.md": ("ok", None), "b.md": (None, fixed.NOT_UTF8), "c.md": (None, None)}


def test_cache_entries_exactly_as_old_as_the_limit_are_stale(spark):
    ages = [0, 23, 24, 25]
    rows = spark.createDataFrame([(f"u{h}", NOW - dt.timedelta(hours=h)) for h in ages], cache.URL_SCHEMA)
    assert sorted(r[0] for r in cache.fresh_urls(rows, 24, NOW).collect()) == ["u0", "u23"]
    just_under = spark.createDataFrame([("u", NOW - dt.timedelta(hours=24) + dt.timedelta(seconds=1))], cache.URL_SCHEMA)
    assert cache.fresh_urls(just_under, 24, NOW).count() == 1


def test_cache_bound_reaches_the_parquet_scan(spark, tmp_path):
    path = str(tmp_path / "cache")
    urls = spark.createDataFrame([("u", NOW)], cache.URL_SCHEMA)
    cache.replace(path, cache.load(spark, path), urls, spark.createDataFrame([], cache.DOI_SCHEMA), "r1")
    plan = plan_of(cache.fresh_urls(cache.load(spark, path).urls, 24, NOW))
    assert "GreaterThan(last_valid" in plan


def test_cache_slots_take_turns(spark, tmp_path):
    path = str(tmp_path / "cache")
    dois = spark.createDataFrame([("d", NOW)], cache.DOI_SCHEMA)
    state = cache.load(spark, path)
    assert state.version == 0 and state.urls.count() == 0 and state.dois.count() == 0
    for n in range(1, 5):
        # The new content is made from the old one, which is read while the new is written.
        urls = state.urls.unionByName(spark.createDataFrame([(f"u{n}", NOW)], cache.URL_SCHEMA))
        cache.replace(path, state, urls, dois, f"run{n}")
        state = cache.load(spark, path)
        assert (state.version, state.run_key, state.urls.count()) == (n, f"run{n}", n)
    assert sorted(os.listdir(path)) == ["a", "b"]


def test_added_versions_count_once_marked(spark, tmp_path):
    path = str(tmp_path / "cache")
    none = spark.createDataFrame([], cache.DOI_SCHEMA)

    def url(name):
        return spark.createDataFrame([(name, NOW)], cache.URL_SCHEMA)

    for n in range(3):
        state = cache.load(spark, path)
        cache.add(path, state, url(f"u{n}"), none, f"batch{n}")
    state = cache.load(spark, path)
    assert (state.slot, state.version, state.depth, state.run_key) == ("a", 3, 3, "batch2")
    assert sorted(r[0] for r in state.urls.collect()) == ["u0", "u1", "u2"]
    # A batch that broke before its marker does not count; run again, it overwrites what it left.
    url("junk").write.parquet(f"{path}/a/urls/v=4/b=0")
    assert cache.load(spark, path).urls.count() == 3
    cache.add(path, cache.load(spark, path), url("u3"), none, "batch3")
    assert sorted(r[0] for r in cache.load(spark, path).urls.collect()) == ["u0", "u1", "u2", "u3"]
    state = cache.load(spark, path)
    cache.replace(path, state, state.urls, none, "run")
    state = cache.load(spark, path)
    assert (state.slot, state.version, state.depth, state.urls.count()) == ("b", 5, 1, 4)
    # The slot that was left is replaced as a whole the next time.
    cache.replace(path, state, url("only"), none, "run2")
    assert [r[0] for r in cache.load(spark, path).urls.collect()] == ["only"]


def test_broken_write_leaves_the_cache_in_force(spark, tmp_path):
    path = str(tmp_path / "cache")
    none = spark.createDataFrame([], cache.DOI_SCHEMA)
    cache.replace(path, cache.load(spark, path), spark.createDataFrame([("u1", NOW)], cache.URL_SCHEMA), none, "r1")
    # A second run dies after its URLs and before its marker.
    spark.createDataFrame([("junk", NOW)], cache.URL_SCHEMA).write.parquet(f"{path}/b/urls")
    state = cache.load(spark, path)
    assert (state.slot, [r[0] for r in state.urls.collect()]) == ("a", ["u1"])


def test_cache_path_is_checked_before_the_run(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    with pytest.raises(ValueError):
        cache.check_path(spark, str(tmp_path / "file"))
    with pytest.raises(ValueError):
        cache.check_path(spark, str(tmp_path / "missing" / "cache"))
    cache.check_path(spark, str(tmp_path / "cache"))
    cache.check_path(spark, str(tmp_path))
    assert cache.load(spark, None).version == 0


def test_a_folder_that_cannot_be_listed_is_a_row(spark, tmp_path, monkeypatch):
    def fail(folder):
        raise PermissionError(13, "no")
        yield

    monkeypatch.setattr(files, "_children", fail)
    batch = pa.RecordBatch.from_pydict({"path": ["/a/b"]})
    [listed] = files._list_folders([batch])
    assert listed.to_pylist()[0]["path"] == "/a/b" and "cannot be listed" in listed.to_pylist()[0]["problem"]
    read = files.read_files(spark.createDataFrame([("/a/b", 0, "p")], "path string, size long, problem string"))
    assert [tuple(r) for r in read.collect()] == [("/a/b", None, "p", None)]


def test_a_small_batch_reads_few_buckets(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    monkeypatch.setattr(cache, "BUCKET_ROWS", 10)
    many = spark.range(400).select(F.concat(F.lit("http://e/"), F.col("id").cast("string")).alias("normalized_url"), F.lit(NOW).alias("last_valid"))
    none = spark.createDataFrame([], cache.DOI_SCHEMA)
    cache.replace(path, cache.load(spark, path), many, none, "r1")
    state = cache.load(spark, path)
    assert (state.buckets, state.n_rows) == (1, 400)
    cache.replace(path, state, state.urls, none, "r2")
    state = cache.load(spark, path)
    assert (state.buckets, state.n_rows, state.urls.columns) == (40, 400, ["normalized_url", "last_valid"])
    cache.add(path, state, spark.createDataFrame([("http://new/", NOW)], cache.URL_SCHEMA), none, "r3")
    state = cache.load(spark, path)
    assert (state.buckets, state.n_rows, state.depth) == (40, 401, 2)
    batch = spark.createDataFrame([("http://e/7",), ("http://new/",), ("http://e/none",)], "normalized_url string")
    held = cache.holding(state, "urls", batch)
    plan = plan_of(held)
    assert "PartitionFilters: [" in plan and "b#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert 2 <= held.count() <= 60
    assert held.select(F.input_file_name()).distinct().count() <= 4 < state.urls.select(F.input_file_name()).distinct().count()
    assert sorted(r[0] for r in queue.known_keys(held, batch, "normalized_url").collect()) == ["http://e/7", "http://new/"]
    assert cache.holding(state, "urls", batch.limit(0)).collect() == []
    assert sorted(r[0] for r in state.urls.collect()) == sorted([r[0] for r in many.collect()] + ["http://new/"])


def test_a_flat_folder_is_shared_out_by_name(spark, tmp_path, monkeypatch):
    names = [f"{k:05}.md" for k in range(3000)]
    for k, name in enumerate(names):
        (tmp_path / name).write_bytes(b"x" * (k % 7))
    (tmp_path / "dangling.md").symlink_to(tmp_path / "none")
    listing = files.list_files(spark, str(tmp_path))
    expected = {(f"{tmp_path}/{name}", k % 7) for k, name in enumerate(names)} | {(f"{tmp_path}/dangling.md", 0)}
    assert {(r["path"], r["size"]) for r in listing.collect()} == expected
    unsized = listing.withColumn("size", F.lit(None).cast("long"))
    shared = files.with_sizes(unsized, names_per_task=500)
    by_task = shared.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.min("path").alias("a"), F.max("path").alias("b"))
    ranges = sorted((r["a"], r["b"], r["n"]) for r in by_task.collect() if r["n"])
    assert len(ranges) == 7 and all(n < 900 for *_, n in ranges) and all(x[1] < y[0] for x, y in zip(ranges, ranges[1:]))
    assert {(r["path"], r["size"]) for r in shared.collect()} == expected


def test_uris_take_names_as_they_are_and_open_one_client(tmp_path):
    folder = tmp_path / "a b"
    folder.mkdir()
    odd = ["h#1.md", "q?1.md", "p%41.md", "ü.md"]
    for name in odd:
        (folder / name).write_text(name)
    files._store.cache_clear()
    found = sorted(path for path, is_dir, *_ in files._children(f"file://{folder}") if not is_dir)
    assert found == sorted(f"file://{folder}/{name}" for name in odd)
    assert [files.read_one(path) for path in found] == [(path.rpartition("/")[2], None) for path in found]
    assert files._store.cache_info().misses == 1


def test_a_scheme_nothing_opens_fails_before_any_job(spark):
    with pytest.raises(ValueError, match="no file system"):
        files.list_files(spark, "nosuch://host/tree")
