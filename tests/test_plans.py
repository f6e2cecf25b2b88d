"""Physical plans: what must be in them, and what must not."""

import pytest
from conftest import plan_of

import __spark_entry__ as registered
from hrefwarden.functions import urls
from hrefwarden.operators import extract, queue, verdict
from hrefwarden.plans import audit, corpora
from hrefwarden.options import AuditOptions

SF = "/root/testdata/sf0.001"
PYTHON_NODES = ("ArrowEvalPython", "MapInPandas", "MapInArrow", "BatchEvalPython", "FlatMapGroups")
WITH_PYTHON = {"html_anchors_parser", "bib_urls", "bib_dois", "links_all_formats", "doi_queue", "distinct_dois", "prune_cached_dois",
               "classify_doi", "upsert_valid_dois", "html_malformed", "unsupported_documents"}
EAGER = {"link_audit", "link_audit_repeat", "stream_link_audit", "probe_map", "report_lines", "report_lines_plain", "errors_by_file_hot_urls", "errors_by_file_dealt_urls", "links_after_changes", "error_report_hot_files", "nested_error_report", "invalid_dois_by_file",
         "run_statistics", "prune_cached_links", "prune_counts"}


def lazy_names():
    return [n for n in registered.audit_queries() if n not in EAGER and not n.endswith(("_by_file", "_report"))]


@pytest.mark.parametrize("name", lazy_names())
def test_python_only_where_a_format_needs_it(spark, name):
    plan = plan_of(registered.queries()[name](spark, SF))
    assert any(node in plan for node in PYTHON_NODES) == (name in WITH_PYTHON)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_only_needed_columns_are_read(spark):
    assert "ReadSchema: struct<page_id:bigint,url:string>\n" in plan_of(registered.queries()["tex_href_links"](spark, SF))
    assert "html" not in plan_of(registered.queries()["normalize_url"](spark, SF))


def test_corpus_is_scanned_once_for_all_formats(spark):
    plan = plan_of(audit.read_findings(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("concat(doc_id, '.md') path", "text content"), AuditOptions()))
    assert plan.count("Scan parquet") == 2  # once in the tree, once in the details
    assert "Exchange" not in plan


def test_python_workers_get_only_their_formats(spark, docs):
    markdown_only = extract.findings(docs({"a.md": "x"}), (".md", ".tex"))
    assert not any(node in plan_of(markdown_only) for node in PYTHON_NODES)


def test_pruning_is_an_anti_join_and_reuses_the_shuffle(spark):
    targets = queue.url_targets(queue.link_queue(extract.markdown_links(corpora.markdown_corpus(spark, SF))))
    fresh = corpora.url_cache(spark, SF)
    pruned = queue.without_cached(targets, fresh, "normalized_url")
    answers = corpora.probe_log(spark, SF)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(verdict.url_verdicts(pruned, answers, corpora.AS_OF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "LeftAnti" in plan
    # corpus, targets, cache and log are shuffled once each; neither join shuffles again
    assert sum(line.strip().startswith("(") and ") Exchange" in line for line in plan.splitlines()) == 4


def test_normalising_stays_in_generated_code(spark):
    plan = plan_of(urls.with_normalized_url(corpora.pages(spark, SF)))
    projects = [line for line in plan.splitlines() if line.startswith("(") and ") Project" in line]
    assert projects and all("codegen id" in line for line in projects)


def test_distinct_urls_aggregate_before_the_shuffle(spark):
    plan = plan_of(registered.queries()["distinct_urls"](spark, SF))
    tree = plan.split("\n\n")[0]
    assert tree.count("HashAggregate") >= 2


@pytest.mark.parametrize("name", ["errors_by_file_hot_urls", "error_report_hot_files"])
def test_hot_queries_take_both_ways(spark, name):
    frame = registered.queries()[name](spark, SF)
    assert "Union" in plan_of(frame) and frame.count() > 0


def test_hot_keys_too_many_to_broadcast_are_dealt(spark):
    from hrefwarden.operators import report, spread

    judged = registered._Judged(spark, SF)
    hot = judged.hot(min_rows=2, max_bytes=0)
    assert hot.fans is not None and spread.hot_keys(judged.verdicts, "normalized_url", "n_links") is None
    plan = plan_of(report.defects(judged.queue, judged.verdicts, hot))
    assert "_part" in plan and "Union" not in plan


def test_native_formats_do_not_pass_the_python_node(spark):
    """What the worker's node is given are paths, what was found already, and texts of its own formats."""
    docs = spark.createDataFrame([("a.md", "[t](http://u)")], "path string, content string")
    plan = plan_of(extract.findings(docs))
    node = plan.split("ArrowEvalPython\nInput [")[1].split("\n")[0]
    assert "content#" not in node and "html#" in node and "bibtex#" in node and "found#" in node


def test_few_targets_leave_a_large_cache_where_it_is(spark):
    from hrefwarden import scratch

    folder = scratch.run_folder(spark)
    cached = scratch.stage(spark.range(400_000).selectExpr("concat('http://e.example.com/a/path/', id, '/', sha2(string(id), 256)) normalized_url"), folder, "cache")
    targets = scratch.stage(spark.createDataFrame([("http://e.example.com/a/path/1", 1)], "normalized_url string, n_links long"), folder, "targets")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    try:
        plan = plan_of(queue.known_keys(cached, targets, "normalized_url"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
