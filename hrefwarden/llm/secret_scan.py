"""Secret scans over an incremental ledger of blobs.

Every historical version of every path is content-addressed by the SHA-256 of its
text. The ledger holds which (blob, rule, rule version) pairs have been scanned
and what was found. A scan looks only at the pairs the ledger lacks, once per
blob however many paths and versions carry it, and joins the findings back to all
of them. Everything runs as DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hrefwarden import scratch
from hrefwarden.llm import words as W


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates, leftmost and non-overlapping; one counts if ``group`` of it has ``min_chars`` characters.

    A changed pattern needs a new ``version``: the ledger then scans its blobs again.
    """

    name: str
    version: int
    pattern: str
    group: int
    min_chars: int


# --- fixed values: the base rules
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)
MASK = "[SECRET]"


def blob_id(text: Column) -> Column:
    return F.sha2(W.whole(text).cast("binary"), 256)


class Ledger:
    """Two tables in a shared folder, added to by every scan: ``scanned`` pairs and ``findings``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        if scratch.path_kind(self.spark, path) is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def is_new(self) -> bool:
        return scratch.path_kind(self.spark, f"{self.folder}/scanned") is None

    def scanned(self) -> DataFrame:
        return self._read("scanned", "blob string, rule string, version int").dropDuplicates()

    def findings(self) -> DataFrame:
        found = self._read("findings", "blob string, rule string, version int, start long, end long")
        return found.dropDuplicates()

    def add(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/{name}")


def scan(versions: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES, text: str = "text") -> None:
    """Bring the ledger up to date with ``versions`` under ``rules``.

    Findings are written before the pairs are marked, so a run that dies between
    the two scans them again and adds equal findings, which reading folds. A null
    text is the empty blob.
    """
    blobs = versions.select(blob_id(F.col(text)).alias("blob"), W.whole(F.col(text)).alias("text"))
    every = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    if ledger.is_new():
        waiting = None
        pending = blobs.groupBy("blob").agg(F.first("text").alias("text")).withColumn("due", every)
    else:
        current = " or ".join(f"(rule = '{r.name}' and version = {r.version})" for r in rules)
        seen = ledger.scanned().where(current).groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("seen"))
        due = F.array_except(every, F.coalesce("seen", F.array().cast("array<struct<rule:string,version:int>>")))
        waiting = blobs.select("blob").distinct().join(seen, "blob", "left").select("blob", due.alias("due")).where(F.size("due") > 0)
        waiting = scratch.stage(waiting, scratch.run_folder(ledger.spark), "due")
        pending = blobs.join(waiting.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text")).join(waiting, "blob")
    ledger.add("findings", _findings(pending, rules))
    marked = blobs.select("blob").distinct().withColumn("due", every) if waiting is None else waiting
    ledger.add("scanned", marked.select("blob", F.inline("due")))


def _findings(pending: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(blob, rule, version, start, end) of the due rules; pending: (blob, text, due)."""
    parts = pending.withColumns({f"hits_{k}": _hits(rule) for k, rule in enumerate(rules)})
    tagged = [F.transform(f"hits_{k}", _tagged_by(rule)) for k, rule in enumerate(rules)]
    rows = parts.select("blob", F.inline(F.concat(*tagged)))
    so_far = Window.partitionBy("blob", "rule", "version").orderBy("nth")
    ends = rows.withColumn("end", F.sum(F.col("gap") + F.col("chars")).over(so_far).cast("long"))
    return ends.where("ok").select("blob", "rule", "version", (F.col("end") - F.col("chars")).cast("long").alias("start"), "end")


def _tagged_by(rule: Rule):
    def tagged(hit, nth):
        name = F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version")
        return F.struct(*name, nth.alias("nth"), *[hit[part].alias(part) for part in ("gap", "chars", "ok")])

    return tagged


def _hits(rule: Rule) -> Column:
    """Every match: the characters since the last one's end, its own, and whether it counts.

    What lies between matches is what splitting at the pattern leaves; both follow one matcher.
    """
    text, pattern = F.col("text"), rule.pattern
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    group = (lambda m: m) if rule.group == 0 else (lambda m: F.regexp_extract(m, pattern, rule.group))
    hits = F.zip_with(
        found,
        F.slice(between, 1, F.size(found)),
        lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("chars"), (F.length(group(m)) >= rule.min_chars).alias("ok")),
    )
    due = F.exists("due", lambda d: (d["rule"] == rule.name) & (d["version"] == rule.version))
    none = F.array().cast("array<struct<gap:int,chars:int,ok:boolean>>")
    return F.when(due & text.rlike(pattern), hits).otherwise(none)


def by_blob(ledger: Ledger, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, spans): the findings of a blob under these rules by start, then rule order; blobs without are left out."""
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(f"{r.name}@{r.version}"), F.lit(k))])
    found = ledger.findings().withColumn("nth", order[F.concat_ws("@", "rule", "version")]).where(F.col("nth").isNotNull())
    return found.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "nth", "end", "rule"))).alias("spans"))


def findings_of(versions: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """``versions`` without its text, with ``blob`` and ``spans`` (null where nothing was found): one row for each."""
    addressed = versions.withColumn("blob", blob_id(F.col(text))).drop(text)
    return addressed.join(by_blob(ledger, rules), "blob", "left")


def redacted(versions: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """``versions`` with every found span replaced by a mask; overlapping spans are one. Columns stay as they are."""
    names = versions.columns
    blob, spans = "__blob", "__spans"
    found = by_blob(ledger, rules).withColumnsRenamed({"blob": blob, "spans": spans})
    rows = versions.withColumn(blob, blob_id(F.col(text))).join(found, blob, "left")
    empty = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("upto"))

    def cut(so_far, span):
        begin = F.greatest(so_far["upto"], span["start"])
        piece = F.substring(F.col(text), (so_far["upto"] + 1).cast("int"), (begin - so_far["upto"]).cast("int"))
        masked = F.when(span["end"] <= so_far["upto"], so_far["done"]).when(
            span["start"] < so_far["upto"], so_far["done"]
        ).otherwise(F.concat(so_far["done"], piece, F.lit(MASK)))
        return F.struct(masked.alias("done"), F.greatest(so_far["upto"], span["end"]).alias("upto"))

    def close(so_far):
        return F.concat(so_far["done"], F.substring(F.col(text), (so_far["upto"] + 1).cast("int"), F.length(F.col(text))))

    clean = F.when(F.col(spans).isNull(), F.col(text)).otherwise(F.aggregate(F.col(spans), empty, cut, close))
    return rows.withColumn(text, clean).select(*names)


def _is(name: str):
    return lambda span: span["rule"] == name


def op1_secret_scans(spark, sf_dir) -> DataFrame:
    """Secrets of every document, each the one version of the path its doc_id names.

    The ledger is new here, so every distinct text is scanned under every rule. The
    method adds no spans to the base ones. Rows that repeat give equal results.
    """
    docs = W.table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = Ledger(spark, f"{W.workspace(spark)}/ledger")
    scan(docs, ledger)
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,nth:int,end:bigint,rule:string>>"))
    joined = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter(spans, _is(rule.name))).cast("long").alias(f"n_{rule.name}") for rule in RULES]
    rows = findings_of(docs, ledger).select("doc_id", *counts, joined.alias("spans"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"), "spans")


_KEYS = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_ASSIGN = _KEYS + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _found(kind: str, nth: int, pattern: str, ok: str) -> str:
    return f"""
  SELECT row_id, '{kind}' AS kind, {nth} AS nth, begins AS begin, begins + length(hit) AS finish
  FROM (SELECT row_id, unnest(hits) AS hit, unnest(list_transform(range(1, len(hits) + 1), lambda i:
      coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0)
    )) AS begins
    FROM (SELECT row_id, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM docs))
  WHERE {ok}"""


SQL = (
    "WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents), spans AS ("
    + " UNION ALL ".join(
        (
            _found("assign", 0, _ASSIGN, f"length(regexp_extract(hit, '{_ASSIGN}', 2)) >= 6"),
            _found("access", 1, "AKIA[A-Z0-9]+", "length(hit) >= 20"),
            _found("hex", 2, "[0-9a-f]+", "length(hit) >= 24"),
        )
    )
    + """), joined AS (
  SELECT row_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
    string_agg(kind || ':' || begin::BIGINT || ':' || finish::BIGINT, ',' ORDER BY begin, nth) AS spans
  FROM spans GROUP BY row_id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (row_id)"""
)
