"""The audit on documents that arrive as a stream.

Every micro-batch is one audit against the cache the batch before it left, so
URLs seen valid within the limit are not asked again, however many batches link
to them. A batch adds its finds to the cache; every ``replace_every`` batches
the cache is written anew without its stale rows. Tables are written per batch under its number and the cache remembers
the batch that wrote it; a batch that is run again overwrites its own tables or,
if it had finished, does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from hrefwarden import scratch
from hrefwarden.options import AuditOptions
from hrefwarden.plans import audit


def audit_stream(
    documents: DataFrame,
    options: AuditOptions,
    out: str,
    probe_log: DataFrame | None = None,
    doi_log: DataFrame | None = None,
    name: str = "audit",
    trigger: dict | None = None,
    replace_every: int = 100,
) -> StreamingQuery:
    """Start auditing the stream ``documents(path, content)``; tables go to ``out``.

    The default trigger takes what is there and stops. Leave ``options.as_of``
    open in a stream that runs on, so that each batch has its own time.
    """
    if not options.cache_path:
        raise ValueError("a stream needs a cache_path: the cache is its state")

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        done = audit.run_audit(
            batch.sparkSession,
            batch,
            options,
            probe_log,
            doi_log,
            folder=out,
            run_key=f"{name}:{batch_id}",
            batch=f"/batch={batch_id}",
            add_to_cache=replace_every,
        )
        if done is not None:  # what only the batch itself needed
            for table in audit.PASSING:
                scratch.release(batch.sparkSession, f"{out}/{table}/batch={batch_id}")

    return (
        documents.writeStream.foreachBatch(run_batch)
        .option("checkpointLocation", f"{out}/progress")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def batches_of(spark: SparkSession, out: str, table: str) -> DataFrame:
    """One of the tables of a stream over all its batches, with the batch number."""
    return spark.read.parquet(f"{out}/{table}")
