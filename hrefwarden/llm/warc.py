"""WARC archives compressed record by record with a dictionary of their own.

A Zstandard dictionary is trained on a bounded sample of the records; every archive
carries it in a leading skippable frame, so that it can be read alone, and each
record is a frame of its own. Of equal payloads of some length one is stored and
the others become revisit records. Archives are written by tasks through the file
system of the shared folder, under a temporary name until they are whole.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefwarden import scratch
from hrefwarden.llm import words as W

#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: An archive is closed once it has this many compressed bytes.
ARCHIVE_BYTES = 64 << 20
#: Most records, and most of the first bytes of one, that the dictionary is trained on; and its size.
SAMPLE_RECORDS, SAMPLE_RECORD_BYTES, DICTIONARY_BYTES = 600, 64 << 10, 48 << 10
LEVEL = 3

# --- fixed values: the format's own
_DICTIONARY_FRAME = 0x184D2A5D
_ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
#: Pages come without the time of their fetch.
UNDATED = "1970-01-01T00:00:00Z"

_READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def file_system(uri: str):
    from pyarrow import fs

    for alias in ("s3a://", "s3n://"):
        uri = uri.replace(alias, "s3://", 1) if uri.startswith(alias) else uri
    return fs.FileSystem.from_uri(uri)


def planned(pages: DataFrame, folder: str) -> DataFrame:
    """(page_id, digest, payload_bytes, record_type, refers_to), one row for each page_id and payload.

    Of equal payloads of ``REVISIT_BYTES`` or more, that of the largest page_id is the
    response. A null html is an empty payload. Rows that repeat it are responses too.
    """
    payload = W.whole(F.col("html")).cast("binary")
    light = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    light = scratch.stage(light.distinct(), folder, "digests")
    copies = light.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("digest", "payload_bytes")
    kept = copies.agg(F.max("page_id").alias("kept_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = light.join(kept, ["digest", "payload_bytes"], "left")
    revisits = F.col("kept_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept_id"))
    return rows.select(
        "page_id",
        "digest",
        "payload_bytes",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("kept_id")).alias("refers_to"),
    )


def trained_dictionary(pages: DataFrame, plan: DataFrame) -> bytes:
    """A dictionary of the responses' records; empty where there is nothing to train on.

    The sample is that of the least hashes of the page_id, at most ``SAMPLE_RECORDS``
    records of any size, of whose payload it has the first ``SAMPLE_RECORD_BYTES``; the
    driver trains on it.
    """
    fit = plan.where((F.col("record_type") == "response") & (F.col("payload_bytes") > 0))
    chosen = fit.select("page_id", F.xxhash64("page_id", "digest").alias("h")).orderBy("h").limit(SAMPLE_RECORDS)
    ids = [row.page_id for row in chosen.collect() if row.page_id is not None]
    piece = F.substring(W.whole(F.col("html")).cast("binary"), 1, SAMPLE_RECORD_BYTES)
    rows = pages.where(F.col("page_id").isin(ids)).select("page_id", "url", piece.alias("piece"))
    samples = [_record(r.page_id, r.url, bytes(r.piece), None, None, 0) for r in rows.limit(SAMPLE_RECORDS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too small
        return b"".join(samples)[:DICTIONARY_BYTES]


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    name = record_id.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def _record(page_id, url, payload: bytes, digest: str | None, refers_to: int | None, payload_bytes: int) -> bytes:
    """One record, uncompressed; with ``refers_to`` a revisit, whose block is the response's head alone."""
    digest = digest or hashlib.sha1(payload).hexdigest()
    head = _HTTP.format(payload_bytes if refers_to is not None else len(payload)).encode()
    block = head if refers_to is not None else head + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {UNDATED}",
        *([f"WARC-Target-URI: {url.replace('%', '%25').replace(chr(13), '%0D').replace(chr(10), '%0A')}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {_PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary_frame(dictionary: bytes) -> bytes:
    if not dictionary:
        return b""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return _DICTIONARY_FRAME.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed


def written(pages: DataFrame, plan: DataFrame, dictionary: bytes, folder: str) -> DataFrame:
    """Write the archives; (path, records) of each."""
    rows = pages.select("page_id", "url", W.whole(F.col("html")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    rows = rows.join(plan.withColumnsRenamed({"page_id": "planned_id", "digest": "planned"}), F.col("page_id").eqNullSafe(F.col("planned_id")) & (F.col("digest") == F.col("planned")))
    rows = rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "digest", "refers_to", "payload_bytes")
    shared = pages.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(folder)
        files.create_dir(root, recursive=True)
        records = (row for batch in batches for row in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True))
        for path, n in _archives(files, root, records, shared.value):
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})

    return scratch.stage(rows.mapInArrow(run, "path string, records long"), folder, "manifest")


def _archives(files, root: str, records, dictionary: bytes) -> Iterator[tuple[str, int]]:
    context = TaskContext.get()
    task, attempt = context.partitionId(), context.taskAttemptId()
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=True, write_content_size=True)
    lead = _dictionary_frame(dictionary)
    out, number = None, -1
    for page_id, url, html, digest, refers_to, payload_bytes in records:
        if out is None:
            number += 1
            name = f"archive-{task:06d}-{number:04d}.warc.zst"
            hidden = f"{root}/_writing-{attempt}-{name}"
            out, n, size = files.open_output_stream(hidden, compression=None), 0, 0
            out.write(lead)
        frame = packer.compress(_record(page_id, url, (html or "").encode(), digest, refers_to, payload_bytes))
        out.write(frame)
        n, size = n + 1, size + len(frame)
        if size >= ARCHIVE_BYTES:
            out.close()
            files.move(hidden, f"{root}/{name}")
            yield name, n
            out = None
    if out is not None:
        out.close()
        files.move(hidden, f"{root}/{name}")
        yield name, n


def _frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends, from its blocks' sizes."""
    magic = int.from_bytes(data[at : at + 4], "little")
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        return at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    head = data[at : at + 18]
    checked = zstandard.get_frame_parameters(head).has_checksum
    at += zstandard.frame_header_size(head)
    last = 0
    while not last:
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind = block & 1, block >> 1 & 3
        at += 3 + (1 if kind == 1 else block >> 3)
    return at + 4 * checked


def frames(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, uncompressed; its dictionary is taken from its leading frame."""
    data, at = memoryview(archive), 0
    unpacker = zstandard.ZstdDecompressor()
    while at < len(data):
        end = _frame_end(data, at)
        if int.from_bytes(data[at : at + 4], "little") == _DICTIONARY_FRAME:
            dictionary = bytes(data[at + 8 : end])
            if dictionary[:4] == _ZSTD_MAGIC:
                dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
            unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        elif data[at : at + 4] == _ZSTD_MAGIC:
            yield unpacker.decompress(data[at:end])
        at = end


def parsed(record: bytes) -> tuple:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    url = fields.get("WARC-Target-URI")
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    page_id = _page_id(fields["WARC-Record-ID"])
    if fields["WARC-Type"] == "revisit":
        lengths = [line for line in http.decode().split("\r\n") if line.startswith("Content-Length: ")]
        return page_id, url, "revisit", int(lengths[0][16:]), digest, _page_id(fields["WARC-Refers-To"]), None
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return page_id, url, "response", len(payload), digest, None, payload


def read(spark: SparkSession, manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archives a manifest lists, one task an archive as far as there are tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(folder)
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
             ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
        )
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_stream(os.path.join(root, name), compression=None) as file:
                    archive = file.read()
                rows, size = [], 0
                for record in frames(archive):
                    row = parsed(record)
                    rows.append(row if payloads else (*row[:6], None))
                    size += len(record) if payloads else 100
                    if size > 4 << 20:
                        yield _rows(rows, schema)
                        rows, size = [], 0
                yield _rows(rows, schema)

    spread = manifest.select("path").repartition(max(1, min(manifest.count(), 100_000)))
    return spread.mapInArrow(run, _READ)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages(page_id, url, html) as archives below ``folder``; the manifest."""
    plan = scratch.stage(planned(pages, folder), folder, "plan")
    return written(pages, plan, trained_dictionary(pages, plan), folder)


def op9_warc(spark, sf_dir) -> DataFrame:
    """Every page as read back from the archives it was written to."""
    pages = W.table(spark, sf_dir, "pages")
    folder = W.workspace(spark)
    rows = read(spark, archive(pages, folder), folder, payloads=False)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
placed AS (
  SELECT page_id, html, payload_bytes,
    CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS kept_id FROM payloads)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN page_id = kept_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> kept_id THEN kept_id END AS refers_to
FROM placed"""
