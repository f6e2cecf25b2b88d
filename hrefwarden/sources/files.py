"""Documents that are files in a folder tree.

Spark's own file source leaves out names that begin with '.' or '_' and stops
the job on a file it cannot read. A link audit needs both kinds, so the tree is
listed and read by tasks: each round lists the folders found by the round
before, and what goes wrong with a file becomes a row.
"""

from __future__ import annotations

import contextlib
import functools
import io
import logging
import os
import pathlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefwarden import scratch
from hrefwarden.functions import fixed, urls
from hrefwarden.sources import parts

LISTING = "path string, is_dir boolean, size long, modified long, problem string"
SIZED = "path string, size long, modified long, problem string"
READ = "path string, content string, problem string, part int"
NAMES_PER_BATCH, NAMES_PER_TASK = 10_000, 10_000
BYTES_PER_BATCH = 32 * 1024 * 1024
BYTES_PER_TASK = 128 * 1024 * 1024
#: Files from this size on are read in parts.
PART_BYTES = 256 * 1024 * 1024

log = logging.getLogger(__name__)


# --- fixed values: other names of the same store
_SAME_STORE = {"s3a": "s3", "s3n": "s3"}
_URI = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):(?=/)(?://([^/]*))?(.*)", re.DOTALL)


def _is_local(path: str) -> bool:
    return not _URI.fullmatch(path)


@functools.lru_cache(maxsize=64)
def _store(scheme: str, authority: str):
    """The file system of a scheme and authority and its root there; one client of each in a process."""
    from pyarrow import fs

    scheme = _SAME_STORE.get(scheme.lower(), scheme.lower())
    try:
        return fs.FileSystem.from_uri(f"{scheme}://{authority}/" if scheme == "file" else f"{scheme}://{authority}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as error:
        raise ValueError(f"no file system for {scheme}: here ({error})") from error


def open_store(path: str):
    """(file system, path on it); names are taken as they are and never read as parts of a URI."""
    scheme, authority, rest = _URI.fullmatch(path).groups()
    store, root = _store(scheme, authority or "")
    return store, (root.rstrip("/") + "/" + rest.lstrip("/")).rstrip("/") or "/"


def absolute(path: str) -> str:
    """Local paths in full, so that reports can put a URL in their place."""
    path = re.sub("^file:(//)?", "", str(path))
    return str(pathlib.Path(path).resolve()) if _is_local(path) else path.rstrip("/")


def _children(folder: str) -> Iterator[tuple[str, bool, int | None, int | None]]:
    """(path, whether a folder, size, time of change) of what a folder holds; of a local file size and time are not asked here."""
    if _is_local(folder):
        with os.scandir(folder) as entries:
            for entry in entries:
                is_dir = entry.is_dir(follow_symlinks=False)
                if is_dir or not entry.is_dir():
                    yield entry.path, is_dir, 0 if is_dir else None, None
        return
    from pyarrow import fs

    store, inner = open_store(folder)
    for info in store.get_file_info(fs.FileSelector(inner, recursive=False)):
        is_dir = info.type == fs.FileType.Directory
        yield f"{folder.rstrip('/')}/{info.base_name}", is_dir, info.size or 0, info.mtime_ns


def _batch(rows: list[tuple], **types: pa.DataType) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(rows, path=pa.string(), is_dir=pa.bool_(), size=pa.int64(), modified=pa.int64(), problem=pa.string())


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for folder in batch.column("path").to_pylist():
            try:
                for child in _children(folder):
                    rows.append((*child, None))
                    if len(rows) >= NAMES_PER_BATCH:
                        yield _listed(rows)
                        rows = []
            except (OSError, pa.ArrowException) as error:
                log.warning("cannot list %s: %s", folder, error)
                rows.append((folder, False, 0, None, f"cannot be listed ({error})"))
        yield _listed(rows)


def _ask_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, problem in zip(batch.column("path").to_pylist(), batch.column("problem").to_pylist()):
            try:
                rows.append((path, *_size_of(path), problem))
            except OSError:
                rows.append((path, 0, None, problem))
        yield _batch(rows, path=pa.string(), size=pa.int64(), modified=pa.int64(), problem=pa.string())


def with_sizes(listing: DataFrame, names_per_task: int = NAMES_PER_TASK) -> DataFrame:
    """``listing(path, size, modified, problem)`` with what is missing, asked by tasks of neighbouring names.

    However many files one folder holds, each task asks for about as many.
    """
    unsized = listing.filter(F.col("size").isNull())
    names = unsized.count()
    if not names:
        return listing
    asked = unsized.repartitionByRange(-(-names // names_per_task), "path").mapInArrow(_ask_sizes, SIZED)
    return listing.filter(F.col("size").isNotNull()).unionByName(asked)


def list_files(spark: SparkSession, base: str, suffixes=fixed.SUPPORTED_SUFFIXES, folder: str | None = None) -> DataFrame:
    """``(path, size, modified, problem)`` of every file below ``base`` with one of the suffixes, hidden ones too.

    One job per level of the tree reads names alone; sizes are asked for the files that are
    wanted, by tasks that share them out by name, so that a flat folder is not one task's
    work. The driver sees neither paths nor folders. A folder that cannot be listed is a
    row with a problem.
    """
    base = absolute(base)
    if not _is_local(base):
        open_store(base)  # fails here and now if nothing can open it
    folder = folder or scratch.run_folder(spark)
    most_tasks = spark.sparkContext.defaultParallelism * 4
    frontier = spark.createDataFrame([(base,)], "path string")
    level, folders = 0, 1
    while folders:
        listed = frontier.repartition(min(folders, most_tasks), "path").mapInArrow(_list_folders, LISTING)
        table = scratch.stage(listed, folder, f"listing/level={level}")
        frontier = table.filter("is_dir").select("path")
        folders = frontier.count()
        level += 1
    # A folder used before may hold deeper levels of an older tree.
    every_level = spark.read.schema(f"{LISTING}, level int").parquet(f"{folder}/listing").filter(F.col("level") < level)
    wanted = F.col("problem").isNotNull() | (~F.col("is_dir") & urls.is_supported(F.col("path"), suffixes))
    return scratch.stage(with_sizes(every_level.filter(wanted).select("path", "size", "modified", "problem")), folder, "files")


def find_html_files(spark: SparkSession, base: str) -> DataFrame:
    return list_files(spark, base, fixed.HTML_SUFFIXES)


def find_markdown_files(spark: SparkSession, base: str) -> DataFrame:
    return list_files(spark, base, fixed.MARKDOWN_SUFFIXES)


def find_tex_files(spark: SparkSession, base: str) -> DataFrame:
    return list_files(spark, base, fixed.TEX_SUFFIXES)


@contextlib.contextmanager
def _opened(path: str):
    if _is_local(path):
        with open(path, "rb") as file:
            yield file
    else:
        store, inner = open_store(path)
        with store.open_input_stream(inner) as file:
            yield file


def _pieces(path: str, chars: int) -> Iterator[str]:
    """A file's text as a stream, line ends made one; an error of coding where it comes up."""
    with _opened(path) as file, io.TextIOWrapper(file, encoding="utf-8", newline=None) as text:
        while piece := text.read(chars):
            yield piece


def _size_of(path: str) -> tuple[int, int | None]:
    """Size and time of change, in nanoseconds."""
    if _is_local(path):
        found = os.stat(path)
        return found.st_size, found.st_mtime_ns
    store, inner = open_store(path)
    info = store.get_file_info(inner)
    return info.size or 0, info.mtime_ns


def _problem(error: Exception) -> str:
    """What the report says of a file that cannot be read."""
    if isinstance(error, FileNotFoundError):
        return fixed.NOT_FOUND
    if isinstance(error, PermissionError):
        return fixed.NO_PERMISSION
    if isinstance(error, TimeoutError):
        return fixed.READ_TIMEOUT
    if isinstance(error, BlockingIOError):
        return fixed.BLOCKING_IO
    return str(error)


def read_one(path: str) -> tuple[str | None, str | None]:
    """(content, problem) of one file; exactly one of them is None."""
    try:
        with _opened(path) as file:
            data = file.read()
        return data.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n"), None
    except Exception as error:  # whatever it is, it belongs in the report
        return None, _problem(error)


def read_parts(path: str, part_chars: int = parts.PART_CHARS) -> Iterator[tuple[str | None, str | None]]:
    """(content, problem) of each part of a large file, or one problem.

    The text is decoded once before any of it is given out, so that a file with bad bytes
    has no parts, as a small one has no content. Behind a stretch that cannot be cut
    the file is given up: its problem comes after the parts before.
    """
    pieces = max(1, part_chars // 8)
    try:
        for _ in _pieces(path, pieces):
            pass
        for part in parts.parts_of(_pieces(path, pieces), path, part_chars):
            yield part, None
    except Exception as error:
        yield None, _problem(error)


def _read(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(rows, path=pa.string(), content=pa.string(), problem=pa.string(), part=pa.int32())


def _contents(path: str, size: int, part_bytes: int, part_chars: int) -> Iterator[tuple]:
    """(path, content, problem, part) of one file; ``part`` is null for a file that is read whole."""
    if size >= part_bytes:
        for number, (content, problem) in enumerate(read_parts(path, part_chars)):
            yield path, content, problem, number
    else:
        yield path, *read_one(path), None


def read_files(listing: DataFrame, part_bytes: int = PART_BYTES, part_chars: int = parts.PART_CHARS) -> DataFrame:
    """``documents(path, content, problem, part)``; tasks get about the same number of bytes.

    A file of ``part_bytes`` or more is one row a part, read by one task as a stream.
    """
    spark = listing.sparkSession
    found, total = listing.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // BYTES_PER_TASK))
    if "problem" not in listing.columns:
        listing = listing.withColumn("problem", F.lit(None).cast("string"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for path, size, problem in zip(*[batch.column(c).to_pylist() for c in ("path", "size", "problem")]):
                found = ((path, None, problem, None),) if problem else _contents(path, size or 0, part_bytes, part_chars)
                for row in found:
                    length = len(row[1] or "")
                    if rows and held + length > BYTES_PER_BATCH:
                        yield _read(rows)
                        rows, held = [], 0
                    rows.append(row)
                    held += length
            yield _read(rows)

    return listing.select("path", "size", "problem").repartition(max(1, min(found, tasks)), "path").mapInArrow(read, READ)


def list_path(spark: SparkSession, path: str, suffixes=fixed.SUPPORTED_SUFFIXES, folder: str | None = None) -> DataFrame | None:
    """The listing of a file or of a folder tree; None if the folder holds no document."""
    path = absolute(path)
    kind = scratch.path_kind(spark, path)
    if kind is None:
        raise FileNotFoundError(f"nothing to audit at {path}")
    if kind == "file":
        if not path.endswith(tuple(suffixes)):
            raise ValueError(f"{path} is of a format that no extractor reads")
        return spark.createDataFrame([(path, *_size_of(path), None)], SIZED)
    listing = list_files(spark, path, suffixes, folder)
    if listing.isEmpty():
        log.warning("%s holds no file to audit, at any depth", path)
        return None
    return listing


def open_path(spark: SparkSession, path: str, suffixes=fixed.SUPPORTED_SUFFIXES, folder: str | None = None) -> DataFrame | None:
    """Documents of a file or of a folder tree; None if the folder holds none."""
    listing = list_path(spark, path, suffixes, folder)
    return None if listing is None else read_files(listing)
