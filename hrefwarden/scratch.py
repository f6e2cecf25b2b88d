"""Where an audit keeps the tables it writes between its stages.

The folder is the shared one the cluster names in ``spark.checkpoint.dir``. A
machine-local folder is made only in local mode, where every task sees it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="hrefwarden-")
    spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def run_folder(spark: SparkSession, run_id: str | None = None) -> str:
    """A folder of its own for one run; a named run finds its tables again."""
    return f"{shared_folder(spark)}/hrefwarden/{run_id or uuid.uuid4().hex}"


def stage(df: DataFrame, folder: str, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table and go on from the table, not from its lineage."""
    path = f"{folder}/{name}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_once(df: DataFrame, folder: str, name: str) -> DataFrame:
    """As ``stage``, but a table an earlier try has finished is taken as it is."""
    path = f"{folder}/{name}"
    if path_kind(df.sparkSession, f"{path}/_SUCCESS"):
        return df.sparkSession.read.schema(df.schema).parquet(path)
    return stage(df, folder, name)


def path_kind(spark: SparkSession, path: str) -> str | None:
    """'file', 'folder' or None, on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    return "folder" if fs.getFileStatus(where).isDirectory() else "file"


def make_parent(spark: SparkSession, path: str) -> None:
    """Make the folder that is to hold ``path``."""
    jvm = spark.sparkContext._jvm
    parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
    parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(parent)


def release(spark: SparkSession, folder: str) -> None:
    """Remove the tables of a run once its reports are written."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
