"""Send this package to the Python workers of a session."""

from __future__ import annotations

import atexit
import pathlib
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application; not needed where the package is installed on the workers."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = pathlib.Path(__file__).parent
    with tempfile.TemporaryDirectory() as folder:
        copy = pathlib.Path(folder) / "source"
        shutil.copytree(package, copy / package.name, ignore=shutil.ignore_patterns("__pycache__"))
        # The driver serves the archive from where it lies as long as it runs.
        keep = tempfile.mkdtemp(prefix="hrefwarden-code-")
        atexit.register(shutil.rmtree, keep, ignore_errors=True)
        archive = shutil.make_archive(f"{keep}/{package.name}", "zip", copy)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
