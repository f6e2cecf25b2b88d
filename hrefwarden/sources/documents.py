"""Documents that already are rows of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefwarden.functions import fixed, urls


def from_table(table: DataFrame, path: Column | str, content: Column | str, suffix: str | None = None) -> DataFrame:
    """``documents(path, content)`` of any table; ``suffix`` names the format where paths do not."""
    path = F.col(path) if isinstance(path, str) else path
    content = F.col(content) if isinstance(content, str) else content
    path = path.cast("string")
    return table.select((F.concat(path, F.lit(suffix)) if suffix else path).alias("path"), content.alias("content"))


def with_suffix(documents: DataFrame, suffixes=fixed.SUPPORTED_SUFFIXES) -> DataFrame:
    return documents.filter(urls.is_supported(F.col("path"), suffixes))


def html_documents(documents: DataFrame) -> DataFrame:
    return with_suffix(documents, fixed.HTML_SUFFIXES)


def markdown_documents(documents: DataFrame) -> DataFrame:
    return with_suffix(documents, fixed.MARKDOWN_SUFFIXES)


def tex_documents(documents: DataFrame) -> DataFrame:
    return with_suffix(documents, fixed.TEX_SUFFIXES)


def decoded(raw: DataFrame, data: str = "data") -> DataFrame:
    """Bytes to ``(path, content, problem)``: bad bytes are reported, not replaced."""
    content = F.try_validate_utf8(F.col(data).cast("string"))
    return raw.select(
        "path",
        content.alias("content"),
        F.when(F.col(data).isNotNull() & content.isNull(), fixed.NOT_UTF8).alias("problem"),
    )


def access_errors(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("problem").isNotNull()).select("path", "problem")
