"""Corpora that already are tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corpus_from_table(
    df: DataFrame,
    path: Column,
    content: Column,
    project: Column | None = None,
    last_modified: Column | None = None,
    file_size: Column | None = None,
) -> DataFrame:
    """Any table as a corpus; the size defaults to the bytes of the content."""
    missing = F.lit(None)
    return df.select(
        (missing.cast("string") if project is None else project).alias("project"),
        path.alias("path"),
        content.alias("content"),
        (missing if last_modified is None else last_modified).cast("timestamp").alias("last_modified"),
        (F.octet_length(content) if file_size is None else file_size).cast("bigint").alias("file_size"),
    )
