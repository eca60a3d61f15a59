"""Joins on keys of which a few may hold a large part of a table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that one task should get of a key are about one of this many parts of the table.
PARTS = 256


def hot_of(counts: DataFrame, key: str, rows: str, parts: int = PARTS) -> DataFrame:
    """``(key, splits)`` of the keys with more than one part of the rows, from a table of counts."""
    total = counts.agg(F.sum(rows)).scalar()
    splits = F.ceil(F.col(rows) * parts / total).cast("int")
    return counts.filter(F.col(key).isNotNull() & (F.col(rows) * parts > total)).select(key, splits.alias("__splits"))


def hot_keys(large: DataFrame, key: str, parts: int = PARTS) -> DataFrame:
    """``(key, splits)`` of the keys with more than one part of the rows: fewer than ``parts`` rows, whatever the table.

    Counts are combined inside each task before the shuffle.
    """
    return hot_of(large.groupBy(key).agg(F.count("*").alias("__rows")), key, "__rows", parts)


def split_join(small: DataFrame, large: DataFrame, key: str, spread: Column, parts: int = PARTS, hot: DataFrame | None = None) -> DataFrame:
    """Inner join on ``key``; a hot key of ``large`` is cut into as many pieces as its share of the rows asks for.

    ``spread`` (of ``large``) tells the rows of one key apart. Only the rows of ``small`` with a hot key are copied, once
    per piece; all others meet unsplit. ``hot`` may hold the counts of an earlier ``hot_keys``.
    """
    # Fewer than ``parts`` rows, so that each side can look its splits up in place.
    few = F.broadcast(hot_keys(large, key, parts) if hot is None else hot)
    pieces = F.coalesce("__splits", F.lit(1))
    left = small.join(few, key, "left").select(*small.columns, F.explode(F.sequence(F.lit(0), pieces - 1)).alias("__piece"))
    piece = F.when(F.col("__splits").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("__splits"))).cast("int")
    right = large.join(few, key, "left").withColumn("__piece", piece).drop("__splits")
    return left.join(right, [key, "__piece"]).drop("__piece")
