"""Rows cut into ranges of their keys by bounds that are known beforehand.

``repartitionByRange`` finds its bounds by running its whole input once more. Here they come from a bounded
sample, and each row finds its range by a binary search written out in columns: one step is one
comparison in generated code, and the input runs once.
"""

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that are looked at for each range.
PER_RANGE = 100


def range_bounds(keys: DataFrame, ranges: int, weight: str | None = None, per_range: int = PER_RANGE) -> list[list]:
    """Up to ``ranges - 1`` ascending keys that cut the rows into ranges of about equal number or ``weight``.

    The sample is the ``ranges * per_range`` rows with the smallest hashes: each task keeps no more than that,
    and the same rows always give the same bounds. Columns are strings; ``weight``, if any, is the last one.
    """
    if ranges < 2:
        return []
    named = [c for c in keys.columns if c != weight]
    rows = keys.withColumn("__hash", F.xxhash64(*keys.columns)).orderBy("__hash", *named).limit(ranges * per_range)
    sample = sorted(rows.select(*keys.columns).collect(), key=lambda r: [(r[c] is not None, (r[c] or "").encode()) for c in named])
    weights = [(r[weight] or 0) + 1 if weight else 1 for r in sample]
    bounds: list[list] = []
    so_far, step = 0, sum(weights) / ranges
    for row, mass in zip(sample, weights):
        key = [row[c] for c in named]
        if so_far >= step * (len(bounds) + 1) and (not bounds or bounds[-1] != key):
            bounds.append(key)
        so_far += mass
    return bounds


def with_range(df: DataFrame, keys: list[Column], bounds: list[list], name: str = "__range") -> DataFrame:
    """``df`` with the number of bounds that are not above a row's keys; nulls come first."""
    fields = ", ".join(f"k{i}: string" for i in range(len(keys)))
    listed = json.dumps([{f"k{i}": v for i, v in enumerate(bound)} for bound in bounds])
    table = F.from_json(F.lit(listed), f"array<struct<{fields}>>")  # constant, so it is read once
    key = F.struct(*[k.cast("string").alias(f"k{i}") for i, k in enumerate(keys)])
    df = df.withColumn(name, F.lit(0)).withColumn("__key", key)
    step = 1 << max(len(bounds).bit_length() - 1, 0)
    while bounds and step:
        found = F.col(name) + step
        # Nothing lies beyond the last bound: there the array gives null, and the search stays.
        df = df.withColumn(name, F.when(F.get(table, found - 1) <= F.col("__key"), found).otherwise(F.col(name)))
        step >>= 1
    return df.drop("__key")


def into_ranges(df: DataFrame, keys: list[Column], bounds: list[list]) -> DataFrame:
    """``df`` with one partition per range of its keys, in their order."""
    if not bounds:
        return df.coalesce(1)
    return with_range(df, keys, bounds).repartitionById(len(bounds) + 1, "__range").drop("__range")
