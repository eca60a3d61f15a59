"""Ranges of keys by given bounds, and joins that split hot keys."""

import random

from pyspark.sql import functions as F

from lineloom.operators.hot import hot_keys, split_join
from lineloom.operators.ranges import into_ranges, range_bounds, with_range


def test_binary_search_in_columns(spark):
    rng = random.Random(4)
    word = lambda: rng.choice([None, "", "a", "ab", "é", "zz", '"', "\\", "\u0001"]) if rng.random() < 0.5 else str(rng.randrange(30))
    rows = [(word(), word()) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b string")
    order = lambda r: [(v is not None, (v or "").encode()) for v in r]
    for n in (1, 2, 3, 7, 8, 20):
        bounds = sorted({tuple(rng.choice(rows)) for _ in range(n)}, key=order)
        got = with_range(df, [F.col("a"), F.col("b")], [list(b) for b in bounds]).collect()
        assert [r["__range"] for r in got] == [sum(order(b) <= order(r[:2]) for b in bounds) for r in got]


def test_ranges_are_even_and_in_order(spark):
    df = spark.range(5000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("k"))
    bounds = range_bounds(df, 8)
    parts = into_ranges(df, [F.col("k")], bounds).groupBy(F.spark_partition_id().alias("p")).agg(F.min("k"), F.max("k"), F.count("*").alias("n"))
    rows = sorted(map(tuple, parts.collect()))
    assert len(rows) == 8 and all(a[2] < b[1] for a, b in zip(rows, rows[1:])) and all(400 < r[3] < 900 for r in rows)
    heavy = df.withColumn("w", F.when(F.col("k") < "00100", 10_000).otherwise(0))
    # The heavy keys fill most ranges.
    assert sum(b[0] < "00100" for b in range_bounds(heavy, 8, "w")) >= 6
    assert range_bounds(df, 1) == [] == range_bounds(df.limit(0), 4)
    assert into_ranges(df, [F.col("k")], []).count() == 5000
    one = spark.range(1000).select(F.lit("same").alias("k"))
    assert len(range_bounds(one, 4)) <= 1


def test_hot_keys_are_split(spark):
    large = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise((F.col("id") % 997).cast("string")).alias("k"), "id")
    small = spark.createDataFrame([("hot", 1), ("5", 2), ("hot", 3), ("none", 4), (None, 5)], "k string, s int")
    hot = {r.k: r["__splits"] for r in hot_keys(large, "k", 64).collect()}
    assert hot == {"hot": 32}
    got = split_join(small, large, "k", F.col("id"), 64)
    assert sorted(map(tuple, got.select("k", "s", "id").collect())) == sorted(map(tuple, small.join(large, "k").select("k", "s", "id").collect()))
    # A null key meets nothing; an empty side gives nothing.
    assert split_join(small, large.limit(0), "k", F.col("id")).count() == 0
