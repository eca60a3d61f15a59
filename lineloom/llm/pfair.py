"""Mixing sources to target weights by Pfair scheduling.

Each source is a queue of blocks of rows. With weight w, block k (from 1) may come from slot
floor((k-1)/w) on and must come before slot ceil(k/w). Taking in each slot the released block with
the earliest deadline keeps every source within less than one block of its share at any time. Release times and
deadlines come from the weights themselves, in whole numbers, for all blocks of the mix. Where a
period is given, the weights are rounded to whole shares of it: the schedule then repeats, is made once for one
period, and every block's slot follows from its number by arithmetic.
"""

import heapq
import math
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineloom.llm.saved import saved

PERIOD = 1000
BLOCK = 32
#: Weights, where none are given: the square root of the source's rows, times this and then rounded down.
TEMPER = 0.5
FINE = 1 << 10
#: Rows of one source ranked by one task, about.
BUCKET = 2_000
#: Exact weights are whole numbers that add up to about this.
SCALE = 1 << 60


def shares(weights: dict, period: int = PERIOD) -> dict:
    """Whole shares that add up to the period, one at least each; the largest remainders are rounded up."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources need a longer period than {period}")
    total, free = sum(weights.values()), period - len(weights)
    exact = {s: free * w / total for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    spare = period - sum(out.values())
    for s in sorted(exact, key=lambda s: (-round(exact[s] - int(exact[s]), 9), s))[:spare]:
        out[s] += 1
    return out


def schedule(parts: dict) -> dict:
    """The slots of each source's blocks within one period: earliest deadline first among those released."""
    period = sum(parts.values())
    waiting = [(0, s, 1) for s in sorted(parts)]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    slots: dict = {s: [] for s in parts}
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-k * period // parts[s]), s, k))
        _, s, k = heapq.heappop(ready)
        slots[s].append(slot)
        if k < parts[s]:
            heapq.heappush(waiting, (k * period // parts[s], s, k + 1))
    return slots


def whole(weights: dict) -> dict:
    """The weights as whole numbers that add up to about ``SCALE``."""
    total = sum(weights.values())
    return {s: max(1, round(w / total * SCALE)) for s, w in weights.items()}


def tempered(sizes: dict) -> dict:
    """The square roots of the sizes as whole numbers, ``FINE`` times as large."""
    return {s: math.isqrt(n * FINE * FINE) for s, n in sizes.items()}


def timetable(parts: dict, blocks: dict) -> Iterator[tuple]:
    """``(source, block from 0, slot)`` for all blocks, earliest deadline first, weights being whole numbers.

    Sums are exact. Memory grows with the number of sources only.
    """
    total = sum(parts.values())
    waiting = [(0, s, 1) for s in sorted(parts) if blocks[s] > 0]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-k * total // parts[s]), s, k))
        _, s, k = heapq.heappop(ready)
        yield s, k - 1, slot
        slot += 1
        if k < blocks[s]:
            heapq.heappush(waiting, (k * total // parts[s], s, k + 1))


def _named(sizes: dict, weights: dict | None) -> dict:
    if weights is None:
        return {s: n**TEMPER for s, n in sizes.items()}
    given = {"n" if s is None else f"s{s}": w for s, w in weights.items()}
    return {s: given.get(s, min(given.values(), default=1)) for s in sizes}


def _exact_slots(counted: DataFrame, weights: dict | None, block: int) -> DataFrame:
    """``(__mix_name, __mix_share, __mix_number, __mix_slot)`` of every block, from rows of name and count: one task reads all names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict = {}
        for batch in batches:
            sizes |= zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        if not sizes:
            return
        parts = tempered(sizes) if weights is None else whole(_named(sizes, weights))
        rows = timetable(parts, {s: -(-n // block) for s, n in sizes.items()})
        while part := list(islice(rows, 10_000)):
            names, numbers, slots = zip(*part)
            columns = [pa.array(names), pa.array([parts[s] for s in names], pa.int64()), pa.array(numbers, pa.int64()), pa.array(slots, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["__mix_name", "__mix_share", "__mix_number", "__mix_slot"])

    schema = "__mix_name string, __mix_share long, __mix_number long, __mix_slot long"
    return saved(counted.select("__mix_name", "count").coalesce(1).mapInArrow(run, schema))


def mixed(
    documents: DataFrame,
    weights: dict | None = None,
    block: int = BLOCK,
    period: int | None = None,
    exact: bool = False,
    id_col: str = "doc_id",
    source_col: str = "source",
    slot_col: str = "slot",
    rank_col: str = "rank",
    share_col: str = "share",
) -> DataFrame:
    """All rows and columns, with each row's ``slot``, its ``rank`` within its source (from 0) and the source's ``share``.

    Rows of a source come in the order of the MD5 of their id, then id; ordered by slot and rank the
    table is the mix. While every source has blocks left, after any number of slots each has had less
    than one block more or less than its share of them. Then the slots of a source that has run out stay
    empty; no row is dropped or repeated. A null source is a source of its own. ``weights`` names
    every source with a positive number (None: a null source); one that it does not name gets the least
    weight named. Without ``weights``, a source's is its number of rows to the power ``TEMPER``.
    Repeated rows take a rank each.

    The share is the weight as a whole number, out of about ``SCALE`` if weights are given, whatever the number of sources; only
    names, numbers and slots of blocks go through the one task that makes the schedule. With a ``period`` the
    share is one slot of it and the weight's part of those left over; more sources than it has slots are refused, and ``exact``
    undoes it. An empty table gives no rows; texts are not looked at.
    """
    spark = documents.sparkSession
    name = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    counted = saved(documents.select(name.alias("__mix_name")).groupBy("__mix_name").count())
    n_sources, largest = counted.agg(F.count("*"), F.coalesce(F.max("count"), F.lit(0))).head()
    exact = exact or period is None
    if not exact:
        sizes = {r["__mix_name"]: r["count"] for r in counted.limit(period + 1).collect()}
        parts = shares(_named(sizes, weights), period) if sizes else {}
    digits = 0
    while largest > BUCKET * 16**digits:
        digits += 1
    rows = documents.withColumns({"__mix_name": name, "__mix_order": order}).withColumn("__mix_bucket", F.substring("__mix_order", 1, digits))
    before = Window.partitionBy("__mix_name").orderBy("__mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        documents.select(name.alias("__mix_name"), F.substring(order, 1, digits).alias("__mix_bucket")).groupBy("__mix_name", "__mix_bucket").count()
    )
    counts = saved(counts.select("__mix_name", "__mix_bucket", "count", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__mix_before")))
    first = F.floor(F.col("__mix_before") / block)
    if exact:
        # The blocks of a bucket follow one another, so its slots come with its row and no text is shuffled for them.
        last = F.floor((F.col("__mix_before") + F.col("count") - 1) / block)
        numbers = counts.withColumn("__mix_number", F.explode(F.sequence(first, last)))
        found = numbers.join(_exact_slots(counted, weights, block), ["__mix_name", "__mix_number"])
        listed = F.sort_array(F.collect_list(F.struct("__mix_number", "__mix_slot")))["__mix_slot"]
        keys = ["__mix_name", "__mix_bucket", "__mix_before", "__mix_share"]
        counts = saved(found.groupBy(*keys).agg(listed.alias("__mix_slots")))
    else:
        counts = counts.drop("count")
    own = Window.partitionBy("__mix_name", "__mix_bucket").orderBy("__mix_order", F.col(id_col))
    ranked = rows.withColumn("__mix_own", F.row_number().over(own) - 1).join(counts, ["__mix_name", "__mix_bucket"])
    rank = F.col("__mix_before") + F.col("__mix_own")
    if exact:
        ranked = ranked.withColumn("__mix_rank", rank)
        slot = F.get("__mix_slots", (F.floor(F.col("__mix_rank") / block) - first).cast("int"))
    else:
        slots = schedule(parts) if parts else {}
        table = spark.createDataFrame(
            [(s, parts[s], slots[s]) for s in parts], "__mix_name string, __mix_share long, __mix_slots array<long>"
        )  # at most `period` slots in all
        ranked = ranked.join(F.broadcast(table), "__mix_name").withColumn("__mix_rank", rank)
        number = F.floor(F.col("__mix_rank") / block)
        slot = F.floor(number / F.col("__mix_share")) * period + F.get("__mix_slots", (number % F.col("__mix_share")).cast("int"))
    new = {rank_col: F.col("__mix_rank"), slot_col: slot, share_col: F.col("__mix_share")}
    kept = [F.col(c) for c in documents.columns if c not in new]
    return ranked.select(*kept, *[column.cast("long").alias(c) for c, column in new.items()])


def in_order(documents: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` in the order of the mix, with their own columns only."""
    placed = mixed(documents, slot_col="__mix_slot", rank_col="__mix_place", share_col="__mix_part", **options)
    spread = placed.repartitionByRange("__mix_slot", "__mix_place").sortWithinPartitions("__mix_slot", "__mix_place")
    return spread.select(*documents.columns)


#: The same in DuckDB's SQL, the schedule as a recursive query.
SQL = f"""
WITH RECURSIVE n AS (SELECT coalesce('s' || source, 'n') AS name, count(*) AS n FROM documents GROUP BY source),
a AS (SELECT name, floor(sqrt(n * {FINE * FINE}.0))::HUGEINT AS share, (n + {BLOCK - 1}) // {BLOCK} AS blocks, row_number() OVER (ORDER BY name) AS i FROM n),
l AS (SELECT list(share ORDER BY i) AS a, list(blocks ORDER BY i) AS b, list(i ORDER BY i) AS every, sum(share)::HUGEINT AS total FROM a),
e AS (
  SELECT 0::BIGINT AS slot, list_transform(a, lambda q: 0::BIGINT) AS done, 0::BIGINT AS taken, -1::BIGINT AS spot FROM l
  UNION ALL
  SELECT spot + 1, list_transform(every, lambda i: done[i] + (i = best)::BIGINT), best, spot FROM (
    SELECT done, every, spot, list_position(d, list_min(d))::BIGINT AS best FROM (
      SELECT done, every, spot, list_transform(every, lambda i: CASE WHEN done[i] < b[i] AND done[i] * total // a[i] <= spot
             THEN ((done[i] + 1) * total + a[i] - 1) // a[i] ELSE 1000000000000000000000000000000::HUGEINT END) AS d
      FROM (SELECT done, every, a, b, total, greatest(slot, list_min(list_transform(list_filter(every, lambda i: done[i] < b[i]),
             lambda i: done[i] * total // a[i])))::BIGINT AS spot
        FROM e, l WHERE list_sum(done) < list_sum(b))))
),
s AS (SELECT name, share, spot AS slot, done[i] - 1 AS k FROM e JOIN a ON e.taken = a.i),
k AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS name, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS rank
  FROM documents)
SELECT k.doc_id, k.source, k.rank::BIGINT AS rank, s.share::BIGINT AS share, s.slot::BIGINT AS slot
FROM k JOIN s ON k.name = s.name AND s.k = rank // {BLOCK}
"""
