"""The place of every row in a total order within its group, without one task per group."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineloom.llm.saved import saved

#: Rows of a table that a join may send to every task, once they are counted.
SENT = 50_000


def counted_broadcast(frame: DataFrame, rows: int = SENT) -> DataFrame:
    """A stored table marked for broadcast if it was counted and is small; Spark chooses the join otherwise."""
    return F.broadcast(frame) if frame.count() <= rows else frame


def placed(rows: DataFrame, group: str, order: list[str], place_col: str = "place", size_col: str = "size") -> DataFrame:
    """The rows with their place, from 0, in the order within their group, and the size of the group.

    ``group`` holds no nulls. The rows are cut into ranges of group and order and stored; what a group has
    in the ranges before is added up from one row per group and range. Rows that are equal in
    all columns of the order take places in any order among themselves.
    """
    # Stored before they are ranged: finding the ranges reads the rows once more.
    ranged = saved(rows).repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    stored = saved(ranged.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__at", 33)
    pieces = stored.groupBy(group, part.alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    in_group = Window.partitionBy(group)
    before = F.coalesce(F.sum("__rows").over(in_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = saved(pieces.select(group, "__part", "__first", before.alias("__before"), F.sum("__rows").over(in_group).alias(size_col)))
    found = stored.withColumn("__part", part).join(counted_broadcast(pieces), [group, "__part"])
    place = F.col("__before") + F.col("__at") - F.col("__first")
    return found.select(*rows.columns, place.alias(place_col), size_col)
