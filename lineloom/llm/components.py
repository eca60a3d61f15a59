"""Connected components over a distributed edge list."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.llm.saved import saved

MAX_ROUNDS = 60


def _pulled(edges: DataFrame) -> DataFrame:
    """Every edge ``(u, v)`` with the least neighbour of ``u`` as ``m``.

    The minima are stored before the join, so that both sides of the join come straight from
    an exchange and the adaptive planner may split a node that has very many edges.
    """
    least = saved(edges.groupBy("u").agg(F.min("v").alias("m")))
    return edges.join(least.hint("merge"), "u")


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).head()
    return row.n, row.h


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of the edges but the roots; the root is the least node of its component.

    Edges are turned to stars by alternating two steps until nothing changes: each node hands
    its larger neighbours to its least one, then each node hands its smaller neighbours to the
    least of them. The number of rounds grows with the logarithm of the longest path; each
    round is stored. Self-loops, repeated edges and nulls are allowed; a null end links nothing.
    """
    x, y = F.col(a), F.col(b)
    stars = saved(
        edges.filter(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    )
    before = _signature(stars)
    for _ in range(MAX_ROUNDS if before[0] else 0):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        handed = _pulled(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = saved(handed.distinct())
        handed = _pulled(large).select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        stars = saved(handed.select("e.u", "e.v").filter("u != v").distinct())
        after = _signature(stars)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
