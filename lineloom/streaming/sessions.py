"""Debounce, settling and last action of a change feed, for batches and streams.

A quiet time of ``gap`` ends a session. In a batch the events are first folded into
time slots one gap wide: two events of a slot can never be in different sessions, so
this is exact, happens before the shuffle, and leaves one row per slot even of a project
or file that makes up a large share of the feed. Only those rows are put in order, block
of time by block of time.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# Slots in one block of time.
BLOCK_SLOTS = 100_000


def _micros(gap: str) -> Column:
    epoch = "timestamp_seconds(0)"
    return F.expr(f"unix_micros({epoch} + interval {gap}) - unix_micros({epoch})")


def _slot(gap: str) -> Column:
    return F.floor(F.unix_micros("ts") / _micros(gap))


def _sessions(slots: DataFrame, keys: list[str], gap: str) -> DataFrame:
    """Slots ``(keys, slot, first, last)`` with the ``session`` (its first time) they are in.

    Events exactly one gap apart are in the same session. Slots are put in order within
    blocks of time, and blocks, of which there are few, over a whole key: a busy key is
    spread over as many tasks as it has blocks.
    """
    longer = lambda later, earlier: F.unix_micros(later) > F.unix_micros(earlier) + _micros(gap)
    blocked = slots.withColumn("block", F.floor(F.col("slot") / BLOCK_SLOTS))
    in_block = W.partitionBy(*keys, "block").orderBy("slot")
    # Known here are the sessions that open after a pause inside the block.
    local = blocked.withColumn(
        "opens", F.when(longer(F.col("first"), F.lag("last").over(in_block)), F.col("first"))
    ).withColumn(
        "opened", F.last("opens", ignorenulls=True).over(in_block.rowsBetween(W.unboundedPreceding, 0))
    )
    blocks = local.groupBy(*keys, "block").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.max("opens").alias("opens")
    )
    # The session at the start of a block is its own, or the last one opened before.
    in_key = W.partitionBy(*keys).orderBy("block")
    fresh = F.coalesce(longer(F.col("first"), F.lag("last").over(in_key)), F.lit(True))
    heads = (
        blocks.withColumn("own", F.when(fresh, F.col("first")))
        .withColumn(
            "before",
            F.last(F.coalesce("opens", "own"), ignorenulls=True).over(
                in_key.rowsBetween(W.unboundedPreceding, -1)
            ),
        )
        .select(
            *[F.col(k).alias(f"of_{k}") for k in keys],
            F.col("block").alias("of_block"),
            F.coalesce("own", "before").alias("head"),
        )
    )
    same = F.col("block") == F.col("of_block")
    for key in keys:
        same &= F.col(key).eqNullSafe(F.col(f"of_{key}"))
    return local.join(heads, same).select(*slots.columns, F.coalesce("opened", "head").alias("session"))


def _project_slots(changes: DataFrame, gap: str) -> DataFrame:
    return changes.groupBy("project", _slot(gap).alias("slot")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("events")
    )


def debounce(changes: DataFrame, gap: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """Sessions of each project: ``(project, start, last, events)``.

    Any event of a project restarts its quiet time. On a stream a session comes out once
    the watermark, ``delay`` behind the newest event, has passed it.
    """
    if changes.isStreaming:
        return (
            changes.withWatermark("ts", delay)
            .groupBy("project", F.session_window("ts", gap).alias("session"))
            .agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("events"))
            .select("project", "start", "last", "events")
        )
    return (
        _sessions(_project_slots(changes, gap), ["project"], gap)
        .groupBy("project", F.col("session").alias("start"))
        .agg(F.max("last").alias("last"), F.sum("events").alias("events"))
        .select("project", "start", "last", "events")
    )


def last_action(changes: DataFrame, gap: str = "1 second") -> DataFrame:
    """The last action of each path in each session of its project, for a batch feed:
    ``(project, start, path, action, ts)``.

    On a stream, ``debounce`` finds the closed sessions and ``actions_in`` reads their
    changes back from the feed.
    """
    per_slot = changes.groupBy("project", _slot(gap).alias("slot"), "path").agg(
        F.max(F.struct("ts", "seq", "action")).alias("newest")
    )
    slots = _sessions(_project_slots(changes, gap), ["project"], gap).select(
        F.col("project").alias("of"), F.col("slot").alias("in"), F.col("session").alias("start")
    )
    return (
        per_slot.join(slots, F.col("project").eqNullSafe(F.col("of")) & (F.col("slot") == F.col("in")))
        .groupBy("project", "start", "path")
        .agg(F.max("newest").alias("newest"))
        .select("project", "start", "path", "newest.action", "newest.ts")
    )


def settle(changes: DataFrame, gap: str = "2 seconds", delay: str = "10 seconds") -> DataFrame:
    """Each path once it has been quiet for ``gap``:
    ``(project, path, start, ts, action, settled)``.

    ``ts`` is the time of the last change and ``action`` what it was. ``settled`` is the
    last moment of the quiet time, an event time that later streaming steps can use.
    """
    if changes.isStreaming:
        return (
            changes.withWatermark("ts", delay)
            .groupBy("project", "path", F.session_window("ts", gap).alias("session"))
            .agg(
                F.min("ts").alias("start"),
                F.max("ts").alias("ts"),
                F.max_by("action", F.struct("ts", "seq")).alias("action"),
            )
            .select("project", "path", "start", "ts", "action", F.window_time("session").alias("settled"))
        )
    slots = changes.groupBy("project", "path", _slot(gap).alias("slot")).agg(
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
        F.max(F.struct("ts", "seq", "action")).alias("newest"),
    )
    settled = F.timestamp_micros(F.unix_micros("newest.ts") + _micros(gap) - 1)
    return (
        _sessions(slots, ["project", "path"], gap)
        .groupBy("project", "path", F.col("session").alias("start"))
        .agg(F.max("newest").alias("newest"))
        .select("project", "path", "start", "newest.ts", "newest.action", settled.alias("settled"))
    )


def debounce_settled(
    changes: DataFrame, quiet: str = "2 seconds", gap: str = "1 second", delay: str = "10 seconds"
) -> DataFrame:
    """Both waits in a row: paths first settle for ``quiet``, then the settled paths of a
    project are gathered until none follows for ``gap``: ``(project, start, last, paths)``."""
    settled = settle(changes, quiet, delay)
    if changes.isStreaming:
        return (
            settled.groupBy("project", F.session_window("settled", gap).alias("session"))
            .agg(F.min("settled").alias("start"), F.max("settled").alias("last"), F.count("*").alias("paths"))
            .select("project", "start", "last", "paths")
        )
    times = settled.select("project", F.col("settled").alias("ts"))
    return debounce(times, gap).withColumnRenamed("events", "paths")


def settled_in(sessions: DataFrame, changes: DataFrame, quiet: str, gap: str) -> DataFrame:
    """The changes with which paths settled in the given sessions of ``debounce_settled``: one per path and session.

    Changes of paths that were still being written are left for a later session.
    """
    # A path settles one microsecond before its quiet time is over.
    quiets = F.unix_micros("ts") - _micros(quiet) + 1
    paths = settle(changes, quiet).select(
        "project", "path", "action", F.col("settled").alias("ts"), F.lit(0).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("content")
    )
    found = actions_in(sessions, paths, gap).select(
        F.col("project").alias("of"), F.col("path").alias("of_path"), F.timestamp_micros(quiets).alias("of_ts")
    )
    same = F.col("project").eqNullSafe(F.col("of")) & (F.col("path") == F.col("of_path")) & (F.col("ts") == F.col("of_ts"))
    return changes.join(found, same, "left_semi")


def actions_in(sessions: DataFrame, changes: DataFrame, gap: str) -> DataFrame:
    """The last change of each path in each given session, with all its columns.

    Sessions meet their changes by project and time slot, so a project with most of the
    feed is spread over as many tasks as it has slots.
    """
    lo, hi = (F.floor(F.unix_micros(c) / _micros(gap)) for c in ("start", "last"))
    # In two steps, so that a session of a year does not become one huge array.
    run = 1000
    wanted = sessions.select(
        F.col("project").alias("of"),
        "start",
        "last",
        hi.alias("hi"),
        F.explode(F.sequence(lo, hi, F.lit(run).cast("bigint"))).alias("lo"),
    ).select(
        "of", "start", "last", F.explode(F.sequence("lo", F.least("hi", F.col("lo") + run - 1))).alias("in")
    )
    found = changes.withColumn("slot", _slot(gap)).join(
        wanted,
        F.col("project").eqNullSafe(F.col("of"))
        & (F.col("slot") == F.col("in"))
        & F.col("ts").between(F.col("start"), F.col("last")),
    )
    newest = F.struct("ts", F.coalesce("seq", F.lit(0)).alias("seq"), "action", "content")
    return (
        found.groupBy("project", "start", "path")
        .agg(F.max(newest).alias("newest"))
        .select("project", "start", "path", "newest.action", "newest.ts", "newest.seq", "newest.content")
    )
