"""The change feed as a stream, and the index kept fresh from it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lineloom.functions.paths import EXCLUDED_DIRECTORIES, SUPPORTED_LANGUAGES
from lineloom.operators.corpus import filter_kept
from lineloom.schemas import CHANGES
from lineloom.sources.store import commit_changes
from lineloom.streaming.sessions import actions_in, debounce, debounce_settled, settled_in


def read_changes(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Stream of ``(project, path, action, ts, seq, content)`` rows from a folder."""
    return spark.readStream.schema(CHANGES).format(format).load(path)


def filter_feed(
    changes: DataFrame,
    languages: tuple[str, ...] | None = SUPPORTED_LANGUAGES,
    names: tuple[str, ...] = EXCLUDED_DIRECTORIES,
    suffixes: tuple[str, ...] = (),
) -> DataFrame:
    """Changes of supported files outside of excluded folders; logs never count. ``languages=None`` keeps every language."""
    return filter_kept(changes, languages, names, (".log", *suffixes))


def maintain_index(
    spark: SparkSession,
    feed: str,
    index: str,
    checkpoint: str,
    gap: str = "1 second",
    delay: str = "10 seconds",
    format: str = "parquet",
    interval: str | None = None,
    fold_accents: bool = True,
    quiet: str | None = None,
    **rule,
) -> StreamingQuery:
    """Keep a stored index up to date from a feed.

    The stream itself only carries session bounds, so its state stays small however busy
    a project is. When sessions close, their changes are read back from the feed, reduced
    to the last one per path, and committed under the batch's id: a batch replayed after
    a failure is recognised. Without ``interval`` the query takes what is there and
    stops; sessions that the watermark has not passed wait for the next start, or for
    ``flush``. The session's option ``sessionWindow.merge.sessions.in.local.partition`` is set.

    With ``quiet`` a path counts once it has not changed for that long; sessions gather settled paths, and a path that is
    still being written waits for a later one. ``rule`` has the options of ``filter_feed``, to be the same as
    those the index was built with.
    """
    # Sessions are merged inside each task before they are shuffled to their project.
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    stream = filter_feed(read_changes(spark, feed, format), **rule)
    closed = debounce_settled(stream, quiet, gap, delay) if quiet else debounce(stream, gap, delay)

    def apply(sessions: DataFrame, batch_id: int) -> None:
        # Few rows, asked for several times; without this each time would run the state again.
        sessions = sessions.persist()
        try:
            if not sessions.isEmpty():
                commit(sessions, batch_id)
        finally:
            sessions.unpersist()

    def commit(sessions: DataFrame, batch_id: int) -> None:
        changes = filter_feed(spark.read.schema(CHANGES).format(format).load(feed), **rule)
        first = F.min("start") - F.expr(f"interval {quiet}") if quiet else F.min("start")
        span = sessions.agg(first.alias("start"), F.max("last").alias("last")).first()
        recent = changes.filter(F.col("ts").between(F.lit(span.start), F.lit(span.last)))
        actions = settled_in(sessions, recent, quiet, gap) if quiet else actions_in(sessions, recent, gap).drop("start")
        commit_changes(spark, index, actions, run_id=f"{checkpoint}#{batch_id}", fold_accents=fold_accents)

    writer = closed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def flush(
    spark: SparkSession, feed: str, index: str, run_id: str, format: str = "parquet", fold_accents: bool = True, **rule
) -> int | None:
    """Apply the whole feed at once, open sessions included, when a stream is shut down.

    Last change per path; paths whose last change is already in the index are rewritten
    with the same rows. ``rule`` as for ``maintain_index``.
    """
    changes = filter_feed(spark.read.schema(CHANGES).format(format).load(feed), **rule)
    return commit_changes(spark, index, changes, run_id, fold_accents)


def change_stats(changes: DataFrame) -> DataFrame:
    """Changes per project and action; on a stream a running count (complete mode)."""
    return changes.groupBy("project", "action").agg(
        F.count("*").alias("changes"), F.max("ts").alias("latest")
    )


def show_change_stats(changes: DataFrame, name: str, every: str = "5 seconds") -> StreamingQuery:
    """Refresh ``change_stats`` of a stream in the in-memory table ``name``."""
    writer = change_stats(changes).writeStream.outputMode("complete").format("memory").queryName(name)
    return writer.trigger(processingTime=every).start()
