import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lineloom.plans.index import build_index
from lineloom.schemas import CHANGES
from lineloom.sources import store
from lineloom.streaming import feed, sessions
from test_maintain import contents

START = datetime(2024, 5, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def events(n, seed):
    rng = random.Random(seed)
    now, rows = 0.0, []
    for i in range(n):
        now += rng.choice([0.2, 0.5, 1.0, 3.0])
        path = rng.choice(["a.py", "b.py", "c.js", "x.log", "dist/d.js"])
        action = rng.choice(["add", "change", "unlink"])
        rows.append((rng.choice(["one", "two"]), path, action, at(now), i, f"v{i} = {i}\n"))
    return rows


def by_hand(rows, gap):
    """Sessions as a timer would make them, with the last action of each path."""
    found = {}
    for project in {r[0] for r in rows}:
        last = current = None
        for _, path, action, ts, *_ in sorted((r for r in rows if r[0] == project), key=lambda r: (r[3], r[4])):
            if last is None or (ts - last).total_seconds() > gap:
                current = found[project, ts] = {}
            current[path] = action
            last = ts
    return found


@pytest.mark.parametrize("block", [1, 3, 100_000])
def test_batch_sessions(spark, monkeypatch, block):
    monkeypatch.setattr(sessions, "BLOCK_SLOTS", block)
    rows = events(200, 1)
    changes = spark.createDataFrame(rows, CHANGES)
    want = by_hand(rows, 1.0)
    got = sessions.debounce(changes, "1 second").collect()
    assert {(r.project, r.start) for r in got} == set(want)
    assert sum(r.events for r in got) == len(rows)
    acts = {}
    for r in sessions.last_action(changes, "1 second").collect():
        acts.setdefault((r.project, r.start), {})[r.path] = r.action
    assert acts == want
    again = {}
    for r in sessions.actions_in(sessions.debounce(changes, "1 second"), changes, "1 second").collect():
        again.setdefault((r.project, r.start), {})[r.path] = r.action
    assert again == want


def test_an_exact_gap_does_not_split(spark):
    rows = [("p", "a.py", "add", at(0.5), 1, ""), ("p", "a.py", "change", at(1.5), 2, ""), ("p", "a.py", "unlink", at(2.6), 3, "")]
    got = sessions.settle(spark.createDataFrame(rows, CHANGES), "1 second").orderBy("start").collect()
    assert [(r.start, r.ts, r.action) for r in got] == [(at(0.5), at(1.5), "change"), (at(2.6), at(2.6), "unlink")]


def run(df, name, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def write_feed(spark, path, *batches):
    for batch in batches:
        spark.createDataFrame(batch, CHANGES).coalesce(1).write.mode("append").parquet(path)


def closing(seconds):
    """An event of another project, late enough to move the watermark past the rest."""
    return [("end", "end.py", "add", at(seconds), 10**6, "")]


def test_stream_agrees_with_batch(spark, tmp_path):
    path = str(tmp_path / "feed")
    rows = events(80, 2)
    write_feed(spark, path, rows[:40], rows[40:], closing(10_000))
    batch = spark.createDataFrame(rows, CHANGES)
    stream = feed.read_changes(spark, path)
    tuples = lambda df: sorted(map(tuple, df.collect()))
    # The marker itself is still open, so only the sessions before it come out.
    assert tuples(run(sessions.debounce(stream, "1 second"), "debounced")) == tuples(sessions.debounce(batch, "1 second"))
    assert tuples(run(sessions.settle(stream, "2 seconds"), "settled")) == tuples(sessions.settle(batch, "2 seconds"))
    # The second wait of the chain needs a later event to close; the markers do that.
    write_feed(spark, path, closing(20_000), closing(30_000), closing(40_000))
    chained = run(sessions.debounce_settled(stream, "2 seconds", "1 second"), "chained").filter("project <> 'end'")
    assert tuples(chained) == tuples(sessions.debounce_settled(batch, "2 seconds", "1 second"))
    counts = tuples(run(feed.change_stats(stream), "counted", "complete"))
    assert counts == tuples(feed.change_stats(spark.read.schema(CHANGES).parquet(path)))


def test_running_counts(spark, tmp_path):
    path = str(tmp_path / "feed")
    write_feed(spark, path, events(30, 6))
    query = feed.show_change_stats(feed.read_changes(spark, path), "running", "1 second")
    try:
        query.processAllAvailable()
        assert spark.table("running").agg(F.sum("changes")).first()[0] == 30
        write_feed(spark, path, events(20, 7))
        query.processAllAvailable()
        assert spark.table("running").agg(F.sum("changes")).first()[0] == 50
    finally:
        query.stop()


def test_filter_feed(spark):
    kept = feed.filter_feed(spark.createDataFrame(events(60, 3), CHANGES)).select("path").distinct().collect()
    assert {r.path for r in kept} == {"a.py", "b.py", "c.js"}


def test_maintain_index(spark, corpus, tmp_path):
    source, index, checkpoint = (str(tmp_path / name) for name in ("feed", "index", "checkpoint"))
    store.write_index(build_index(corpus(("one", "old.py", "old = 1\n"), ("one", "a.py", "before = 1\n"))), index)
    rows = [r for r in events(60, 4) if r[1] != "c.js"]
    half = len(rows) // 2

    def go():
        feed.maintain_index(spark, source, index, checkpoint).awaitTermination()

    def expected(seen):
        files = {("one", "old.py"): ("old = 1\n", START), ("one", "a.py"): ("before = 1\n", START)}
        for project, path, action, ts, _, text in seen:
            if path.endswith(".log") or path.startswith("dist/"):
                continue
            files.pop((project, path), None)
            if action != "unlink":
                files[project, path] = (text, ts)
        return sorted((p, path, text) for (p, path), (text, _) in files.items())

    def held():
        return sorted(tuple(r) for r in store.read_index(spark, index).files.select("project", "path", "content").collect())

    write_feed(spark, source, rows[:half], closing(5_000))
    go()
    assert held() == expected(rows[:half])
    runs = store.read_runs(spark, index).count()
    go()
    assert store.read_runs(spark, index).count() == runs
    # The marker's session closes with the next one; all its files are applied then.
    more = [(p, path, a, ts + timedelta(seconds=6_000), s, t) for p, path, a, ts, s, t in rows[half:]]
    write_feed(spark, source, more, closing(50_000))
    go()
    assert held() == sorted([*expected(rows[:half] + more), ("end", "end.py", "")])
    feed.flush(spark, source, index, "shutdown")
    flushed = store.read_index(spark, index)
    assert held() == sorted([*expected(rows[:half] + more), ("end", "end.py", "")])
    scan = flushed.files.select("project", "path", "content", "last_modified", "file_size")
    assert contents(flushed) == contents(build_index(scan))


def test_settled_paths_are_committed_once(spark, corpus, tmp_path):
    """A path that is written for some seconds counts when it is quiet, in every language of the index."""
    source, index, checkpoint = (str(tmp_path / name) for name in ("feed", "index", "checkpoint"))
    store.write_index(build_index(corpus(("one", "old.go", "package old\n"))), index)
    writing = [("one", "long.go", "change", at(i), i, f"version {i}\n") for i in range(6)]
    short = [("one", "short.py", "add", at(0.5), 10, "s = 1\n"), ("one", "debug.log", "add", at(1), 11, "no"), ("two", "old.go", "add", at(1), 12, "package two\n")]
    late = [("one", "old.go", "unlink", at(4), 13, None)]

    def go():
        feed.maintain_index(spark, source, index, checkpoint, quiet="2 seconds", languages=None).awaitTermination()

    def held():
        files = store.read_index(spark, index).files
        return {(r.project, r.path): r.content for r in files.filter("project <> 'end'").collect()}

    write_feed(spark, source, writing + short + late, closing(1_000))
    go()
    write_feed(spark, source, closing(2_000), closing(3_000), closing(4_000))
    go()
    want = {("one", "long.go"): "version 5\n", ("one", "short.py"): "s = 1\n", ("two", "old.go"): "package two\n"}
    assert held() == want
    # One version of the path was ever stored.
    files = spark.read.parquet(f"{index}/files").filter("path = 'long.go'")
    assert [r.content for r in files.collect()] == ["version 5\n"]
    runs = store.read_runs(spark, index).count()
    go()
    assert store.read_runs(spark, index).count() == runs and held() == want


def test_settled_in_sessions(spark):
    rows = events(120, 9)
    batch = spark.createDataFrame(rows, CHANGES)
    done = sessions.debounce_settled(batch, "2 seconds", "1 second")
    got = sessions.settled_in(done, batch, "2 seconds", "1 second").select("project", "path", "ts").distinct().collect()
    # Over a whole feed that is the last change before each quiet time.
    want = {}
    for project, path, _, ts, *_ in sorted(rows, key=lambda r: r[3]):
        own = want.setdefault((project, path), [])
        if own and ts - own[-1] <= timedelta(seconds=2):
            own[-1] = ts
        else:
            own.append(ts)
    last = {}
    for row in done.collect():
        for (project, path), times in want.items():
            inside = [t for t in times if project == row.project and row.start <= t + timedelta(seconds=2, microseconds=-1) <= row.last]
            if inside:
                last.setdefault((project, path), []).append(max(inside))
    assert sorted(map(tuple, got)) == sorted((p, f, t) for (p, f), times in last.items() for t in times)
