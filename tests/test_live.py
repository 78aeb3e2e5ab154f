"""Stores that are written to while they are read, and operators on streams."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillstream.operators import activity as act
from quillstream.plans.live import failing_once
from quillstream.sources.versioned import VersionedStore, last_wins
from quillstream.streaming import log as streams

NOTE = "id string, title string, version int"
LOG = "event_id long, user_id long, ts timestamp_ntz, kind string, topic string, score int, task_id int, done boolean"


@pytest.fixture
def store(spark, tmp_path):
    return VersionedStore(spark, f"file://{tmp_path}/notes", NOTE, ["id"], last_wins(["title", "version"]))


def notes(spark, *rows):
    return spark.createDataFrame(list(rows), NOTE)


def held(df) -> dict:
    rows = df.collect()
    found = {r.id: (r.title, r.version) for r in rows}
    assert len(found) == len(rows)
    return found


def test_last_version_wins_in_any_order(spark, store):
    assert held(store.read()) == {} and not store.compact()
    store.put(notes(spark, ("a", "new", 3), ("b", "b", 1), (None, "null", 1), ("a", "older", 2)))
    store.put(notes(spark, ("a", "late", 1), ("c", "c", 5), (None, "null again", 2)))
    wanted = {"a": ("new", 3), "b": ("b", 1), "c": ("c", 5), None: ("null again", 2)}
    assert held(store.read()) == wanted
    assert store.compact() and held(store.read()) == wanted and not store.manifest().batches
    store.put(notes(spark, ("b", "older", 0), ("c", "newer", 6), ("d", "d", 1), (None, "older", 1)))
    assert held(store.read()) == wanted | {"c": ("newer", 6), "d": ("d", 1)}
    store.put(notes(spark))
    assert held(store.read())["d"] == ("d", 1)


def test_equal_versions_give_the_same_row_before_and_after_compaction(spark, store):
    store.put(notes(spark, ("a", "x", 1)))
    store.put(notes(spark, ("a", "y", 1)))
    before = held(store.read())
    store.compact()
    store.put(notes(spark, ("a", "x", 1), ("b", "b", 1)))
    assert held(store.read())["a"] == before["a"]


def test_batches_that_are_played_again_count_once(spark, tmp_path):
    store = VersionedStore(spark, f"file://{tmp_path}/sums", "k string, n bigint", ["k"], {"n": F.sum})
    rows = lambda n: spark.createDataFrame([("a", n), ("b", 1)], "k string, n bigint")
    assert store.put(rows(5), ("log", 0)) and store.put(rows(7), ("log", 1)) and not store.put(rows(7), ("log", 1))
    store.compact()
    assert not store.put(rows(7), ("log", 1)) and not store.put(rows(5), ("log", 0)) and store.put(rows(1), ("other", 0))
    assert {r.k: r.n for r in store.read().collect()} == {"a": 13, "b": 3}


def test_a_batch_that_was_not_finished_is_no_part_of_the_store(spark, store, tmp_path):
    store.put(notes(spark, ("a", "a", 1)), ("log", 0))
    notes(spark, ("z", "half", 9)).write.parquet(f"file://{tmp_path}/notes/batch-log-{1:020d}")  # the writer died before its manifest
    assert held(store.read()) == {"a": ("a", 1)}
    assert store.put(notes(spark, ("b", "b", 1)), ("log", 1)) and held(store.read()) == {"a": ("a", 1), "b": ("b", 1)}


def test_writers_at_the_same_time_lose_nothing(spark, store):
    other = VersionedStore(spark, store.path, NOTE, ["id"], store.merge)
    store.put(notes(spark, ("a", "a", 1)))
    stale = [other.manifest()] * 2
    fresh = other.manifest
    store.put(notes(spark, ("b", "b", 1)))
    other.manifest = lambda: stale.pop() if stale else fresh()  # it looked before the other wrote
    assert other.put(notes(spark, ("c", "c", 1)))
    assert set(held(store.read())) == {"a", "b", "c"}


def test_batches_that_come_during_compaction_stay(spark, store):
    store.put(notes(spark, ("a", "a", 1)))
    read = store.read

    def slow(now=None):
        VersionedStore(spark, store.path, NOTE, ["id"], store.merge).put(notes(spark, ("a", "later", 2), ("b", "b", 1)))
        return read(now)

    store.read = slow
    assert store.compact()
    store.read = read
    assert len(store.manifest().batches) == 1 and held(store.read()) == {"a": ("later", 2), "b": ("b", 1)}


def test_of_two_compactions_one_is_dropped(spark, store):
    store.put(notes(spark, ("a", "a", 1)))
    read = store.read

    def slow(now=None):
        if not done:
            done.append(VersionedStore(spark, store.path, NOTE, ["id"], store.merge).compact())
        return read(now)

    done: list = []
    store.read = slow
    assert not store.compact() and done == [True]
    store.read = read
    assert held(store.read()) == {"a": ("a", 1)} and sum(n.startswith("base-") for n in store.folder.names()) == 1


def test_readers_keep_the_manifest_that_they_began_with(spark, store):
    store.put(notes(spark, ("a", "a", 1)))
    begun = store.read()
    store.put(notes(spark, ("a", "b", 2)))
    store.compact()
    assert held(begun) == {"a": ("a", 1)} and held(store.read()) == {"a": ("b", 2)}
    store.vacuum(keep=1)
    assert held(store.read()) == {"a": ("b", 2)} and [n for n in store.folder.names() if n != "manifest"] == [store.manifest().base]


def test_rows_of_the_base_that_no_batch_touches_are_not_shuffled(spark, store):
    store.put(notes(spark, *[(str(i), "t", 1) for i in range(100)]))
    store.compact()
    store.put(notes(spark, ("5", "u", 2)))
    df = store.read()
    assert held(df)["5"] == ("u", 2) and df.count() == 100
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan


# Streams.
def events(spark, rows):
    return spark.createDataFrame(rows, LOG)


def made(n: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    kinds = ["quiz_completed", "note_view", "planner_task_done", "chat_message", "upload_processed"]
    day = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(days=r.choice([0, 1, 2, 3, 7, 8, 9, 30, 31]), hours=r.randrange(24))
    out = []
    for i in range(n):
        kind = r.choice(kinds)
        out.append((i, r.randrange(6), day(), kind, r.choice(["nlp", "ml", "x_y", None, ""]), r.randrange(101) if kind == "quiz_completed" else None, r.randrange(1, 4), r.random() < 0.5))
    return out


def arrive(spark, tmp_path, rows, parts, go, batches=3):
    """Shuffled parts of rows, each streamed as it comes; a part that fails is played again."""
    shuffled = random.Random(1).sample(rows, len(rows))
    for k in range(batches):
        events(spark, shuffled[k::batches]).coalesce(parts).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(events(spark, []).schema).parquet(f"{tmp_path}/in")
        try:
            go(stream)
        except StreamingQueryException:
            go(stream)


def test_tail_is_bounded_and_safe_when_played_again(spark, tmp_path):
    rows = made(60, 2)
    tail = streams.Tail(spark, f"file://{tmp_path}/tail", "event_id bigint, kind string", 10)
    assert tail.read().count() == 0
    sink = failing_once(tail.put, 1)
    arrive(spark, tmp_path, rows, 2, lambda log: streams.run(log, sink, f"file://{tmp_path}/tail"))
    assert sorted(r.event_id for r in tail.read().collect()) == list(range(50, 60))
    tail.put(events(spark, rows[40:]), 9)  # the same events once more, in a batch of their own
    assert sorted(r.event_id for r in tail.read().collect()) == list(range(50, 60))
    assert len([x for x in tail.folder.names() if x.startswith("tail-")]) == 2


def test_a_half_written_tail_is_written_again(spark, tmp_path):
    tail = streams.Tail(spark, f"file://{tmp_path}", "event_id bigint, kind string", 3)
    tail.put(events(spark, made(5, 1)), 0)
    (tmp_path / f"tail-{1:020d}").mkdir()
    assert sorted(r.event_id for r in tail.read().collect()) == [2, 3, 4]
    tail.put(events(spark, [(9, *made(1, 1)[0][1:])]), 1)
    assert sorted(r.event_id for r in tail.read().collect()) == [3, 4, 9]


def test_runs_join_in_any_order(spark):
    d = lambda n: dt.date(2024, 1, n)
    parts = [[(d(5), d(5)), (d(1), d(2))], [(d(3), d(3))], [(d(9), d(9)), (d(2), d(3))], []]
    df = spark.createDataFrame([(1, p) for p in parts], "user_id long, runs array<struct<first:date,last:date>>")
    (row,) = df.groupBy("user_id").agg(act.joined_runs("runs").alias("runs")).collect()
    assert [tuple(x) for x in row.runs] == [(d(1), d(3)), (d(5), d(5)), (d(9), d(9))]


def test_live_dashboard_equals_the_whole_log(spark, tmp_path):
    rows = [*made(300, 5), (300, 7, None, "chat_message", "ml", None, 1, True), (301, 0, None, "note_view", None, None, 1, True)]
    live = streams.LiveDashboard(spark, f"file://{tmp_path}/live")
    sink = failing_once(live.put, 1)

    def go(log):
        streams.run(log, sink, f"file://{tmp_path}/live")
        if len(live.days.manifest().batches) == 2:
            live.compact()

    arrive(spark, tmp_path, rows, 2, go)
    assert {tuple(r) for r in live.read().collect()} == {tuple(r) for r in act.dashboard(events(spark, rows)).collect()}
    assert live.days.manifest().base and live.days.manifest().batches
    assert not any("/in/" in f for f in live.read().inputFiles())


def test_toggles_settle_by_event_id(spark, tmp_path):
    rows = made(200, 8)
    found = []
    arrive(spark, tmp_path, rows, 1, lambda log: found.append(streams.last_toggles(log, f"file://{tmp_path}/state", "400 days")))
    last: dict = {}
    for event_id, user, _, kind, _, _, task, done in rows:
        if kind == "planner_task_done":
            last[user, task] = (event_id, done)
    assert {(r.user_id, r.task_id): r.done for r in found[-1].collect()} == {k: v for k, (_, v) in last.items()}


def test_toggles_are_forgotten_after_their_time(spark, tmp_path):
    """State goes by the timer; then an older event id is news again, and rows behind the watermark are left out."""
    day = lambda n: dt.datetime(2024, 1, n)
    told: list = []
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.STATE_STORE)
    try:
        for n, batch in enumerate([[(5, 1, day(1), 1, True)], [(6, 2, day(20), 1, True)], [(3, 1, day(21), 1, False), (2, 1, day(2), 1, True)]]):
            events(spark, [(i, u, t, "planner_task_done", None, None, task, done) for i, u, t, task, done in batch]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(events(spark, []).schema).parquet(f"{tmp_path}/in")
            sink = lambda b, _, n=n: told.extend((n, r.user_id, r.event_id) for r in b.collect())
            streams.run(streams.planner_toggles(stream, "1 day", 3), sink, f"file://{tmp_path}/x", "update")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert told == [(0, 1, 5), (1, 2, 6), (2, 1, 3)]


def test_a_toggle_takes_two_calls_to_its_state():
    """A held toggle is read and written, its timer stays; when that fires early it moves on, and later it ends the state."""
    calls = []

    class Last:
        value = (5, True, 100)

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        def registerTimer(self, at):
            calls.append(at)

    class Fired:
        def __init__(self, at):
            self.at = at

        def getExpiryTimeInMs(self):
            return self.at

    toggles = streams._Toggles(10)
    toggles.last, toggles.handle = Last(), Handle()
    rows = [Row(user_id=1, task_id=2, event_id=i, done=i % 2 == 0, at=at) for i, at in ((4, 130), (8, 120), (7, 125))]
    assert [tuple(r) for r in toggles.handleInputRows((1, 2), iter(rows), None)] == [(1, 2, 8, True)]
    assert calls == ["get", "update"] and toggles.last.value == (8, True, 130)
    list(toggles.handleExpiredTimer((1, 2), None, Fired(110)))
    assert toggles.last.value == (8, True, 130) and calls[-1] == 140
    list(toggles.handleExpiredTimer((1, 2), None, Fired(140)))
    assert toggles.last.value is None
