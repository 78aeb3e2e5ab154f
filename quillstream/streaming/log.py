"""The activity log as a stream: daily counts, the last events, the dashboard's partial sums, the planner's done-state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import activity as act
from ..sources.versioned import Folder, VersionedStore

Sink = Callable[[DataFrame, int], None]
#: The one state store of Spark that keeps state variables and timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def daily_counts(log: DataFrame, late: str = "1 day") -> DataFrame:
    """Events per user and day of a streaming log; days close when the watermark passes them."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.to_date("w.start").alias("day"), "n")


def planner_state(log: DataFrame) -> DataFrame:
    """The last toggle of each task so far; the state is one row for each user and task."""
    return log.where("kind = 'planner_task_done'").groupBy("user_id", "task_id").agg(F.max_by("done", "event_id").alias("done"))


def drain(stream: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Runs an aggregated stream over all that is there and returns its result.

    Each batch appends the rows that it changed to Parquet under ``path``, where the stream's checkpoint is too; the
    result is the last row of each key. Nothing passes through the driver.
    """
    spark, schema = stream.sparkSession, stream.schema

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    changed = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{path}/rows")
    return changed.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")


def run(stream: DataFrame, sink: Sink, path: str, mode: str = "append") -> None:
    """Gives every batch of what is there to ``sink``; the checkpoint is under ``path``. A batch that fails is played again,
    under its number, by the next run."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()


class Tail:
    """The last ``n`` events of a streaming log, as bounded retention keeps them.

    A batch leaves a folder with the last ``n`` of its own last ``n`` and of the folder before, so what it reads and
    writes is bounded. Batches that are played again find their folder complete and leave it; an event that comes in two
    batches counts once. Readers take the newest complete folder, and the one before stays for those who have it open.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, n: int = act.LOG_CAP):
        self.spark, self.path, self.schema, self.n = spark, path, T.StructType.fromDDL(schema), n
        self.folder = Folder(spark, path)

    def _complete(self) -> list[str]:
        return [x for x in self.folder.names() if x.startswith("tail-") and "_SUCCESS" in self.folder.names(x)]

    def _rows(self, name: str | None) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}") if name else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows((self._complete() or [None])[-1])

    def put(self, batch: DataFrame, number: int) -> None:
        mine, found = f"tail-{number:020d}", self._complete()
        if mine in found:
            return
        before = [x for x in found if x < mine]
        rows = act.log_tail(batch.select(*self.schema.names), self.n).unionByName(self._rows((before or [None])[-1]))
        act.log_tail(rows.dropDuplicates(["event_id"]), self.n).write.mode("overwrite").parquet(f"{self.path}/{mine}")
        for old in before[:-1]:
            self.folder.delete(old)


class LiveDashboard:
    """The dashboard of a streaming log, kept as partial sums by user and day, by user and topic, and as runs of active days.

    A batch adds its own sums, aggregated from its rows alone; reading adds up sums, never the log. Each of the three is a
    :class:`VersionedStore`, in which a batch stands once however often it is played; ``compact`` adds them up for good.
    """

    def __init__(self, spark: SparkSession, path: str):
        store = lambda name, schema, keys, merge: VersionedStore(spark, f"{path}/{name}", schema, keys, merge)
        self.days = store("days", "user_id bigint, day date, n bigint, m bigint, q bigint", ["user_id", "day"], {c: F.sum for c in "nmq"})
        merges = {"n": F.sum, "first": F.min, "scores": F.sum, "scored": F.sum}
        self.topics = store("topics", "user_id bigint, topic string, n bigint, first bigint, scores bigint, scored bigint", ["user_id", "topic"], merges)
        self.runs = store("runs", "user_id bigint, runs array<struct<first:date,last:date>>", ["user_id"], {"runs": act.joined_runs})

    def put(self, batch: DataFrame, number: int) -> None:
        batch.persist()
        for store, part in ((self.days, act.day_sums), (self.topics, act.topic_sums), (self.runs, act.day_runs)):
            store.put(part(batch), ("log", number))
        batch.unpersist()

    def compact(self) -> None:
        for store in (self.days, self.topics, self.runs):
            store.compact()

    def read(self, as_of: str | None = None) -> DataFrame:
        return act.dashboard_of_sums(self.days.read(), self.topics.read(), self.runs.read(), as_of)


class _Toggles(StatefulProcessor):
    """The last toggle of one task of one user: the one with the highest event id, in whatever order toggles come.

    Each call to the state goes to Spark and back, so a toggle takes two: a task has one timer, which is not moved by
    later toggles but moves on when it fires.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "event_id bigint, done boolean, seen bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.last.get()
        newest, seen = (held[0], held[1]) if held else (-1, None), held[2] if held else 0
        for row in rows:
            if row.event_id > newest[0]:
                newest = (row.event_id, row.done)
            seen = max(seen, row.at)
        if not held or newest[0] > held[0] or seen > held[2]:
            self.last.update((newest[0], newest[1], seen))
        if not held:
            self.handle.registerTimer(seen + self.keep_ms)
        if not held or newest[0] > held[0]:
            yield Row(user_id=key[0], task_id=key[1], event_id=newest[0], done=newest[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.last.get()
        if held and held[2] + self.keep_ms > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(held[2] + self.keep_ms)  # toggled since: the one timer of a task moves on when it fires
        else:
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def planner_toggles(log: DataFrame, late: str = "1 day", keep_days: int = 90) -> DataFrame:
    """(user_id, task_id, event_id, done): each task's last toggle whenever it changes, as custom state.

    The state is one value for each user and task. It goes ``keep_days`` after the task's last toggle, when the watermark
    (``late`` behind the newest event) passes that time; rows later than the watermark are left out, so a toggle can't
    come back that has been forgotten.
    """
    timed = log.where("kind = 'planner_task_done'").select("user_id", "task_id", "event_id", "done", F.col("ts").cast("timestamp").alias("ts"))
    timed = timed.withColumn("at", F.unix_millis("ts")).withWatermark("ts", late)
    schema = "user_id bigint, task_id int, event_id bigint, done boolean"
    return timed.groupBy("user_id", "task_id").transformWithState(_Toggles(keep_days * 86_400_000), schema, "Update", "EventTime")


def last_toggles(log: DataFrame, path: str, late: str = "1 day", keep_days: int = 90) -> DataFrame:
    """Runs :func:`planner_toggles` over all that is there, and gives (user_id, task_id, done) from what it told."""
    stream = planner_toggles(log, late, keep_days)
    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    told = VersionedStore(spark, f"{path}/told", "user_id bigint, task_id int, event_id bigint, done boolean", ["user_id", "task_id"], {"event_id": F.max, "done": lambda c: F.max_by(c, "event_id")})
    before = spark.conf.get(name, None)
    spark.conf.set(name, STATE_STORE)  # a query takes its state store from the session, when it starts
    try:
        run(stream, lambda batch, number: told.put(batch, ("toggles", number)), path, "update")
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    return told.read().select("user_id", "task_id", "done")
