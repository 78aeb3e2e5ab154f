"""Queries over stores that are written to while they are read, and over the log as it arrives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import stores
from ..sources.tables import log_of, table
from ..sources.versioned import VersionedStore, last_wins
from ..streaming import log as streams
from .activity import _L, _STATE
from .base import SQL, query

_BATCHES = """batches as (
  select 'n' || c_custkey as id, c_name as title, c_mktsegment as topic, 1 as version, c_custkey as c, 1 as step from customer
  union all select 'n' || c_custkey, c_name || ' again', c_mktsegment, 3, c_custkey, 1 from customer where c_custkey % 2 = 0
  union all select 'n' || c_custkey, c_name, 'LATE', 2, c_custkey, 1 from customer where c_custkey % 3 = 0
  union all select 'n' || c_custkey, c_name, 'NEWEST', 4, c_custkey, 2 from customer where c_custkey % 5 = 0)"""


@query(
    "keyed_notes",
    f"""with {_BATCHES}, steps as (select 'written' as step, 1 as upto union all select 'compacted', 1 union all select 'replaced', 2)
select s.step, id, arg_max(title, version) as title, arg_max(topic, version) as topic, max(version) as version
from steps s join batches b on b.step <= s.upto group by all""",
)
def keyed_notes(spark, d):
    """Notes written in overlapping batches, older versions after newer ones; read, compacted and read again, and read
    once more after another batch."""
    store = VersionedStore(spark, stores.scratch(spark, "keyed"), "id string, title string, topic string, version int", ["id"], last_wins(["title", "topic", "version"]))
    c = F.col("c_custkey")
    base = table(spark, d, "customer").select(c, F.concat(F.lit("n"), c).alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("topic"))
    put = lambda rows, version: store.put(rows.withColumn("version", F.lit(version)).drop("c_custkey"))
    put(base, 1)
    put(base.where(c % 2 == 0).withColumn("title", F.concat("title", F.lit(" again"))), 3)
    put(base.where(c % 3 == 0).withColumn("topic", F.lit("LATE")), 2)
    written = store.read().withColumn("step", F.lit("written"))
    store.compact()
    compacted = store.read().withColumn("step", F.lit("compacted"))
    put(base.where(c % 5 == 0).withColumn("topic", F.lit("NEWEST")), 4)
    return written.unionByName(compacted).unionByName(store.read().withColumn("step", F.lit("replaced")))


def arriving(spark: SparkSession, sf_dir: str, path: str, go: Callable[[DataFrame], None], parts: int = 3) -> None:
    """The events in parts without order, each given to ``go`` as a stream of the log when it is there; what failed goes again."""
    events = table(spark, sf_dir, "events")
    for part in range(parts):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(parts)) == part).write.mode("append").parquet(f"{path}/in")
        stream = log_of(spark.readStream.schema(events.schema).parquet(f"{path}/in"))
        try:
            go(stream)
        except StreamingQueryException:
            go(stream)


def failing_once(sink: streams.Sink, number: int) -> streams.Sink:
    """``sink``, which fails after its work on a batch, so that the batch is played again."""
    left = [number]

    def put(batch: DataFrame, n: int) -> None:
        sink(batch, n)
        if n in left:
            left.clear()
            raise RuntimeError(f"batch {n} is played again")

    return put


@query("stream_log_tail", f"{_L} select event_id, user_id, kind, topic from log order by event_id desc limit 1000")
def stream_log_tail(spark, d):
    """The last 1000 events after three batches, the second of which came twice."""
    path = stores.scratch(spark, "tail")
    tail = streams.Tail(spark, path, "event_id bigint, user_id bigint, kind string, topic string")
    sink = failing_once(tail.put, 1)
    arriving(spark, d, path, lambda log: streams.run(log, sink, path))
    return tail.read()


@query("stream_dashboard", SQL["learner_dashboard"])
def stream_dashboard(spark, d):
    """The dashboard from partial sums that three batches left, the second of which came twice, compacted in between."""
    path = stores.scratch(spark, "dashboard")
    live = streams.LiveDashboard(spark, path)
    sink = failing_once(live.put, 1)

    def go(log: DataFrame) -> None:
        streams.run(log, sink, path)
        if len(live.days.manifest().batches) == 2:
            live.compact()

    arriving(spark, d, path, go)
    return live.read()


@query("stream_planner_toggles", f"{_L}{_STATE} select * from state")
def stream_planner_toggles(spark, d):
    """Each task's last toggle as custom state, from three batches without order; the watermark is behind the whole log."""
    path = stores.scratch(spark, "toggles")
    found: list[DataFrame] = []
    arriving(spark, d, path, lambda log: found.append(streams.last_toggles(log, path, "3650 days")))
    return found[-1]


