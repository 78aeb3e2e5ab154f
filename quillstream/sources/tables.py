"""The driver's tables bound to the engine's roles (FIXTURES.md): activity log, uploads, attempts, questions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Event type, activity kind, study minutes.
KINDS = [
    ("signup", "upload_processed", 25),
    ("view", "note_view", 8),
    ("purchase", "quiz_completed", 20),
    ("error", "planner_task_done", 15),
    ("click", "chat_message", 5),
]
#: Topics by k % 6; 5 is no topic.
TOPICS = ["nlp", "ml", "ds", "generated", "all"]
#: Keys of the chat rules, in the order in which they are tried.
CHAT_KEYS = ["tokenization", "bert", "decision tree", "neural network", "weak areas", "summarize", "quiz"]
#: Rows up to which Spark chooses how responses are joined, and the rows of a task beyond that.
FEW_ROWS, TASK_ROWS = 4_000_000, 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(key: Column, pairs: list[tuple]) -> Column:
    """The value that stands with ``key`` in ``pairs``, null if none does."""
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in pairs])


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows of a table dealt out over all cores by ``keys``, four parts for each: for work that costs more than a shuffle.

    The parts that a file is read in don't tell how its rows lie: a row group is read by one task, and the others that its
    bytes were split over find nothing.
    """
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def meeting(rows: DataFrame) -> Callable[[DataFrame, DataFrame, str, str], DataFrame]:
    """How ``rows``, and what is made of them row by row, are joined with tables that grow with them: by (left, right, left
    key, right key).

    Spark broadcasts a table by the size of its files, which may hold fifty times as much in memory, in every task. Of many
    rows, both sides are therefore dealt out by the key, in as many parts as the rows need, and merged; what follows by the
    last key finds them so dealt. The rows are counted from the files' footers.
    """
    n = rows.count()
    if n <= FEW_ROWS:
        return lambda left, right, key, other: left.join(right, F.col(key) == F.col(other))
    parts = max(math.ceil(n / TASK_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return lambda left, right, key, other: left.repartition(parts, key).join(right.hint("merge"), F.col(key) == F.col(other))


def activity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, ts, kind, topic, score, filename, note_id, task_id, done, message, weak_topics of every event."""
    return log_of(table(spark, sf_dir, "events"))


def log_of(events: DataFrame) -> DataFrame:
    """The activity log of the events table, or of a stream of it."""
    k = F.get_json_object("props", "$.k").cast("int")
    events = events.withColumn("k", k).withColumn("kind", lookup(F.col("event_type"), [(e, kind) for e, kind, _ in KINDS]))
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    return events.select(
        "event_id",
        "user_id",
        "ts",
        "kind",
        F.get(F.array(*map(F.lit, TOPICS)), F.col("k") % 6).alias("topic"),
        of("quiz_completed", F.col("k")).alias("score"),
        of("upload_processed", F.concat(F.lit("file_"), "k", F.lit(".pdf"))).alias("filename"),
        of("note_view", F.col("k").cast("string")).alias("note_id"),
        of("planner_task_done", F.col("k") % 8 + 1).alias("task_id"),
        of("planner_task_done", F.col("k") % 2 == 0).alias("done"),
        of("chat_message", F.get(F.array(*map(F.lit, CHAT_KEYS)), F.col("k") % 7)).alias("message"),
        of("quiz_completed", F.slice(F.array(*map(F.lit, TOPICS)), F.col("k") % 2 + 1, F.col("k") % 5)).alias("weak_topics"),
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("filename", F.concat("source", F.lit("_"), "doc_id", F.lit(".txt")))


def notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads with pages and headings: a document's lines as paragraphs, a page mark before every seventh, a numbered
    heading before every fifth, some with bullets and tabs, line ends of both kinds."""
    at = lambda n, k: lambda i: i % n == k
    page, head, bullet = at(7, 0), at(5, 2), at(4, 1)
    n = lambda i: i.cast("string")
    line = lambda x, i: F.concat(
        F.when(page(i), F.concat(F.lit("[[PAGE_"), n((i / 7).cast("int") + 1), F.lit("]]\n"))).otherwise(""),
        F.when(head(i), F.concat(n((i / 5).cast("int") + 1), F.lit("."), n(i % 3 + 1), F.lit(" Study Of Part "), n(i), F.lit(":\r\n\n"))).otherwise(""),
        F.when(bullet(i), F.lit("• \t")).otherwise(""), x, F.lit("\n\n\n"),
    )
    return dealt(uploads(spark, sf_dir), "doc_id", "text").withColumn("text", F.array_join(F.transform(F.split("text", "\n"), line), ""))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """attempt_id, note_id, nth, topic, type, is_correct: a line item is a response, its part the question."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name", "p_size")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    meet = meeting(items)
    return (
        meet(meet(items, part, "l_partkey", "p_partkey"), orders, "l_orderkey", "o_orderkey")
        .select(
            F.col("l_orderkey").alias("attempt_id"), F.col("o_custkey").alias("note_id"), F.col("o_orderdate").alias("created_at"), "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate",
            F.col("p_brand").alias("topic"), F.col("p_type").alias("type"), F.col("p_name").alias("question"), F.col("p_size").alias("p_size"), (F.col("l_returnflag") == "N").alias("is_correct"),
            F.slice(F.array(*map(F.lit, "ABCD")), 1, F.col("p_size") % 5).alias("options"), F.when(F.col("p_size") % 7 > 0, "mcq").otherwise("theory").alias("kind"), (F.col("l_linenumber") % 4).alias("selected"), (F.col("p_size") % 4).alias("correct"), (F.col("l_returnflag") == "N").alias("self_assessment"),
        )
    )


_KIND_SQL = " ".join(f"when '{e}' then '{kind}'" for e, kind, _ in KINDS)
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
#: The activity log for DuckDB, as the first common table expression of a query.
LOG_SQL = f"""with raw as (
  select *, cast(json_extract_string(props, '$.k') as int) as k, case event_type {_KIND_SQL} end as kind from events),
log as (
  select event_id, user_id, cast(ts as timestamp) as ts, kind, {_LIST(TOPICS)}[k % 6 + 1] as topic,
    case when kind = 'quiz_completed' then k end as score,
    case when kind = 'upload_processed' then 'file_' || k || '.pdf' end as filename,
    case when kind = 'note_view' then cast(k as varchar) end as note_id,
    case when kind = 'planner_task_done' then k % 8 + 1 end as task_id,
    case when kind = 'planner_task_done' then k % 2 = 0 end as done,
    case when kind = 'chat_message' then {_LIST(CHAT_KEYS)}[k % 7 + 1] end as message,
    case when kind = 'quiz_completed' then {_LIST(TOPICS)}[k % 2 + 1 : k % 2 + k % 5] end as weak_topics
  from raw)"""
NOTEBOOKS_SQL = """notebooks as (
  select doc_id, source || '_' || doc_id || '.txt' as filename, array_to_string(list_transform(string_split(text, chr(10)), lambda x, k:
    case when (k - 1) % 7 = 0 then '[[PAGE_' || ((k - 1) // 7 + 1) || ']]' || chr(10) else '' end
    || case when (k - 1) % 5 = 2 then ((k - 1) // 5 + 1) || '.' || ((k - 1) % 3 + 1) || ' Study Of Part ' || (k - 1) || ':' || chr(13) || chr(10) || chr(10) else '' end
    || case when (k - 1) % 4 = 1 then '• ' || chr(9) else '' end || x || chr(10) || chr(10) || chr(10)), '') as t
  from documents)"""
RESPONSES_SQL = """responses as (
  select l_orderkey as attempt_id, o_custkey as note_id, l_linenumber, l_partkey, l_extendedprice, l_shipdate, p_brand as topic,
         p_type as type, p_name as question, p_size, l_returnflag = 'N' as is_correct, p_size % 5 as n_options, p_size % 7 > 0 as says_mcq, l_linenumber % 4 as selected, p_size % 4 as correct
  from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey)"""
