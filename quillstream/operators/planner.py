"""Revision planner: tasks, deadlines and their done-state from the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Id, title, topic, priority, estimate, day, date.
TASKS = [
    (1, "Review Decision Trees", "ML", "high", "15 min", "today", None),
    (2, "NLP Quiz — Tokenization", "NLP", "high", "25 min", "today", None),
    (3, "Read BERT Paper Summary", "NLP", "med", "20 min", "today", None),
    (4, "Linked List Revision", "DS", "low", "10 min", "today", None),
    (5, "Neural Networks Intro", "ML", "med", "30 min", "today", None),
    (6, "Graph Algorithms", "DS", "med", "45 min", "upcoming", "Tomorrow"),
    (7, "Dynamic Programming", "DS", "high", "60 min", "upcoming", "Mar 31"),
    (8, "System Design Basics", "SDE", "low", "30 min", "upcoming", "Apr 1"),
]
#: Text, date, color.
DEADLINES = [("ML Assignment #3", "Apr 2", "#e29578"), ("NLP Midterm Exam", "Apr 8", "#c1694f"), ("DS Project Due", "Apr 15", "#64b6ac")]


def tasks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TASKS, "task_id int, title string, topic string, priority string, est string, day string, date string")


def deadlines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEADLINES, "text string, date string, color string")


def state(log: DataFrame) -> DataFrame:
    """(user_id, task_id, done): each task's last toggle."""
    return log.where("kind = 'planner_task_done'").groupBy("user_id", "task_id").agg(F.max_by("done", "event_id").alias("done"))


def board(log: DataFrame) -> DataFrame:
    """Every user's tasks with their done-state."""
    every = log.select("user_id").distinct().crossJoin(F.broadcast(tasks(log.sparkSession)))
    return every.join(state(log), ["user_id", "task_id"], "left").withColumn("done", F.coalesce("done", F.lit(False)))


def progress(log: DataFrame) -> DataFrame:
    """(user_id, today, done, percent) over today's tasks; halves round up."""
    today = board(log).where("day = 'today'").groupBy("user_id").agg(F.count(F.lit(1)).alias("today"), F.count_if("done").alias("done"))
    return today.withColumn("percent", F.floor(100 * F.col("done") / F.col("today") + 0.5))


def toggles(log: DataFrame) -> DataFrame:
    """(event_id, task_id, done, title, topic): toggles with their task's title and lower-case topic, if it is known."""
    named = tasks(log.sparkSession).select("task_id", "title", F.lower("topic").alias("topic"))
    return log.where("kind = 'planner_task_done'").select("event_id", "task_id", "done").join(F.broadcast(named), "task_id", "left")
