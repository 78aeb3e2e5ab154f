"""Activity-log analytics: every operator takes a log (see ``sources.tables``), and ``as_of`` where time matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import KINDS, lookup

#: The base topics.
BASE_TOPICS = [("nlp", "NLP & Text", "teal"), ("ml", "ML Models", "coral"), ("ds", "Data Structures", "aqua")]
COLORS = ["teal", "coral", "aqua"]
HEATMAP_WEEKS, MONTHS, LOG_CAP, TOPIC_ROWS = 18, 12, 1000, 6


def day(ts: Column | str = "ts") -> Column:
    return F.to_date(ts)


def with_as_of(log: DataFrame, as_of: str | None = None) -> DataFrame:
    """Adds ``as_of``: the given day, else the log's last day (one row, broadcast)."""
    if as_of:
        return log.withColumn("as_of", F.lit(as_of).cast("date"))
    return log.crossJoin(F.broadcast(log.agg(F.max(day()).alias("as_of"))))


def log_tail(log: DataFrame, n: int = LOG_CAP) -> DataFrame:
    """The last ``n`` events of the log: what bounded retention keeps."""
    return log.orderBy(F.desc("event_id")).limit(n)


def recent(log: DataFrame, n: int = 8) -> DataFrame:
    """The last ``n`` events of every user, newest first by ``rank``."""
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return log.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)


def active_days(log: DataFrame) -> DataFrame:
    return log.select("user_id", day().alias("day")).where("day is not null").distinct()


def current_streak(log: DataFrame, as_of: str | None = None) -> DataFrame:
    """(user_id, streak): consecutive active days that end on ``as_of``, 0 without activity then."""
    days = with_as_of(log, as_of).select("user_id", day().alias("day"), "as_of").distinct()
    w = Window.partitionBy("user_id").orderBy(F.desc("day"))
    run = F.date_diff("as_of", "day") == F.row_number().over(w) - 1
    return days.withColumn("run", run).groupBy("user_id").agg(F.count_if("run").alias("streak"))


def longest_streak(log: DataFrame) -> DataFrame:
    """(user_id, longest): the longest run of consecutive active days at any time."""
    w = Window.partitionBy("user_id").orderBy("day")
    runs = active_days(log).withColumn("island", F.date_sub("day", F.row_number().over(w)))
    return runs.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


def minutes() -> Column:
    return F.coalesce(lookup(F.col("kind"), [(kind, m) for _, kind, m in KINDS]), F.lit(0))


def study_minutes(log: DataFrame) -> DataFrame:
    return log.groupBy("user_id").agg(F.sum(minutes()).alias("minutes"))


def study_time(log: DataFrame) -> DataFrame:
    """Minutes as hours and the suffix ``h MMm``."""
    m = F.col("minutes")
    return study_minutes(log).select("user_id", F.floor(m / 60).cast("string").alias("value"), F.format_string("h %02dm", m % 60).alias("suffix"))


def topic_counts(log: DataFrame) -> DataFrame:
    """(user_id, topic, n, first, average): events, the first event and the average of whole quiz scores per topic."""
    return log.where("topic is not null and topic <> ''").groupBy("user_id", "topic").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.avg(F.when(F.col("kind") == "quiz_completed", F.col("score").cast("int"))).alias("average")
    )


def topic_unknown(log: DataFrame) -> DataFrame:
    base = log.sparkSession.createDataFrame([(t,) for t, _, _ in BASE_TOPICS], "topic string")
    return topic_counts(log).join(F.broadcast(base), "topic", "left_anti").select("user_id", "topic", "n", "first", "average")


def _pct(weight: int) -> Column:
    n = F.least(F.lit(99), F.coalesce("n", F.lit(0)) * weight)
    return F.when(F.col("average").isNotNull(), F.least(F.lit(99), F.greatest(n, F.bround("average").cast("bigint")))).otherwise(n).cast("bigint")


def topic_summary(log: DataFrame) -> DataFrame:
    """(user_id, place, id, name, sub, pct, color): the base topics in order, then other topics by events, six in all."""
    spark = log.sparkSession
    base = spark.createDataFrame([(i, *t) for i, t in enumerate(BASE_TOPICS)], "place long, topic string, name string, color string")
    counts = topic_counts(log)
    n = F.coalesce("n", F.lit(0))
    known = (
        log.select("user_id").distinct().crossJoin(F.broadcast(base)).join(counts, ["user_id", "topic"], "left")
        .select("user_id", "place", F.col("topic").alias("id"), "name", F.when(n > 0, F.concat(n, F.lit(" recent actions"))).otherwise("Start studying to build this topic").alias("sub"), _pct(12).alias("pct"), "color")
    )
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "first"))
    label = F.when(F.col("topic") == "generated", "Generated Notes").otherwise(F.initcap(F.replace(F.col("topic"), F.lit("_"), F.lit(" "))))
    other = topic_unknown(log).withColumn("place", (rank + len(BASE_TOPICS) - 1).cast("bigint")).where(F.col("place") < TOPIC_ROWS)
    other = other.select(
        "user_id", "place", F.col("topic").alias("id"), label.alias("name"), F.concat("n", F.lit(" recent actions")).alias("sub"),
        _pct(10).alias("pct"), F.get(F.array(*map(F.lit, COLORS)), (F.col("place") % 3).cast("int")).alias("color"),
    )
    return known.unionByName(other)


def mastered(log: DataFrame) -> DataFrame:
    """(user_id, topics_mastered): topics of the summary at 80 percent or more, from one count per topic."""
    return mastered_of(topic_counts(log))


def mastered_of(counts: DataFrame) -> DataFrame:
    """:func:`mastered` of what :func:`topic_counts` gives."""
    counts = counts.withColumn("base", F.col("topic").isin([t for t, _, _ in BASE_TOPICS]))
    rank = F.row_number().over(Window.partitionBy("user_id", "base").orderBy(F.desc("n"), "first"))
    shown = F.when(F.col("base"), _pct(12)).when(rank <= TOPIC_ROWS - len(BASE_TOPICS), _pct(10))
    return counts.withColumn("pct", shown).groupBy("user_id").agg(F.count_if(F.col("pct") >= 80).alias("topics_mastered"))


def mastery(log: DataFrame) -> DataFrame:
    """(user_id, topics_mastered, mastery)."""
    events = log.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))
    return events.join(mastered(log), "user_id", "left").select("user_id", *_mastery())


def _mastery() -> list[Column]:
    n = F.coalesce("topics_mastered", F.lit(0)).cast("bigint")
    return [n.alias("topics_mastered"), F.least(F.lit(99), F.col("events") * 2 + n * 3).alias("mastery")]


def daily_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("user_id", day().alias("day")).agg(F.count(F.lit(1)).alias("n")).where("day is not null")


def monthly_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("user_id", F.trunc("ts", "MM").alias("month")).agg(F.count(F.lit(1)).alias("n")).where("month is not null")


def heatmap(log: DataFrame, as_of: str | None = None) -> DataFrame:
    """(user_id, week, day, date, level, tip): 126 days that end on ``as_of``, in columns of seven."""
    last = HEATMAP_WEEKS * 7 - 1
    users = with_as_of(log, as_of).select("user_id", "as_of").distinct()
    cells = users.select("user_id", F.posexplode(F.sequence(F.date_sub("as_of", last), "as_of")).alias("i", "date"))
    n = F.coalesce("n", F.lit(0))
    level = F.when(n == 0, "").when(n >= 4, "l4").otherwise(F.concat(F.lit("l"), n))
    tip = F.when(n == 0, "No activity").when(n == 1, "1 activity").otherwise(F.concat(n, F.lit(" activities")))
    counts = daily_counts(log).withColumnRenamed("day", "date")
    return cells.join(counts, ["user_id", "date"], "left").select("user_id", F.floor(F.col("i") / 7).alias("week"), (F.col("i") % 7).alias("day"), "date", level.alias("level"), tip.alias("tip"))


def monthly_bar(log: DataFrame, as_of: str | None = None) -> DataFrame:
    """(user_id, place, month, value): the current month and the eleven before it."""
    users = with_as_of(log, as_of).select("user_id", F.trunc("as_of", "MM").alias("now")).distinct()
    months = users.select("user_id", F.posexplode(F.sequence(F.add_months("now", 1 - MONTHS), "now", F.expr("interval 1 month"))).alias("place", "month"))
    value = F.least(F.lit(100), F.coalesce("n", F.lit(0)) * 6)
    return months.join(monthly_counts(log), ["user_id", "month"], "left").select(
        "user_id", F.col("place").cast("bigint").alias("place"), F.date_format("month", "MMM").alias("month"), value.alias("value"),
    )


def bar_normalized(log: DataFrame) -> DataFrame:
    """Bars scaled to 80 for each user's largest."""
    top = F.greatest(F.max("value").over(Window.partitionBy("user_id")), F.lit(1))
    return monthly_bar(log).select("user_id", "place", "month", (F.col("value") / top * 80).alias("height"))


def recent_quizzes(log: DataFrame, n: int = 3) -> DataFrame:
    s = F.col("score")
    title = F.coalesce(F.initcap("topic"), F.lit("Quiz"))
    return recent(log.where("kind = 'quiz_completed'"), n).select(
        "user_id", "rank", title.alias("title"), s.cast("bigint").alias("score"),
        F.when(s >= 85, "Easy").when(s >= 65, "Medium").otherwise("Hard").alias("difficulty"),
        F.when(s >= 60, "✓").otherwise("~").alias("icon"),
        F.when(s >= 85, "green").when(s >= 65, "teal").otherwise("coral").alias("variant"),
    )


def latest_by_kind(log: DataFrame) -> DataFrame:
    return log.groupBy("user_id", "kind").agg(F.max("event_id").alias("event_id"), F.max_by("ts", "event_id").alias("ts"))


def kpi_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("user_id").agg(
        F.count_if(F.col("kind") == "quiz_completed").alias("quizzes"),
        F.count_if((F.col("kind") == "planner_task_done") & F.col("done")).alias("tasks_done"), F.count(F.lit(1)).alias("events"),
    )


#: Icon and title of each tip, and what its body says around its value.
TIPS = [
    ("📄", "New Upload Detected", "", " was processed. Turn it into notes and a quick quiz next."),
    ("🎯", "Quiz Feedback", "Your latest quiz score was ", "%. Review the missed concepts before the next session."),
    ("!", "Recommended Revision", "Focus next on ", ". These came from your latest quiz responses."),
    ("✅", "Planner Momentum", "You completed ", " planner task(s). Keep the streak moving with a short review block."),
]


def tips(log: DataFrame) -> DataFrame:
    """(user_id, place, icon, title, body): at most three of the tips that apply, in a fixed order. One pass over the log."""
    last = lambda value, kind: F.max_by(F.when(F.col("kind") == kind, value), F.when(F.col("kind") == kind, F.col("event_id")))
    weak = F.coalesce("weak_topics", F.array().cast("array<string>")) if "weak_topics" in log.columns else F.array().cast("array<string>")
    facts = log.groupBy("user_id").agg(
        last(F.coalesce("filename", F.lit("Your file")), "upload_processed").alias("file"), last(F.coalesce("score", F.lit(0)), "quiz_completed").alias("score"),
        last(F.array_join(F.slice(weak, 1, 3), ", "), "quiz_completed").alias("weak"), F.nullif(F.count_if((F.col("kind") == "planner_task_done") & F.col("done")), F.lit(0)).alias("tasks"),
    )
    values = [F.col("file"), F.col("score").cast("string"), F.nullif("weak", F.lit("")), F.col("tasks").cast("string")]
    all_ = F.array(
        *[
            F.when(
                v.isNotNull(),
                F.struct(F.lit(icon).alias("icon"), F.lit(title).alias("title"), F.concat(F.lit(before), v, F.lit(after)).alias("body")),
            ) for v, (icon, title, before, after) in zip(values, TIPS, strict=True)
        ]
    )
    return facts.select("user_id", F.posexplode(F.slice(F.filter(all_, lambda t: t.isNotNull()), 1, 3)).alias("place", "t")).select("user_id", F.col("place").cast("bigint").alias("place"), "t.*")


def labels(log: DataFrame) -> DataFrame:
    """(event_id, label): what an event is called in the feed."""
    kind = F.col("kind")
    label = (
        F.when(kind == "upload_processed", F.concat(F.lit("Uploaded "), F.coalesce("filename", F.lit("a file"))))
        .when(kind == "quiz_completed", F.concat(F.lit("Finished quiz with "), F.coalesce("score", F.lit(0)), F.lit("%")))
        .when(kind == "note_view", F.lit("Opened a note (cornell)"))
        .when(kind == "planner_task_done", F.concat(F.when(F.col("done"), "Completed").otherwise("Reopened"), F.lit(" task "), "task_id"))
        .when(kind == "chat_message", F.lit("Asked the assistant a question"))
        .otherwise(F.replace(kind, F.lit("_"), F.lit(" ")))
    )
    return log.select("event_id", label.alias("label"))


def long_term_stats(log: DataFrame, as_of: str | None = None) -> DataFrame:
    """(user_id, total_activities, longest_streak, active_days); the streak shown is the current one, as it always was."""
    days = active_days(log).groupBy("user_id").agg(F.count(F.lit(1)).alias("active_days"))
    events = log.groupBy("user_id").agg(F.format_number(F.count(F.lit(1)), 0).alias("total_activities"))
    return events.join(days, "user_id").join(current_streak(log, as_of), "user_id").select("user_id", "total_activities", F.concat("streak", F.lit(" days")).alias("longest_streak"), "active_days")


def dashboard(log: DataFrame, as_of: str | None = None) -> DataFrame:
    """One row per learner: every KPI of the dashboard. Two aggregates of the log, by day and by topic."""
    days = log.groupBy("user_id", day().alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(minutes()).alias("m"), F.count_if(F.col("kind") == "quiz_completed").alias("q"))
    last = F.lit(as_of).cast("date") if as_of else F.col("as_of")
    dated = days if as_of else days.crossJoin(F.broadcast(log.agg(F.max(day()).alias("as_of"))))  # one row
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("day")))
    facts = dated.withColumn("run", F.date_diff(last, F.col("day")) == place - 1).groupBy("user_id").agg(
        F.sum("n").alias("events"), F.sum("m").alias("study_minutes"), F.sum("q").alias("quizzes"), F.count("day").alias("active_days"), F.count_if("run").alias("streak")
    )
    time = F.concat(F.floor(F.col("study_minutes") / 60), F.format_string("h %02dm", F.col("study_minutes") % 60))
    return facts.join(mastered(log), "user_id", "left").select("user_id", "events", "study_minutes", time.alias("study_time"), "quizzes", "active_days", "streak", *_mastery())


def day_sums(log: DataFrame) -> DataFrame:
    """(user_id, day, n, m, q): events, study minutes and quizzes; sums that add up over parts of a log."""
    return log.groupBy("user_id", day().alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(minutes()).alias("m"), F.count_if(F.col("kind") == "quiz_completed").alias("q"))


def topic_sums(log: DataFrame) -> DataFrame:
    """(user_id, topic, n, first, scores, scored): :func:`topic_counts` in parts that add up."""
    score = F.when(F.col("kind") == "quiz_completed", F.col("score").cast("int"))
    return log.where("topic is not null and topic <> ''").groupBy("user_id", "topic").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.coalesce(F.sum(score), F.lit(0)).alias("scores"), F.count(score).alias("scored")
    )


def day_runs(log: DataFrame) -> DataFrame:
    """(user_id, runs): the runs of consecutive active days, as first and last days."""
    days = log.groupBy("user_id").agg(F.collect_set(day()).alias("days"))
    return days.select("user_id", F.transform("days", lambda d: F.struct(d.alias("first"), d.alias("last"))).alias("runs"))


def joined_runs(column: str) -> Column:
    """Aggregates lists of runs into one, in order; runs that overlap or follow each other are one run."""
    runs = F.array_sort(F.flatten(F.collect_list(column)))
    none = F.array().cast("array<struct<first:date,last:date>>")

    def add(joined: Column, run: Column) -> Column:
        end = F.element_at(joined, -1)
        longer = F.struct(end["first"].alias("first"), F.greatest(end["last"], run["last"]).alias("last"))
        meets = (F.size(joined) > 0) & (run["first"] <= F.date_add(F.try_element_at(joined, F.lit(-1))["last"], 1))
        return F.when(meets, F.concat(F.slice(joined, 1, F.size(joined) - 1), F.array(longer))).otherwise(F.concat(joined, F.array(run)))

    return F.aggregate(runs, none, add)


def dashboard_of_sums(days: DataFrame, topics: DataFrame, runs: DataFrame, as_of: str | None = None) -> DataFrame:
    """:func:`dashboard` from sums by day, sums by topic and runs of active days."""
    last = F.lit(as_of).cast("date") if as_of else F.col("as_of")
    dated = runs if as_of else runs.crossJoin(F.broadcast(days.agg(F.max("day").alias("as_of"))))  # one row
    length = lambda r, end: F.date_diff(end, r["first"]) + 1
    now = F.filter("runs", lambda r: (r["first"] <= last) & (r["last"] >= last))
    streak = F.coalesce(length(F.try_element_at(now, F.lit(1)), last), F.lit(0)).cast("bigint")
    active = F.aggregate("runs", F.lit(0).cast("bigint"), lambda a, r: a + length(r, r["last"]))
    facts = days.groupBy("user_id").agg(F.sum("n").alias("events"), F.sum("m").alias("study_minutes"), F.sum("q").alias("quizzes"))
    facts = facts.join(dated.select("user_id", active.alias("active_days"), streak.alias("streak")), "user_id")
    counts = topics.select("user_id", "topic", "n", "first", F.when(F.col("scored") > 0, F.col("scores") / F.col("scored")).alias("average"))
    time = F.concat(F.floor(F.col("study_minutes") / 60), F.format_string("h %02dm", F.col("study_minutes") % 60))
    return facts.join(mastered_of(counts), "user_id", "left").select("user_id", "events", "study_minutes", time.alias("study_time"), "quizzes", "active_days", "streak", *_mastery())


#: What an event may hold besides its kind.
FIELDS = {
    "ts": "timestamp_ntz", "topic": "string", "view": "string", "filename": "string", "note_id": "string", "format": "string", "score": "int", "total": "int", "message": "string", "task_id": "int", "done": "boolean",
}


def ingest(raw: DataFrame) -> DataFrame:
    """Merges the ``extra`` map of raw events last: its fields win, but for ``kind``, which it may not set.

    Every field of ``FIELDS`` becomes a column, null where neither has it or its text is of the wrong type; fields of
    other names stay in ``extra``.
    """
    own = lambda c: F.col(c).cast("string") if c in raw.columns else F.lit(None).cast("string")
    given = lambda c, kind: F.coalesce(F.try_element_at("extra", F.lit(c)), own(c)).try_cast(kind).alias(c)
    others = F.map_filter("extra", lambda k, _: ~k.isin([*FIELDS, "kind"]))
    return raw.select("event_id", "user_id", "kind", *[given(c, kind) for c, kind in FIELDS.items()], others.alias("extra"))

