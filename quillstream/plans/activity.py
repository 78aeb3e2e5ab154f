"""Queries over the activity log and the planner."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import activity as act
from ..operators import planner
from ..sources.stores import append, read, scratch
from ..sources.tables import KINDS, LOG_SQL, activity_log, log_of, table
from ..streaming import log as streams
from .base import query

_L = LOG_SQL
_AS_OF = "(select max(cast(ts as date)) from log)"
_MIN = "case kind " + " ".join(f"when '{k}' then {m}" for _, k, m in KINDS) + " else 0 end"
_TOPIC = """, counts as (
  select user_id, topic, count(*) as n, min(event_id) as first, avg(case when kind = 'quiz_completed' then score end) as average
  from log where topic is not null group by all),
base(place, topic, name, color) as (values (0, 'nlp', 'NLP & Text', 'teal'), (1, 'ml', 'ML Models', 'coral'), (2, 'ds', 'Data Structures', 'aqua')),
other as (select *, 2 + row_number() over (partition by user_id order by n desc, first) as place from counts where topic not in ('nlp', 'ml', 'ds')),
summary as (
  select u.user_id, b.place, b.topic as id, b.name, case when n > 0 then n || ' recent actions' else 'Start studying to build this topic' end as sub,
         case when average is null then least(99, coalesce(n, 0) * 12) else least(99, greatest(least(99, coalesce(n, 0) * 12), cast(round_even(average, 0) as bigint))) end as pct, b.color
  from (select distinct user_id from log) u cross join base b left join counts c on c.user_id = u.user_id and c.topic = b.topic
  union all
  select user_id, place, topic, case topic when 'generated' then 'Generated Notes' else upper(topic[1]) || lower(topic[2:]) end, n || ' recent actions',
         case when average is null then least(99, n * 10) else least(99, greatest(least(99, n * 10), cast(round_even(average, 0) as bigint))) end,
         ['teal', 'coral', 'aqua'][place % 3 + 1]
  from other where place < 6)"""
_STREAK = f""", days as (select distinct user_id, cast(ts as date) as d from log),
streaks as (select user_id, count(*) filter (where date_diff('day', d, {_AS_OF}) = r - 1) as streak
            from (select *, row_number() over (partition by user_id order by d desc) as r from days) group by user_id)"""
_MASTERY = """, mastered as (
  select l.user_id, topics_mastered, least(99, events * 2 + topics_mastered * 3) as mastery
  from (select user_id, count(*) as events from log group by 1) l
  join (select user_id, count(*) filter (where pct >= 80) as topics_mastered from summary group by 1) s using (user_id))"""
_TASKS = "tasks(task_id, title, topic, priority, est, day, date) as (values " + ", ".join(
    "(" + ", ".join("null" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in t) + ")" for t in planner.TASKS
) + ")"
_STATE = ", state as (select user_id, task_id, arg_max(done, event_id) as done from log where kind = 'planner_task_done' group by all)"
_BARS = f""", months as (select user_id, unnest(range(12)) as place from (select distinct user_id from log)),
dated as (select user_id, place, cast(date_trunc('month', {_AS_OF}) - to_months(cast(11 - place as int)) as date) as m from months),
per as (select user_id, cast(date_trunc('month', ts) as date) as m, count(*) as n from log group by all),
bars as (select user_id, place, strftime(m, '%b') as month, least(100, coalesce(n, 0) * 6) as value from dated left join per using (user_id, m))"""
_RANK = "row_number() over (partition by user_id order by event_id desc)"
_DAYS = ["user_id", "day", "n"]


@query("study_minutes", f"{_L} select user_id, cast(sum({_MIN}) as bigint) as minutes from log group by 1")
def study_minutes(spark, d):
    return act.study_minutes(activity_log(spark, d))


@query(
    "study_time_fmt",
    f"{_L}, m as (select user_id, cast(sum({_MIN}) as bigint) as m from log group by 1) select user_id, cast(m // 60 as varchar) as value, "
    f"printf('h %02dm', m % 60) as suffix from m",
)
def study_time_fmt(spark, d):
    return act.study_time(activity_log(spark, d))


@query("active_days", f"{_L} select distinct user_id, cast(ts as date) as day from log")
def active_days(spark, d):
    return act.active_days(activity_log(spark, d))


@query("current_streak", f"{_L}{_STREAK} select * from streaks")
def current_streak(spark, d):
    return act.current_streak(activity_log(spark, d))


@query(
    "longest_streak",
    f"{_L}, days as (select distinct user_id, cast(ts as date) as d from log), i as (select *, d - cast(row_number() over (partition by user_id "
    f"order by d) as int) as g from days), r as (select user_id, g, count(*) as n from i group by all) select user_id, max(n) as longest from r "
    f"group by 1",
)
def longest_streak(spark, d):
    return act.longest_streak(activity_log(spark, d))


@query("log_tail_1000", f"{_L} select event_id, user_id, kind, topic from log order by event_id desc limit 1000")
def log_tail_1000(spark, d):
    return act.log_tail(activity_log(spark, d).select("event_id", "user_id", "kind", "topic"))


@query("recent_activity", f"{_L}, r as (select user_id, {_RANK} as rank, event_id, kind from log) select * from r where rank <= 8")
def recent_activity(spark, d):
    return act.recent(activity_log(spark, d)).select("user_id", "rank", "event_id", "kind")


@query("quiz_events", f"{_L} select event_id, user_id, topic, score from log where kind = 'quiz_completed'")
def quiz_events(spark, d):
    return activity_log(spark, d).where("kind = 'quiz_completed'").select("event_id", "user_id", "topic", "score")


@query("topic_counts", f"{_L} select user_id, topic, count(*) as n, min(event_id) as first from log where topic is not null group by all")
def topic_counts(spark, d):
    return act.topic_counts(activity_log(spark, d)).drop("average")


@query("topic_avg_score", f"{_L} select user_id, topic, round(avg(score), 6) as average from log where kind = 'quiz_completed' and topic is not null group by all")
def topic_avg_score(spark, d):
    return act.topic_counts(activity_log(spark, d)).where("average is not null").select("user_id", "topic", F.round("average", 6).alias("average"))


@query("topic_unknown", f"{_L} select user_id, topic, count(*) as n, min(event_id) as first from log where topic is not null and topic not in ('nlp', 'ml', 'ds') group by all")
def topic_unknown(spark, d):
    return act.topic_unknown(activity_log(spark, d)).drop("average")


@query("topic_summary", f"{_L}{_TOPIC} select * from summary")
def topic_summary(spark, d):
    return act.topic_summary(activity_log(spark, d))


@query("mastery_kpi", f"{_L}{_TOPIC}{_MASTERY} select * from mastered")
def mastery_kpi(spark, d):
    return act.mastery(activity_log(spark, d))


@query(
    "kpi_counts",
    f"{_L} select user_id, count(*) filter (where kind = 'quiz_completed') as quizzes, count(*) filter (where kind = 'planner_task_done' and done) "
    f"as tasks_done, count(*) as events from log group by 1",
)
def kpi_counts(spark, d):
    return act.kpi_counts(activity_log(spark, d))


@query("daily_counts", f"{_L} select user_id, cast(ts as date) as day, count(*) as n from log group by all")
def daily_counts(spark, d):
    return act.daily_counts(activity_log(spark, d))


@query("monthly_counts", f"{_L} select user_id, cast(date_trunc('month', ts) as date) as month, count(*) as n from log group by all")
def monthly_counts(spark, d):
    return act.monthly_counts(activity_log(spark, d))


@query(
    "heatmap",
    f"""{_L}, cells as (select user_id, unnest(range(126)) as i from (select distinct user_id from log)),
dated as (select user_id, i, cast({_AS_OF} - cast(125 - i as int) as date) as d from cells),
per as (select user_id, cast(ts as date) as d, count(*) as n from log group by all)
select user_id, i // 7 as week, i % 7 as day, d as date, case when coalesce(n, 0) = 0 then '' when n >= 4 then 'l4' else 'l' || n end as level,
case when coalesce(n, 0) = 0 then 'No activity' when n = 1 then '1 activity' else n || ' activities' end as tip from dated left join per using (user_id, d)""",
)
def heatmap(spark, d):
    return act.heatmap(activity_log(spark, d)).withColumn("week", F.col("week").cast("bigint")).withColumn("day", F.col("day").cast("bigint"))


@query("monthly_bar", f"{_L}{_BARS} select * from bars")
def monthly_bar(spark, d):
    return act.monthly_bar(activity_log(spark, d))


@query("bar_normalized", f"{_L}{_BARS} select user_id, place, month, value / greatest(max(value) over (partition by user_id), 1) * 80 as height from bars")
def bar_normalized(spark, d):
    return act.bar_normalized(activity_log(spark, d))


@query(
    "recent_quizzes",
    f"""{_L}, q as (select *, {_RANK} as rank from log where kind = 'quiz_completed')
select user_id, rank, coalesce(upper(topic[1]) || topic[2:], 'Quiz') as title, cast(score as bigint) as score,
case when score >= 85 then 'Easy' when score >= 65 then 'Medium' else 'Hard' end as difficulty, case when score >= 60 then '✓' else '~' end as icon,
case when score >= 85 then 'green' when score >= 65 then 'teal' else 'coral' end as variant from q where rank <= 3""",
)
def recent_quizzes(spark, d):
    return act.recent_quizzes(activity_log(spark, d))


@query("latest_by_kind", f"{_L} select user_id, kind, max(event_id) as event_id, arg_max(ts, event_id) as ts from log group by all")
def latest_by_kind(spark, d):
    return act.latest_by_kind(activity_log(spark, d))


_TIPS = " union all ".join(
    f"select user_id, {i} as o, '{icon}' as icon, '{title}' as title, '{before}' || {value} || '{after}' as body from f where {when}"
    for i, ((icon, title, before, after), value, when) in enumerate(zip(act.TIPS, ["file", "score", "weak", "tasks"], ["file is not null", "score is not null", "weak is not null", "tasks > 0"], strict=True))
)


@query(
    "tips",
    f"""{_L}, f as (select user_id, arg_max(filename, event_id) filter (where kind = 'upload_processed') as file, arg_max(score, event_id) filter (where kind = 'quiz_completed') as score,
  nullif(array_to_string(arg_max(weak_topics, event_id) filter (where kind = 'quiz_completed')[1:3], ', '), '') as weak, count(*) filter (where kind = 'planner_task_done' and done) as tasks from log group by 1),
t as ({_TIPS})
select user_id, row_number() over (partition by user_id order by o) - 1 as place, icon, title, body from t qualify row_number() over (partition by user_id order by o) <= 3""",
)
def tips(spark, d):
    return act.tips(activity_log(spark, d))


@query(
    "activity_labels",
    f"""{_L} select event_id, case kind when 'upload_processed' then 'Uploaded ' || filename when 'quiz_completed' then 'Finished quiz with ' || score || '%'
when 'note_view' then 'Opened a note (cornell)' when 'planner_task_done' then case when done then 'Completed' else 'Reopened' end || ' task ' || task_id
when 'chat_message' then 'Asked the assistant a question' else replace(kind, '_', ' ') end as label from log""",
)
def activity_labels(spark, d):
    return act.labels(activity_log(spark, d))


@query(
    "long_term_stats",
    f"{_L}{_STREAK} select e.user_id, format('{{:,}}', e.n) as total_activities, streak || ' days' as longest_streak, a.n as active_days from (select user_id, count(*) as n from log group by 1) e join (select user_id, count(*) as n from days group by 1) a using (user_id) join streaks using (user_id)",
)
def long_term_stats(spark, d):
    return act.long_term_stats(activity_log(spark, d))


@query(
    "learner_dashboard",
    f"""{_L}{_TOPIC}{_STREAK}{_MASTERY}, f as (select user_id, count(*) as events, cast(sum({_MIN}) as bigint) as study_minutes, count(*) filter (where kind = 'quiz_completed') as quizzes, count(distinct cast(ts as date)) as active_days from log group by 1)
select user_id, events, study_minutes, study_minutes // 60 || printf('h %02dm', study_minutes % 60) as study_time, quizzes, active_days, streak, topics_mastered, mastery from f join streaks using (user_id) join mastered using (user_id)""",
)
def learner_dashboard(spark, d):
    return act.dashboard(activity_log(spark, d))


@query(
    "ingest_merge_extra",
    """select event_id, user_id, event_type as kind, case when event_id % 3 = 0 then date_trunc('day', cast(ts as timestamp)) else cast(ts as timestamp) end as ts, case when event_id % 2 = 0 then 'extra' else 'own' end as topic,
cast(null as varchar) as view, 'f' || user_id as filename, case when event_id % 5 = 0 then 'n5' end as note_id, cast(null as varchar) as format, case when event_id % 7 = 0 then null when event_id % 5 = 0 then 42 else cast(user_id % 100 as int) end as score,
cast(null as int) as total, event_type as message, cast(user_id % 8 as int) as task_id, event_id % 2 = 0 as done, case when event_id % 5 = 0 then 'device' else '' end as others from events""",
)
def ingest_merge_extra(spark, d):
    e = table(spark, d, "events")
    put = lambda when, **fields: F.when(when, F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])).otherwise(F.create_map().cast("map<string,string>"))
    i = F.col("event_id")
    extra = F.map_concat(
        put(i % 3 == 0, ts=F.to_date("ts").cast("string")), put(i % 2 == 0, topic=F.lit("extra"), kind=F.lit("mine")),
        put(i % 5 == 0, note_id=F.lit("n5"), device=F.lit("phone")), put(i % 7 == 0, score=F.lit("many")),
        put((i % 5 == 0) & (i % 7 != 0), score=F.lit("42")),
    )
    raw = e.select(
        "event_id", "user_id", F.col("event_type").alias("kind"), "ts", F.lit("own").alias("topic"),
        F.concat(F.lit("f"), "user_id").alias("filename"), (F.col("user_id") % 100).alias("score"), F.col("event_type").alias("message"),
        (F.col("user_id") % 8).alias("task_id"), (i % 2 == 0).alias("done"), extra.alias("extra"),
    )
    # a score that is no number is null, whatever the event's own
    return act.ingest(raw).withColumn("others", F.array_join(F.map_keys("extra"), ",")).drop("extra")


@query(
    "log_append",
    f"{_L} select event_id, kind from (select event_id, kind from log where event_id % 3 = 0 union all select event_id + 1000000000, kind from log "
    f"where event_id % 5 = 0) order by event_id desc limit {act.LOG_CAP}",
)
def log_append(spark, d):
    """Two batches appended to a stored log, of which the last 1000 events stay."""
    log = activity_log(spark, d).select("event_id", "kind")
    path = scratch(spark, "log")
    for batch in (log.where("event_id % 3 = 0"), log.where("event_id % 5 = 0").withColumn("event_id", F.col("event_id") + 1_000_000_000)):
        append(batch, path)
    return act.log_tail(read(spark, path, "event_id bigint, kind string"))


@query("parse_ts", "select event_id, case when event_id % 5 = 0 then null else cast(ts as date) end as day from events where event_id % 5 <> 0")
def parse_ts(spark, d):
    text = F.when(F.col("event_id") % 5 == 0, "nope").otherwise(F.col("ts").cast("string"))
    parsed = table(spark, d, "events").withColumn("t", text).select("event_id", F.expr("try_cast(t as timestamp_ntz)").alias("t"))
    return parsed.where("t is not null").select("event_id", F.to_date("t").alias("day"))


@query("planner_state", f"{_L}{_STATE} select * from state")
def planner_state(spark, d):
    return planner.state(activity_log(spark, d))


@query(
    "planner_tasks",
    f"{_L}{_STATE}, {_TASKS} select u.user_id, t.*, coalesce(done, false) as done from (select distinct user_id from log) u cross join tasks t left "
    f"join state s on s.user_id = u.user_id and s.task_id = t.task_id",
)
def planner_tasks(spark, d):
    return planner.board(activity_log(spark, d))


@query("planner_deadlines", "select * from (values " + ", ".join(str(x) for x in planner.DEADLINES) + ") t(text, date, color)")
def planner_deadlines(spark, d):
    return planner.deadlines(spark)


@query(
    "planner_progress",
    f"{_L}{_STATE}, {_TASKS}, b as (select u.user_id, day, coalesce(done, false) as done from (select distinct user_id from log) u cross join tasks "
    f"t left join state s on s.user_id = u.user_id and s.task_id = t.task_id), p as (select user_id, count(*) as today, count(*) filter (where "
    f"done) as done from b where day = 'today' group by 1) select user_id, today, done, cast(floor(100 * done / today + 0.5) as bigint) as percent "
    f"from p",
)
def planner_progress(spark, d):
    return planner.progress(activity_log(spark, d))


@query(
    "planner_toggle_enrich",
    f"{_L}, {_TASKS} select event_id, l.task_id, done, title, lower(t.topic) as topic from log l left join tasks t on t.task_id = l.task_id where "
    f"kind = 'planner_task_done'",
)
def planner_toggle_enrich(spark, d):
    return planner.toggles(activity_log(spark, d))


@query("quiz_progress", f"{_L}{_STREAK} select user_id, cast(floor(100 * least(streak, 7) / 7 + 0.5) as bigint) as percent, streak % 7 as weekday from streaks")
def quiz_progress(spark, d):
    s = F.col("streak")
    return act.current_streak(activity_log(spark, d)).select("user_id", F.floor(100 * F.least(s, F.lit(7)) / 7 + 0.5).alias("percent"), (s % 7).alias("weekday"))


def _stream(spark, d):
    return spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*")


@query("stream_daily_counts", f"{_L} select user_id, cast(ts as date) as day, count(*) as n from log group by all")
def stream_daily_counts(spark, d):
    return streams.drain(streams.daily_counts(_stream(spark, d).select("user_id", "ts")), ["user_id", "day"], scratch(spark, "daily"))


@query("stream_planner_state", f"{_L}{_STATE} select * from state")
def stream_planner_state(spark, d):
    return streams.drain(streams.planner_state(log_of(_stream(spark, d))), ["user_id", "task_id"], scratch(spark, "planner"))
