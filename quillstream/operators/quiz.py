"""Quiz scoring: responses to attempts, weak topics, question normalising and grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESPONSE_ORDER = ["l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate"]


def missing(c: Column | str, zero="") -> Column:
    """Null where ``c`` is empty or zero: both count as not given."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(c, F.lit(zero))


def percent(correct: Column, total: Column) -> Column:
    return F.bround(100 * correct / F.greatest(total, F.lit(1))).cast("bigint")


def attempt_scores(responses: DataFrame) -> DataFrame:
    """(attempt_id, total, correct, score) of attempts with responses."""
    counts = responses.groupBy("attempt_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_correct").alias("correct"))
    return counts.withColumn("score", percent(F.col("correct"), F.col("total")))


def weak_topics(responses: DataFrame) -> DataFrame:
    """(attempt_id, weak_topics): topics of wrong responses, the first occurrence of each, in response order."""
    wrong = responses.where(~F.col("is_correct") & missing("topic").isNotNull())
    rows = wrong.groupBy("attempt_id").agg(F.sort_array(F.collect_list(F.struct(*RESPONSE_ORDER, "topic"))).alias("r"))
    return rows.select("attempt_id", F.array_distinct(F.transform("r", lambda x: x.topic)).alias("weak_topics"))


def question_types(responses: DataFrame) -> DataFrame:
    return responses.groupBy("attempt_id", F.coalesce(missing("type"), F.lit("general")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def attempts(responses: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(attempt_id, total, correct, score, weak_topics, types), ``types`` a map from type to count; one pass over the
    responses, grouped once.

    ``given`` (attempt_id, total, correct, score, weak_topics) wins where it is not null, a score or total of 0 and an
    empty list counting as not given; its weak topics are listed once each.
    """
    kind = F.coalesce(missing("type"), F.lit("general"))
    wrong = F.when(~F.col("is_correct") & missing("topic").isNotNull(), F.struct(*RESPONSE_ORDER, "topic"))
    made = responses.groupBy("attempt_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_correct").alias("correct"), F.sort_array(F.collect_list(wrong)).alias("__wrong"), F.sort_array(F.collect_list(kind)).alias("__kinds")
    )
    counted = F.transform(F.array_distinct("__kinds"), lambda k: F.struct(k.alias("key"), F.size(F.filter("__kinds", lambda x: x == k)).cast("bigint").alias("value")))
    topics = F.array_distinct(F.transform("__wrong", lambda x: x.topic))
    made = made.select("attempt_id", "total", "correct", percent(F.col("correct"), F.col("total")).alias("score"), topics.alias("weak_topics"), F.map_from_entries(counted).alias("types"))
    if given is None:
        return made
    told = given.select("attempt_id", *[F.col(c).alias(f"g_{c}") for c in ("total", "correct", "score", "weak_topics")])
    total, correct = F.coalesce(missing("g_total", 0), "total").cast("bigint"), F.coalesce("g_correct", F.lit(0)).cast("bigint")
    weak = F.when(F.size("g_weak_topics") > 0, F.array_distinct("g_weak_topics")).otherwise(F.col("weak_topics"))
    score = F.coalesce(missing("g_score", 0), percent(correct, total)).cast("bigint")
    return made.join(told, "attempt_id", "left").select("attempt_id", total.alias("total"), correct.alias("correct"), score.alias("score"), weak.alias("weak_topics"), "types")


#: A prime above the number of questions of any bank: its multiples walk through a bank without meeting a question twice.
STRIDE = 2_147_483_647


def replies(messages: DataFrame, rules: list[tuple[str, str]], default: str) -> DataFrame:
    """Adds ``topic``, the first key of ``rules`` (key, reply) that stands in ``message``, and ``response``, its reply or else
    ``default``; case does not count. The topic is null where no key stands."""
    low = F.lower(F.coalesce("message", F.lit("")))
    met = [(low.contains(k), k, reply) for k, reply in rules]
    topic = F.coalesce(*[F.when(hit, F.lit(k)) for hit, k, _ in met])
    return messages.withColumns({"topic": topic, "response": F.coalesce(*[F.when(hit, F.lit(reply)) for hit, _, reply in met], F.lit(default))})


def numbered(bank: DataFrame, by: str) -> DataFrame:
    """Adds ``total``, the questions of each ``by``, and ``place``, 0 and up in order of a hash of ``id``. Slices of the
    hash count their own, so no task sorts a whole bank."""
    order = bank.withColumn("__h", F.md5(F.col("id").cast("string").cast("binary"))).withColumn("__slice", F.substring("__h", 1, 3))
    sizes = order.groupBy(by, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    all_, before = Window.partitionBy(by), Window.partitionBy(by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(by, "__slice", F.sum("__n").over(all_).alias("total"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(by, "__slice").orderBy("__h", "id")) - 1
    return order.withColumn("__at", inside).join(sizes, [by, "__slice"]).withColumn("place", F.col("__at") + F.col("__before")).drop("__h", "__slice", "__at", "__before")


def serve(requests: DataFrame, bank: DataFrame, generated: DataFrame, notes: DataFrame) -> DataFrame:
    """(request_id, topic, topic_label, note_id, total, nth, id): the questions that each request of a quiz gets.

    ``requests`` has (request_id, topic, note_id, limit). With a note it gets the note's questions in their order, of
    ``generated`` (note_id, nth, id), under the topic and title that ``notes`` (note_id, topic, title) has; else ``limit`` questions of its topic in ``bank`` (topic, id), of all topics for
    ``all``, in an order that the request's hash draws. ``total`` counts them before the limit. A request that gets none
    has one row without a question; a limit of 0 or less is none.

    A request draws its places and joins the bank by them, so it costs as many rows as its limit, however large the bank.
    """
    asked = requests.withColumn("__limit", F.greatest(F.col("limit").cast("bigint"), F.lit(0))).withColumn("__topic", F.lower("topic"))
    both = bank.select(F.lower("topic").alias("__topic"), "id").unionByName(bank.select(F.lit("all").alias("__topic"), "id"))
    placed = numbered(both, "__topic")
    totals = placed.groupBy("__topic").agg(F.count(F.lit(1)).alias("total"))
    by_topic = asked.where("note_id is null").join(totals, "__topic", "left")
    offset = F.conv(F.substring(F.md5(F.col("request_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")
    number = F.least("__limit", F.coalesce("total", F.lit(0)))
    drawn = by_topic.where(number > 0).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), number)))
    drawn = drawn.withColumn("place", F.pmod(F.col("nth") * STRIDE + offset, F.col("total"))).drop("total").join(placed, ["__topic", "place"])
    w = Window.partitionBy("note_id")
    own = generated.select("note_id", "id", F.count(F.lit(1)).over(w).alias("total"), F.row_number().over(w.orderBy("nth")).cast("bigint").alias("nth"))
    of_note = asked.where("note_id is not null").join(own, "note_id").where(F.col("nth") <= F.col("__limit"))
    columns = ["request_id", "total", "nth", "id"]
    found = drawn.select(*columns).unionByName(of_note.select(*columns)).withColumnRenamed("total", "__total")
    note_totals = own.groupBy("note_id").agg(F.max("total").alias("__of_note"))
    known = asked.join(totals.withColumnRenamed("total", "__of_topic"), "__topic", "left").join(note_totals, "note_id", "left").join(found, "request_id", "left")
    named = notes.select("note_id", F.col("topic").alias("__note_topic"), F.col("title").alias("__title"))
    of = F.col("note_id").isNotNull()
    topic = F.when(of, F.coalesce(missing("__note_topic"), F.lit("generated"))).otherwise(F.col("topic")).alias("topic")
    label = F.when(of, F.coalesce(missing("__title"), F.lit("Generated Note"))).when(F.col("topic") == "all", "Mixed Quiz").otherwise(F.upper("topic"))
    total = F.coalesce(F.when(of, F.col("__of_note")).otherwise(F.col("__of_topic")), F.lit(0)).cast("bigint").alias("total")
    return known.join(named, "note_id", "left").select("request_id", topic, label.alias("topic_label"), "note_id", total, "nth", "id")


def last_attempts(scored: DataFrame, by: str, n: int) -> DataFrame:
    """The last ``n`` attempts of each ``by``, newest first; none for 0."""
    w = Window.partitionBy(by).orderBy(F.desc("attempt_id"))
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)


def is_mcq(options: Column, kind: Column) -> Column:
    return (F.size(options) > 0) & (F.coalesce(kind, F.lit("mcq")) == "mcq")


def bucket(kind: Column) -> Column:
    return F.when(kind == "mcq", "mcq").when(kind.isin("long", "theory", "application"), "long").otherwise("short")


def answer_valid(answer: Column, timed_out: Column) -> Column:
    return (F.length(F.regexp_replace(answer, r"^\s+|\s+$", "")) >= 12) | timed_out


def normalize_questions(questions: DataFrame) -> DataFrame:
    """Fills in what a question lacks; (note_id, nth, id, type, question, options, answer_index, answer_hint, difficulty,
    topics, section_title, note_title) to the normalised form. Empty strings and 0 count as lacking."""
    topics = F.array_join(F.slice("topics", 1, 2), ", ")
    return questions.select(
        F.coalesce(missing("id"), F.concat_ws("-", F.coalesce(F.col("note_id").cast("string"), F.lit("static")), F.col("nth"))).alias("id"),
        "note_id",
        "section_title",
        F.coalesce(missing("type"), F.lit("conceptual")).alias("type"),
        F.coalesce(missing("question"), F.lit("Untitled question")).alias("question"),
        F.coalesce(F.col("answer_index"), F.lit(0)).cast("bigint").alias("answer_index"),
        F.coalesce("answer_hint", F.lit("")).alias("answer_hint"),
        F.coalesce(missing("explanation"), missing("answer_hint"), F.lit("Review the related notes section.")).alias("explanation"),
        F.coalesce(missing("difficulty"), F.lit("medium")).alias("difficulty"),
        F.coalesce(missing(topics), "note_title").alias("topic"),
        F.when(F.col("note_id").isNotNull(), "generated").otherwise("static").alias("source"),
    )


def questions_for_note(section: DataFrame, package: DataFrame, limit: int = 5) -> DataFrame:
    """Questions of sections, or those of the package where no section of the note has any; with the total before the
    limit. Both have (note_id, nth, question)."""
    lone = package.join(section.select("note_id").distinct(), "note_id", "left_anti")
    w = Window.partitionBy("note_id")
    both = section.unionByName(lone).withColumn("total", F.count(F.lit(1)).over(w)).withColumn("index", F.row_number().over(w.orderBy("nth")).cast("bigint"))
    return both.where(F.col("index") <= limit).select("note_id", "index", "question", "total")


def correct(options: Column, kind: Column, selected: Column, answer: Column, self_assessment: Column) -> Column:
    """Whether a response is right: for a choice question the selected option, for others the learner's own word."""
    return F.when(is_mcq(options, kind), F.coalesce(selected == answer, F.lit(False))).otherwise(F.coalesce(self_assessment, F.lit(False)))


def by_type(questions: DataFrame) -> DataFrame:
    """(note_id, type, place, id): each note's questions of one type, in their order; without a type, general."""
    kind = F.coalesce(missing("type"), F.lit("general"))
    w = Window.partitionBy("note_id", "type").orderBy("nth")
    return questions.withColumn("type", kind).withColumn("place", (F.row_number().over(w) - 1).cast("bigint")).select("note_id", "type", "place", "id")


def running_score(responses: DataFrame) -> DataFrame:
    """(attempt_id, nth, is_correct, so_far): correct responses up to each one."""
    w = Window.partitionBy("attempt_id").orderBy(*RESPONSE_ORDER)
    rows = responses.withColumn("nth", F.row_number().over(w).cast("bigint"))
    return rows.select("attempt_id", "nth", "is_correct", F.sum(F.col("is_correct").cast("int")).over(Window.partitionBy("attempt_id").orderBy("nth")).alias("so_far"))
