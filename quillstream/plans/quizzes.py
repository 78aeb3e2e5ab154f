"""Queries over quiz attempts, questions and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chat
from ..functions import text as fn
from ..operators import matching, quiz
from ..sources.tables import CHAT_KEYS, RESPONSES_SQL, activity_log, lookup, responses, table
from .base import query

_R = "with " + RESPONSES_SQL
_ORDER = "l_linenumber, l_partkey, l_extendedprice, l_shipdate"
_SCORES = """, scores as (select attempt_id, count(*) as total, count(*) filter (where is_correct) as correct,
  cast(round_even(100.0 * count(*) filter (where is_correct) / count(*), 0) as bigint) as score from responses group by 1)"""
_WEAK = f""", wrong as (select *, row_number() over (partition by attempt_id order by {_ORDER}, topic) as p from responses where not is_correct),
firsts as (select attempt_id, topic, min(p) as p from wrong group by all), weak as (select attempt_id, string_agg(topic, '|' order by p) as weak_topics from firsts group by 1)"""


@query("attempt_scores", f"{_R}{_SCORES} select * from scores")
def attempt_scores(spark, d):
    return quiz.attempt_scores(responses(spark, d))


@query("weak_topics", f"{_R}{_WEAK} select * from weak")
def weak_topics(spark, d):
    return quiz.weak_topics(responses(spark, d)).select("attempt_id", F.array_join("weak_topics", "|").alias("weak_topics"))


@query("question_types", f"{_R} select attempt_id, type, count(*) as n from responses group by all")
def question_types(spark, d):
    return quiz.question_types(responses(spark, d))


_TYPES = ", types as (select attempt_id, string_agg(type || ':' || n, '|' order by type) as types from (select attempt_id, type, count(*) as n from responses group by all) group by 1)"


def _listed(made):
    types = F.array_join(F.transform(F.array_sort(F.map_entries("types")), lambda e: F.concat(e.key, F.lit(":"), e.value)), "|")
    return made.withColumns({"weak_topics": F.array_join("weak_topics", "|"), "types": types})


@query(
    "quiz_attempts",
    f"""{_R}{_SCORES}{_WEAK}{_TYPES}
select s.attempt_id, total, correct, score, coalesce(weak_topics, '') as weak_topics, types from scores s join types using (attempt_id) left join weak using (attempt_id)""",
)
def quiz_attempts(spark, d):
    return _listed(quiz.attempts(responses(spark, d)))


@query(
    "quiz_attempts_given",
    f"""{_R}{_SCORES}{_WEAK}{_TYPES}, told as (
  select s.attempt_id, coalesce(nullif(o_custkey % 4, 0), total) as total, case when s.attempt_id % 5 > 0 then o_custkey % 3 else 0 end as correct, nullif(o_custkey % 7, 0) as told_score,
         case when s.attempt_id % 3 = 0 then o_orderstatus || '|given' else coalesce(weak_topics, '') end as weak_topics, types
  from scores s join orders on o_orderkey = s.attempt_id join types using (attempt_id) left join weak using (attempt_id))
select attempt_id, total, correct, coalesce(told_score, cast(round_even(100.0 * correct / greatest(total, 1), 0) as bigint)) as score, weak_topics, types from told""",
)
def quiz_attempts_given(spark, d):
    """Attempts whose payload says some of what would be derived, weak topics among it."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    given = table(spark, d, "orders").select(
        o.alias("attempt_id"), (c % 4).alias("total"), F.when(o % 5 > 0, c % 3).alias("correct"), (c % 7).alias("score"),
        F.when(o % 3 == 0, F.array("o_orderstatus", F.lit("given"), F.col("o_orderstatus"))).when(o % 3 == 1, F.array().cast("array<string>")).alias("weak_topics"),
    )
    return _listed(quiz.attempts(responses(spark, d), given))


@query(
    "attempt_defaults",
    """select o_orderkey as attempt_id, coalesce(nullif(nullif(o_orderstatus, ''), 'P'), 'general') as topic, coalesce(nullif(cast(o_custkey % 3 as int), 0), 5) as total,
coalesce(nullif(trim(o_orderpriority), ''), 'Untitled') as title from orders""",
)
def attempt_defaults(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("attempt_id"), F.coalesce(F.nullif(quiz.missing("o_orderstatus"), F.lit("P")), F.lit("general")).alias("topic"),
        F.coalesce(quiz.missing((F.col("o_custkey") % 3).cast("int"), 0), F.lit(5)).alias("total"), F.coalesce(quiz.missing(F.trim("o_orderpriority")), F.lit("Untitled")).alias("title"),
    )


@query(
    "attempts_for_note",
    f"{_R}{_SCORES}, n as (select s.*, o_custkey as note_id, row_number() over (partition by o_custkey order by attempt_id desc) as rank from "
    f"scores s join orders on attempt_id = o_orderkey) select note_id, rank, attempt_id, score from n where rank <= 20",
)
def attempts_for_note(spark, d):
    scored = quiz.attempt_scores(responses(spark, d)).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("attempt_id"), F.col("o_custkey").alias("note_id")), "attempt_id")
    return quiz.last_attempts(scored, "note_id", 20).select("note_id", "rank", "attempt_id", "score")


@query(
    "response_correctness",
    f"{_R}, r as (select attempt_id, row_number() over (partition by attempt_id order by {_ORDER}) as nth, case when n_options > 0 and says_mcq "
    f"then selected = correct else is_correct end as right_ from responses) select attempt_id, nth, right_ as is_correct, cast(sum(cast(right_ as "
    f"int)) over (partition by attempt_id order by nth) as bigint) as so_far from r",
)
def response_correctness(spark, d):
    judged = responses(spark, d).withColumn("is_correct", quiz.correct(F.col("options"), F.col("kind"), F.col("selected"), F.col("correct"), F.col("self_assessment")))
    return quiz.running_score(judged)


@query(
    "responses_build",
    f"{_R} select attempt_id, l_linenumber, l_partkey, coalesce(nullif(topic, ''), 'general') as topic, ['A','B','C','D'][p_size % 5] as selected, "
    f"coalesce(['A','B','C','D'][p_size % 5], '') as answer, l_extendedprice from responses",
)
def responses_build(spark, d):
    options = F.array(*map(F.lit, "ABCD"))
    picked = F.when(F.col("p_size") % 5 > 0, F.try_element_at(options, F.greatest(F.col("p_size") % 5, F.lit(1))))
    return responses(spark, d).select(
        "attempt_id", "l_linenumber", "l_partkey", F.coalesce(quiz.missing("topic"), F.lit("general")).alias("topic"), picked.alias("selected"),
        F.coalesce(picked, F.lit("")).alias("answer"), "l_extendedprice",
    )


@query(
    "normalize_questions",
    """select coalesce(case when p_partkey % 3 <> 0 then 'q' || p_partkey end, coalesce(case when p_partkey % 2 = 0 then cast(p_partkey as varchar) end, 'static') || '-' || p_size) as id,
case when p_partkey % 2 = 0 then p_partkey end as note_id, p_brand as section_title, coalesce(case when p_partkey % 5 <> 0 then p_type end, 'conceptual') as type, p_name as question,
cast(coalesce(case when p_size % 4 <> 0 then p_size end, 0) as bigint) as answer_index, case when p_partkey % 7 <> 0 then p_type else '' end as answer_hint,
coalesce(case when p_partkey % 7 <> 0 then p_type end, 'Review the related notes section.') as explanation, 'medium' as difficulty,
case when p_partkey % 4 <> 0 then p_brand || ', ' || p_type else 'Note' end as topic, case when p_partkey % 2 = 0 then 'generated' else 'static' end as source from part""",
)
def normalize_questions(spark, d):
    p = F.col("p_partkey")
    q = table(spark, d, "part").select(
        F.when(p % 3 != 0, F.concat(F.lit("q"), p)).otherwise("").alias("id"), F.when(p % 2 == 0, p).alias("note_id"), F.col("p_size").alias("nth"), F.col("p_brand").alias("section_title"),
        F.when(p % 5 != 0, F.col("p_type")).alias("type"), F.col("p_name").alias("question"), F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("answer_index"),
        F.when(p % 7 != 0, F.col("p_type")).alias("answer_hint"), F.lit("").alias("explanation"), F.lit(None).cast("string").alias("difficulty"),
        F.when(p % 4 != 0, F.array("p_brand", "p_type", "p_name")).otherwise(F.array().cast("array<string>")).alias("topics"), F.lit("Note").alias("note_title"),
    )
    return quiz.normalize_questions(q)


@query(
    "questions_for_note",
    """with s as (select p_size as note_id, p_partkey as nth, p_name as question from part where p_partkey % 2 = 0 and p_size % 3 <> 0),
p as (select p_size as note_id, p_partkey as nth, p_name as question from part where p_partkey % 2 = 1),
b as (select * from s union all select * from p where note_id not in (select note_id from s)),
n as (select note_id, row_number() over (partition by note_id order by nth) as index, question, count(*) over (partition by note_id) as total from b) select * from n where index <= 5""",
)
def questions_for_note(spark, d):
    part = table(spark, d, "part").select(F.col("p_size").alias("note_id"), F.col("p_partkey").alias("nth"), F.col("p_name").alias("question"))
    return quiz.questions_for_note(part.where("nth % 2 = 0 and note_id % 3 <> 0"), part.where("nth % 2 = 1"))


@query("question_buckets", "select p_partkey, case when p_size % 5 = 0 then 'mcq' when p_size % 5 in (1, 2, 3) then 'long' else 'short' end as bucket from part")
def question_buckets(spark, d):
    kind = F.get(F.array(*map(F.lit, ["mcq", "long", "theory", "application", "conceptual"])), F.col("p_size") % 5)
    return table(spark, d, "part").select("p_partkey", quiz.bucket(kind).alias("bucket"))


@query(
    "questions_by_type",
    "select p_partkey // 20 as note_id, case when p_size % 9 = 0 then 'general' else p_type end as type, row_number() over (partition by p_partkey "
    "// 20, case when p_size % 9 = 0 then 'general' else p_type end order by p_partkey) - 1 as place, p_partkey as id from part",
)
def questions_by_type(spark, d):
    rows = table(spark, d, "part").select(
        F.floor(F.col("p_partkey") / 20).alias("note_id"), F.when(F.col("p_size") % 9 == 0, "").otherwise(F.col("p_type")).alias("type"),
        F.col("p_partkey").alias("nth"), F.col("p_partkey").alias("id"),
    )
    return quiz.by_type(rows)


@query("mcq_filter", "select p_partkey from part where p_size % 3 > 0 and (p_partkey % 2 = 0 or p_size % 4 = 0)")
def mcq_filter(spark, d):
    options = F.slice(F.array(*map(F.lit, "ABC")), 1, F.col("p_size") % 3)
    kind = F.when(F.col("p_partkey") % 2 == 0, "mcq").when(F.col("p_size") % 4 != 0, "theory")
    return table(spark, d, "part").where(quiz.is_mcq(options, kind)).select("p_partkey")


@query("option_letters", "select p_partkey, chr(65 + p_size % 4) as letter from part")
def option_letters(spark, d):
    return table(spark, d, "part").select("p_partkey", F.char(65 + F.col("p_size") % 4).alias("letter"))


@query("quiz_bank_all", "select 'even' as bank, p_partkey as id from part where p_partkey % 2 = 0 union all select 'odd', p_partkey from part where p_partkey % 2 = 1")
def quiz_bank_all(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return part.where("id % 2 = 0").select(F.lit("even").alias("bank"), "id").unionByName(part.where("id % 2 = 1").select(F.lit("odd").alias("bank"), "id"))


@query("quiz_sample", "select p_partkey, p_name from part order by md5(cast(p_partkey as varchar)), p_partkey limit 5")
def quiz_sample(spark, d):
    """Five questions in an order that a hash shuffles: the same ones at every run."""
    return table(spark, d, "part").select("p_partkey", "p_name").orderBy(F.md5(F.col("p_partkey").cast("string")), "p_partkey").limit(5)


_BANK = """bank as (select lower(p_brand) as topic, p_partkey as id from part union all select 'all', p_partkey from part),
placed as (select topic, id, row_number() over (partition by topic order by md5(cast(id as varchar)), id) - 1 as place, count(*) over (partition by topic) as total from bank),
own as (select l_partkey % 500 as note_id, l_orderkey * 10 + l_linenumber as id from lineitem where l_partkey % 5 = 0 group by all),
gen as (select note_id, id, row_number() over (partition by note_id order by id) as nth, count(*) over (partition by note_id) as total from own),
asked as (
  select c_custkey as request_id, case c_custkey % 4 when 0 then 'all' when 1 then 'nothing' else 'Brand#' || (c_custkey % 5 + 1) || (c_custkey % 3 + 1) end as topic,
         case when c_custkey % 5 = 0 then c_custkey % 500 end as note_id, c_custkey % 7 as lim from customer)"""


@query(
    "quiz_served",
    f"""with {_BANK}, sized as (select a.*, coalesce(t.total, 0) as of_topic, coalesce(g.total, 0) as of_note
  from asked a left join (select topic, max(total) as total from placed group by 1) t on t.topic = lower(a.topic) left join (select note_id, max(total) as total from gen group by 1) g on g.note_id = a.note_id),
drawn as (select request_id, unnest(range(1, least(lim, of_topic) + 1)) as nth from sized where note_id is null),
got as (
  select request_id, d.nth, p.id from drawn d join sized s using (request_id)
  join placed p on p.topic = lower(s.topic) and p.place = (d.nth * {quiz.STRIDE} + cast('0x' || substr(md5(cast(request_id as varchar)), 1, 8) as bigint)) % of_topic
  union all select request_id, nth, id from sized join gen using (note_id) where nth <= lim)
select request_id, case when note_id is not null then coalesce(c_mktsegment, 'generated') else topic end as topic,
       case when note_id is not null then coalesce(c_name, 'Generated Note') when topic = 'all' then 'Mixed Quiz' else upper(topic) end as topic_label,
       note_id, case when note_id is not null then of_note else of_topic end as total, nth, id
from sized left join got using (request_id) left join customer on c_custkey = note_id""",
)
def quiz_served(spark, d):
    """Quizzes by topic, over all topics, of a topic without questions, and of notes; limits of 0 to 6."""
    c = F.col("c_custkey")
    brand = F.concat(F.lit("Brand#"), c % 5 + 1, c % 3 + 1)
    topic = F.when(c % 4 == 0, "all").when(c % 4 == 1, "nothing").otherwise(brand)
    asked = table(spark, d, "customer").select(c.alias("request_id"), topic.alias("topic"), F.when(c % 5 == 0, c % 500).alias("note_id"), (c % 7).alias("limit"))
    bank = table(spark, d, "part").select(F.col("p_brand").alias("topic"), F.col("p_partkey").alias("id"))
    lines = table(spark, d, "lineitem").where("l_partkey % 5 = 0")
    own = lines.select((F.col("l_partkey") % 500).alias("note_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).distinct()
    notes = table(spark, d, "customer").select(c.alias("note_id"), F.col("c_mktsegment").alias("topic"), F.col("c_name").alias("title"))
    return quiz.serve(asked, bank, own.withColumn("nth", F.col("id")), notes)


@query("answer_valid", "select conv_id, turn, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 12 or turn % 5 = 0 as valid from conversations")
def answer_valid(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", quiz.answer_valid(F.col("text"), F.col("turn") % 5 == 0).alias("valid"))


_ROUTE = " ".join(f"when contains(lower(text), '{k}') then '{k}'" for k in CHAT_KEYS)


@query("chat_route", f"select conv_id, turn, role, case {_ROUTE} else 'default' end as route from conversations")
def chat_route(spark, d):
    low = F.lower("text")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce(*[F.when(low.contains(k), F.lit(k)) for k in CHAT_KEYS], F.lit("default")).alias("route"))


_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"
_REPLY_SQL = " ".join(f"when contains(lower(text), '{k}') then {_QUOTED(reply)}" for k, reply in chat.REPLIES)


@query("chat_replies", f"select conv_id, turn, case {_ROUTE} end as topic, case {_REPLY_SQL} else {_QUOTED(chat.DEFAULT)} end as response from conversations")
def chat_replies(spark, d):
    messages = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("message"))
    return quiz.replies(messages, chat.REPLIES, chat.DEFAULT).drop("message")


@query(
    "chat_messages_topic",
    "with x as (select event_id, cast(json_extract_string(props, '$.k') as int) % 7 as k from events where event_type = 'click') select event_id, " + "[" + ", ".join(f"'{k}'" for k in CHAT_KEYS) + "][k + 1] as topic from x",
)
def chat_messages_topic(spark, d):
    log = activity_log(spark, d).where("kind = 'chat_message'")
    return log.select("event_id", lookup(F.col("message"), [(k, k) for k in CHAT_KEYS]).alias("topic"))


@query(
    "markdown_html",
    r"select conv_id, turn, role, replace(regexp_replace(regexp_replace(regexp_replace('**' || role || '** *' || text || '* `x`' || chr(10), "
    r"'\*\*(.*?)\*\*', '<strong>\1</strong>', 'g'), '\*(.*?)\*', '<em>\1</em>', 'g'), '`(.*?)`', '<code>\1</code>', 'g'), chr(10), '<br>') as html "
    r"from conversations",
)
def markdown_html(spark, d):
    text = F.concat(F.lit("**"), "role", F.lit("** *"), "text", F.lit("* `x`\n"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", fn.markdown(text).alias("html"))


@query("first_name", "select c_custkey, split_part(replace(c_name, '#', ' '), ' ', 1) as first_name from customer")
def first_name(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.split(F.replace("c_name", F.lit("#"), F.lit(" ")), " ")[0].alias("first_name"))


@query("note_lookup", "select c_custkey as note_id, case when c_custkey % 2 = 0 then 'generated' else 'static' end as origin from customer")
def note_lookup(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("note_id"))
    both = c.where("note_id % 2 = 0").withColumn("origin", F.lit("generated")).unionByName(c.withColumn("origin", F.lit("static")))
    return matching.first_choice(both, "note_id", [F.when(F.col("origin") == "generated", 0).otherwise(1)])


@query(
    "default_note",
    "select c_nationkey as user_id, coalesce(min(c_custkey) filter (where c_acctbal < 0), max(c_custkey) filter (where c_custkey % 2 = 0), "
    "min(c_custkey)) as note_id from customer group by 1",
)
def default_note(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("user_id"), F.col("c_custkey").alias("note_id"), "c_acctbal")
    even = F.col("note_id") % 2 == 0
    rank = F.when(F.col("c_acctbal") < 0, 0).when(even, 1).otherwise(2)
    within = F.when(F.col("c_acctbal") < 0, F.col("note_id")).when(even, -F.col("note_id")).otherwise(F.col("note_id"))
    return matching.first_choice(c, "user_id", [rank, within]).select("user_id", "note_id")
