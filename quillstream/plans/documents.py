"""Queries over uploads: text functions, sections, packages and matching."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as fn
from ..operators import chunking, matching, notes, quiz
from ..sources.tables import NOTEBOOKS_SQL, notebooks, table, uploads
from .base import query

#: A text with everything that cleaning handles, around and within a document's whole text.
_MESSY = "'• ' || doc_id || '\r\n\r\n\r\n\r\n1.2  Big Title:\r\nLine\t\tone  ' || substr(text, 1, 40) || ' \n\nCHAPTER two\n\n' || substr(text, 41)"
_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_STOP = ", ".join(f"'{w}'" for w in fn.STOP_WORDS)
_RULES = " ".join("when regexp_matches(low, '" + "|".join(words) + f"') then '{name}'" for name, words in fn.TOPIC_RULES)


def messy(spark, d) -> DataFrame:
    e = F.concat(F.lit("• "), "doc_id", F.lit("\r\n\r\n\r\n\r\n1.2  Big Title:\r\nLine\t\tone  "), F.substring("text", 1, 40), F.lit(" \n\nCHAPTER two\n\n"), F.substring("text", 41, 2**31 - 1))
    return table(spark, d, "documents").select("doc_id", e.alias("text"))


_CLEAN = f"""with messy as (select doc_id, {_MESSY} as t from documents),
flat as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\r\\n?', chr(10), 'g'), '[•●◦]', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') as t from messy),
cleaned as (select doc_id, {_STRIP("array_to_string(list_transform(string_split(t, chr(10)), lambda x: " + _STRIP("x") + "), chr(10))")} as text from flat)"""


@query("clean_text", f"{_CLEAN} select * from cleaned")
def clean_text(spark, d):
    return messy(spark, d).select("doc_id", fn.clean(F.col("text")).alias("text"))


_PARTS = f"""{_CLEAN}, parts as (select doc_id, unnest(p) as text, unnest(range(len(p))) as nth
from (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n+'), lambda x: {_STRIP("x")}), lambda x: x <> '') as p from cleaned))"""


@query("paragraphs", f"{_PARTS} select * from parts")
def paragraphs(spark, d):
    rows = messy(spark, d).select("doc_id", F.posexplode(fn.paragraphs(fn.clean(F.col("text")))).alias("nth", "text"))
    return rows.withColumn("nth", F.col("nth").cast("bigint"))


@query(
    "heading_lines",
    f"""with lines as (select doc_id, unnest(string_split(text, chr(10))) as line from documents),
bare as (select doc_id, line, {_STRIP("regexp_replace(line, '^:+|:+$', '', 'g')")} as b from lines),
w as (select *, list_filter(regexp_split_to_array(b, '\\s+'), lambda x: x <> '') as ws from bare)
select doc_id, line from w where b <> '' and length(b) <= 90 and (regexp_matches(lower(b), '^({"|".join(fn.HEADING_PREFIXES)})') or regexp_matches(b, '^[0-9]+(\\.[0-9]+)*\\s+[A-Za-z].+$')
  or (len(ws) <= 9 and len(list_filter(ws, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) >= greatest(1, len(ws) - 2)))""",
)
def heading_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(fn.is_heading(F.col("line")))


@query(
    "headings_norm",
    "select p_partkey, coalesce(nullif(trim(regexp_replace(regexp_replace(p_size || '.' || (p_partkey % 9) || ' ' || p_type || ': -', "
    "'^[0-9]+(\\.[0-9]+)*\\s*', ''), '^[:\\- ]+|[:\\- ]+$', '', 'g')), ''), p_brand) as heading from part",
)
def headings_norm(spark, d):
    line = F.concat("p_size", F.lit("."), F.col("p_partkey") % 9, F.lit(" "), "p_type", F.lit(": -"))
    return table(spark, d, "part").select("p_partkey", fn.heading_text(line, F.col("p_brand")).alias("heading"))


_SENT_OF = f"""sents as (select doc_id, unnest(s) as sentence, unnest(range(len(s))) as nth from (select doc_id, list_filter(list_transform(
string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_STRIP("x")}), lambda x: x <> '') as s from {{rows}}))"""
_SENT = _SENT_OF.replace("{rows}", "documents")


@query("sentences", f"with {_SENT} select doc_id, nth, sentence from sents")
def sentences(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(fn.sentences(F.col("text"))).alias("nth", "sentence"))
    return rows.withColumn("nth", F.col("nth").cast("bigint"))


_WORDS = f"""toks as (select doc_id, unnest(w) as word, unnest(range(len(w))) as pos from (select doc_id, list_filter(regexp_extract_all(lower({{text}}), '[a-z][a-z0-9_\\-]+'), lambda x: length(x) > 2 and x not in ({_STOP})) as w from {{rows}})),
cnt as (select doc_id, word, count(*) as n, min(pos) as first from toks group by all),
kw as (select doc_id, replace(word, '_', ' ') as word, row_number() over (partition by doc_id order by n desc, first) as rank from cnt qualify rank <= 8)"""


@query("doc_keywords", f"with {_WORDS.format(text='text', rows='documents')} select doc_id, string_agg(word, '|' order by rank) as keywords from kw group by 1")
def doc_keywords(spark, d):
    return notes.keywords(table(spark, d, "documents"), ["doc_id"], "text").select("doc_id", F.array_join("keywords", "|").alias("keywords"))


_DEF = r"(?i)^([A-Za-z][A-Za-z0-9\s()/\-]{1,60})\s+(is|are|refers to|means)\s+(.+)"


_FOUR = f"""found as (select doc_id, nth, regexp_replace({_STRIP(f"regexp_extract(sentence, '{_DEF}', 1) || ': ' || regexp_replace({_STRIP(f"regexp_extract(sentence, '{_DEF}', 3)")}, '\\.+$', '') || '.'")}, '\\s+', ' ', 'g') as def from sents where regexp_matches(sentence, '{_DEF}')),
firsts as (select doc_id, lower(def) as k, min(nth) as nth, arg_min(def, nth) as def from found group by all),
four as (select doc_id, def, row_number() over (partition by doc_id order by nth) as r from firsts qualify r <= 4)"""


@query("definitions", f"with {_SENT}, {_FOUR} select doc_id, string_agg(def, '|' order by r) as definitions from four group by 1")
def definitions(spark, d):
    found = fn.dedupe(fn.defined(F.col("text")), 4)
    return table(spark, d, "documents").select("doc_id", found.alias("f")).where(F.size("f") > 0).select("doc_id", F.array_join("f", "|").alias("definitions"))


@query(
    "dedupe_lines",
    f"with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from "
    f"documents), f as (select doc_id, pos, {_STRIP("regexp_replace(line, '\\s+', ' ', 'g')")} as line from l), k as (select doc_id, lower(line) as "
    f"k, min(pos) as pos, arg_min(line, pos) as line from f where line <> '' group by all) select doc_id, count(*) as n, string_agg(line, chr(10) "
    f"order by pos) as text from k group by 1",
)
def dedupe_lines(spark, d):
    rows = table(spark, d, "documents").select("doc_id", fn.dedupe(F.split("text", "\n")).alias("k"))
    return rows.where(F.size("k") > 0).select("doc_id", F.size("k").cast("bigint").alias("n"), F.array_join("k", "\n").alias("text"))


@query(
    "dedupe_stripped",
    f"with l as (select doc_id, {_STRIP("x")} as line, i from (select doc_id, unnest(string_split(replace(text, '.', '  ' || chr(10) || ' '), "
    f"chr(10))) as x, unnest(range(len(string_split(replace(text, '.', '  ' || chr(10) || ' '), chr(10))))) as i from documents)), k as (select "
    f"doc_id, min(i) as i, arg_min(line, i) as line from l where line <> '' group by doc_id, lower(line)) select doc_id, count(*) as n, "
    f"string_agg(line, chr(10) order by i) as text from k group by 1",
)
def dedupe_stripped(spark, d):
    parts = F.split(F.replace("text", F.lit("."), F.lit("  \n ")), "\n")
    rows = table(spark, d, "documents").select("doc_id", fn.dedupe_stripped(parts).alias("k"))
    return rows.where(F.size("k") > 0).select("doc_id", F.size("k").cast("bigint").alias("n"), F.array_join("k", "\n").alias("text"))


@query(
    "lower_keys",
    """select item_id, cast(to_json({'title': trim(text), 'tags': ['A b', 'c'], 'meta': {'page': item_id, 'deep key': {'note': '' || item_id}}}) as varchar) as record from benchmark where item_id % 5 > 0 union all select item_id, null from benchmark where item_id % 5 = 0""",
)
def lower_keys(spark, d):
    i = F.col("item_id")
    given = F.to_json(
        F.struct(
            F.concat(F.lit("  "), "text", F.lit(" \n")).alias("Title"), F.array(F.lit(" A b"), F.lit("c ")).alias("TAGS"),
            F.struct(i.alias("Page"), F.struct(F.concat(F.lit(" "), i).alias("Note")).alias("Deep Key")).alias("meta"),
        )
    )
    return table(spark, d, "benchmark").select("item_id", fn.lower_keys(F.when(i % 5 > 0, given).otherwise("{broken")).alias("record"))


@query("infer_topic", f"select doc_id, case {_RULES} end as topic from (select doc_id, lower(source || '_' || doc_id || '.txt ' || text) as low from documents)")
def infer_topic(spark, d):
    return uploads(spark, d).select("doc_id", fn.topic(F.col("filename"), F.col("text")).alias("topic"))


@query("doc_difficulty", "select doc_id, case when length(text) < 1500 then 'beginner' when length(text) < 6000 then 'intermediate' else 'advanced' end as difficulty from documents")
def doc_difficulty(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.difficulty(F.col("text")).alias("difficulty"))


@query(
    "file_ext_filter",
    "select page_id, ext from (select page_id, case when contains(url, '.') then lower(list_last(string_split(url, '.'))) else '' end as ext from (select page_id, url || ['.PDF', '.html', '.md', '/x'][page_id % 4 + 1] as url from pages)) where ext in (" + ", ".join(f"'{x}'" for x in fn.ALLOWED) + ")",
)
def file_ext_filter(spark, d):
    name = F.concat("url", F.get(F.array(*map(F.lit, [".PDF", ".html", ".md", "/x"])), (F.col("page_id") % 4).cast("int")))
    return table(spark, d, "pages").select("page_id", fn.extension(name).alias("ext")).where(F.col("ext").isin(fn.ALLOWED))


_CASED = "[\\p{Lu}\\p{Ll}\\p{Lt}]"
_TITLED = lambda x: f"array_to_string(list_transform(regexp_extract_all({x}, '{_CASED}+|[^{_CASED[1:]}+'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '')"
_FILE_TITLE = lambda x: _TITLED(f"translate(regexp_replace({x}, '\\.[^.]*$', ''), '_-', '  ')")


@query("title_from_filename", f"select doc_id, {_FILE_TITLE("doc_id || 'b-o''neil_' || lang || '2x_' || source || '.v1.txt'")} as title from documents")
def title_from_filename(spark, d):
    name = F.concat("doc_id", F.lit("b-o'neil_"), "lang", F.lit("2x_"), "source", F.lit(".v1.txt"))
    return uploads(spark, d).select("doc_id", fn.title_of_file(name).alias("title"))


@query("text_preview", "select doc_id, substr(text, 1, 500) as preview from documents")
def text_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring(F.regexp_replace("text", fn.PAGE_MARK + r"\s*", ""), 1, 500).alias("preview"))


@query("excerpt", "select doc_id, substr(text, 1, 600) as excerpt from documents")
def excerpt(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, notes.EXCERPT).alias("excerpt"))


@query("size_kb", "select doc_id, round_even(strlen(text) / 1024.0, 1) as size_kb from documents")
def size_kb(spark, d):
    return table(spark, d, "documents").select("doc_id", F.bround(F.octet_length("text") / F.lit(1024.0), 1).alias("size_kb"))


@query("trim_2000", f"select doc_id, substr({_STRIP('text')}, 1, 2000) as text from documents")
def trim_2000(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring(fn.strip(F.col("text")), 1, 2000).alias("text"))


@query(
    "target_pages",
    "select p_size, case when p_size <= 1 then 1 else greatest(1, cast(round_even(p_size * 0.35::double, 0) as bigint)) end as least, case when "
    "p_size <= 1 then 2 else greatest(2, cast(round_even(p_size * 0.55::double, 0) as bigint)) end as most from (select distinct p_size from part)",
)
def target_pages(spark, d):
    least, most = fn.target_pages(F.col("p_size"))
    return table(spark, d, "part").select("p_size").distinct().select("p_size", least.alias("least"), most.alias("most"))


@query("asset_url", "select page_id, case when page_id % 3 = 0 then url when page_id % 3 = 1 then 'http://host/p/' || page_id else 'http://host/q/' || page_id end as asset from pages")
def asset_url(spark, d):
    path = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/p/"), "page_id")).otherwise(F.concat(F.lit("q/"), "page_id"))
    return table(spark, d, "pages").select("page_id", fn.asset_url(path, "http://host").alias("asset"))


@query("strip_json_fence", "select conv_id, turn, role, text from conversations")
def strip_json_fence(spark, d):
    fenced = F.concat(F.lit("```json\n"), F.to_json(F.struct("text")), F.lit("\n```"))
    bare = F.regexp_replace(fenced, r"^```(json)?\s*|\s*```$", "")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.from_json(bare, "text string").text.alias("text"))


@query(
    "split_pages",
    f"select conv_id, row_number() over (partition by conv_id order by turn, role, text) - 1 as nth, cast(turn as int) as page, {_STRIP('text')} as "
    f"text from conversations where {_STRIP('text')} <> ''",
)
def split_pages(spark, d):
    """Conversations as documents of marked pages, split again at their marks."""
    marked = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda r: F.concat(F.lit("[[PAGE_"), r.turn, F.lit("]] "), r.text),
            ),
            "\n",
        ).alias("t")
    )
    return marked.select("conv_id", F.posexplode(fn.pages(F.col("t"))).alias("nth", "p")).select(
        "conv_id", F.col("nth").cast("bigint").alias("nth"), F.col("p.page").alias("page"), F.col("p.text").alias("text"),
    )


_CLEAN_OF = _CLEAN.replace("with messy as (select doc_id, " + _MESSY + " as t from documents),\nflat", "flat").replace("from messy", "from notebooks")
_HEAD = lambda b: f"""({b} <> '' and length({b}) <= 90 and (regexp_matches(lower({b}), '^({"|".join(fn.HEADING_PREFIXES)})') or regexp_matches({b}, '^[0-9]+(\\.[0-9]+)*\\s+[A-Za-z].+$')
  or (len(list_filter(regexp_split_to_array({b}, '\\s+'), lambda x: x <> '')) <= 9 and len(list_filter(regexp_split_to_array({b}, '\\s+'), lambda x: regexp_matches(x, '^\\p{{Lu}}'))) >= greatest(1, len(list_filter(regexp_split_to_array({b}, '\\s+'), lambda x: x <> '')) - 2))))"""  # noqa: E731
_TRIMMED = lambda p, sep: f"list_filter(list_transform(regexp_split_to_array({p}, '{sep}'), lambda x: {_STRIP('x')}), lambda x: x <> '')"
#: Chunks for DuckDB, item by item: ``fold`` has after each item the chunk that it went to (m), that chunk's title and
#: heading page, and the state for the next item.
_CHUNKS = f"""with recursive {NOTEBOOKS_SQL}, {_CLEAN_OF},
bits as (select doc_id, text, regexp_extract_all(text, '\\[\\[PAGE_(\\d+)\\]\\]', 1) as nums, regexp_split_to_array(text, '\\[\\[PAGE_\\d+\\]\\]') as b from cleaned),
marked as (select doc_id, p, page, text from (select doc_id, p, cast(nums[p] as int) as page, {_STRIP("b[p + 1]")} as text from (select *, unnest(range(1, len(nums) + 1)) as p from bits)) where text <> ''),
pages as (select * from marked union all select doc_id, 1, 1, text from cleaned where doc_id not in (select doc_id from marked)),
paras as (select doc_id, p, page, unnest(x) as text, unnest(range(len(x))) as q from (select doc_id, p, page, case when len({_TRIMMED("text", chr(92) + "n" + chr(92) + "s*" + chr(92) + "n+")}) > 0 then {_TRIMMED("text", chr(92) + "n" + chr(92) + "s*" + chr(92) + "n+")} else {_TRIMMED("text", chr(92) + "n")} end as x from pages)),
bared as (select *, row_number() over (partition by doc_id order by p, q) as k, {_STRIP("regexp_replace(text, '^:+|:+$', '', 'g')")} as bare from paras),
items as (select *, {_HEAD("bare")} as head, nullif({_STRIP("regexp_replace(regexp_replace(text, '^[0-9]+(\\.[0-9]+)*\\s*', ''), '^[:\\- ]+|[:\\- ]+$', '', 'g')")}, '') as ht from bared),
fold as (
  select doc_id, cast(0 as bigint) as k, {_FILE_TITLE("filename")} as title, cast(null as int) as hp, false as busy, 0 as n, 0 as c, cast(null as int) as m, cast(null as int) as mp from notebooks
  union all
  select doc_id, k, case when head then coalesce(ht, title) else title end, case when head then page when n1 > {notes.FLUSH} then null else hp end,
    not head and n1 <= {notes.FLUSH}, case when head or n1 > {notes.FLUSH} then 0 else n1 end, c + case when head then cast(busy as int) else cast(n1 > {notes.FLUSH} as int) end, case when head then null else c end, hp
  from (select f.doc_id, i.k, f.title, f.hp, f.busy, f.c, i.head, i.ht, i.page, cast(length(i.text) + case when f.busy then f.n + 1 else 0 end as int) as n1 from fold f join items i on i.doc_id = f.doc_id and i.k = f.k + 1)),
found as (
  select doc_id, m as c, any_value(fold.title) as title, string_agg(text, chr(10) || chr(10) order by k) as raw, list_sort(list_distinct(list_concat(list(page), case when any_value(mp) is null then [] else [any_value(mp)] end))) as pages
  from fold join items using (doc_id, k) where m is not null group by doc_id, m),
chunks as (select * from found union all select doc_id, 0, {_FILE_TITLE("filename")}, coalesce(nullif(text, ''), '{notes.NO_TEXT}'), [1] from notebooks join cleaned using (doc_id) where doc_id not in (select doc_id from found)),
grouped as (select *, sum(case when c = 0 or length(raw) >= {notes.SMALL} then 1 else 0 end) over (partition by doc_id order by c) - 1 as nth from chunks),
merged as (
  select doc_id, cast(nth as bigint) as nth, 'section-' || (min(c) + 1) as section_id, arg_min(title, c) as title, string_agg(raw, chr(10) || chr(10) order by c) as raw, list_sort(list_distinct(flatten(list(pages)))) as pages
  from grouped group by doc_id, nth)"""
_LIST = lambda xs: "[" + ", ".join(notes.say_sql(x.replace("{focus}", "{relate}")) for x in xs) + "]"
_SEC = f"""{_CHUNKS},
toks as (select doc_id, nth, unnest(w) as word, unnest(range(len(w))) as pos from (select doc_id, nth, list_filter(regexp_extract_all(lower(raw), '{fn.TOKEN}'), lambda x: length(x) > 2 and x not in ({_STOP})) as w from merged)),
cnt as (select doc_id, nth, word, count(*) as n, min(pos) as first from toks group by all),
kw as (select doc_id, nth, list(replace(word, '_', ' ') order by n desc, first)[1:8] as kws from cnt group by all),
sents as (select doc_id, nth, unnest(s) as sentence, unnest(range(len(s))) as sn from (select doc_id, nth, list_filter(list_transform(string_split(regexp_replace(raw, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_STRIP("x")}), lambda x: x <> '') as s from merged)),
told as (select doc_id, nth, sn, regexp_replace({_STRIP(f"regexp_extract(sentence, '{_DEF}', 1) || ': ' || regexp_replace({_STRIP(f"regexp_extract(sentence, '{_DEF}', 3)")}, '\\.+$', '') || '.'")}, '\\s+', ' ', 'g') as def from sents where regexp_matches(sentence, '{_DEF}')),
firsts as (select doc_id, nth, lower(def) as k, min(sn) as sn, arg_min(def, sn) as def from told group by all),
defs as (select doc_id, nth, list(def order by sn)[1:4] as d from firsts group by all),
base as (
  select m.*, {_FILE_TITLE("filename")} as document_title, list_transform(coalesce(kws, []), lambda x: {_TITLED("x")}) as titles, coalesce(kws, []) as kws, d
  from merged m join notebooks using (doc_id) left join kw using (doc_id, nth) left join defs using (doc_id, nth)),
named as (
  select *, coalesce(d, list_transform(titles[1:3], lambda x: x || '{notes.DEFINITION_PROMPT}')) as definitions, coalesce(nullif(array_to_string(titles[1:4], ', '), ''), 'the central topic') as named_or_central,
    coalesce(nullif(array_to_string(titles[1:4], ', '), ''), title) as named_or_title, coalesce(titles[1], {_TITLED("title")}) as focus, coalesce(titles[1], title) as relate, coalesce(titles[2], 'Related Concepts') as compare, case when len(kws) > 0 then titles[1:6] else [{_TITLED("lower(title)")}] end as head from base),
lists as (
  select *, case when len(definitions) > 0 then split_part(definitions[1], ':', 1) else focus end as term, case when len(kws) > 0 then titles[1:5] else [title] end as topics, {notes.say_sql(notes.EXPLANATION)} as explanation, {_LIST(notes.KEY_POINTS)} as key_points, {_LIST(notes.EXAMPLES)} as examples, {_LIST(notes.USE_CASES)} as use_cases,
    {_LIST(notes.IMPORTANT_NOTES)} as important_notes, '{notes.WHY_THIS_MATTERS}' as why_this_matters, {_LIST(notes.COMMON_MISTAKES)} as common_mistakes, {_LIST(notes.TEST_YOURSELF)} as test_yourself, {_LIST(notes.CUE)} as cue, {notes.say_sql(notes.SUMMARY)} as summary, {notes.say_sql(notes.SENTENCE)} as sentence,
    [title, coalesce(nullif(array_to_string(titles[1:3], ', '), ''), 'Core ideas'), '{notes.CHART_EXPLANATION}'] as chart, list_transform(range(1, len(head) + 1, 2), lambda i: {{'name': head[i], 'sub': head[i + 1 : i + 2]}}) as branches from named),
sec as (
  select *, array_to_string(list_concat(key_points, examples, use_cases[1:1]), chr(10)) as cornell,
    [{{'heading': {notes.say_sql(notes.OUTLINE_HEADINGS[0])}, 'points': key_points[1:2]}}, {{'heading': {notes.say_sql(notes.OUTLINE_HEADINGS[1])}, 'points': list_concat(definitions[1:2], use_cases[1:1])}}, {{'heading': {notes.say_sql(notes.OUTLINE_HEADINGS[2])}, 'points': list_concat(important_notes[1:2], common_mistakes[1:1])}}] as outline
  from lists)"""
_TREE = lambda tree, pad: f"array_to_string(list_transform({tree}, lambda b: chr(10) || '{pad}' || b.name || array_to_string(list_transform(b.sub, lambda x: chr(10) || '{pad}  ' || x), '')), '')"
_MINDMAP = lambda root, lines: f"'mindmap' || chr(10) || '  root((' || {root} || '))' || {lines}"


def _sections(spark, d) -> DataFrame:
    return notes.sections(notebooks(spark, d).select("doc_id", "filename", "text"))


@query("chunk_sections", f"{_CHUNKS} select doc_id, c as nth, 'section-' || (c + 1) as section_id, title, length(raw) as n, array_to_string(pages, ',') as pages from chunks")
def chunk_sections(spark, d):
    return notes.chunks(notebooks(spark, d), merge=False).select(
        "doc_id", "nth", "section_id", "title", F.length("raw_text").alias("n"),
        F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"),
    )


@query("chunk_sections_rows", f"{_CHUNKS} select doc_id, c as nth, 'section-' || (c + 1) as section_id, title, raw as raw_text, array_to_string(pages, ',') as pages from chunks")
def chunk_sections_rows(spark, d):
    """The same chunks of documents that are tables of paragraphs. A text is written once: as paragraphs, or whole where it
    has none but headings."""
    none = F.col("doc_id").isNull() | ~F.exists("__items", lambda x: ~x.head)
    made = notes.cleaned(notebooks(spark, d).select("doc_id", "filename", "text"))
    base = chunking.written(made.select("doc_id", "document_title", F.when(none, F.col("__clean")).alias("__clean"), "__items"))
    rows = base.select("doc_id", "document_title", F.posexplode("__items").alias("k", "x")).select("doc_id", "document_title", F.col("k").cast("bigint").alias("k"), "x.*")
    found = chunking.chunk_rows(rows)
    lone = base.where("__clean is not null").select("doc_id", F.lit(0).cast("bigint").alias("nth"), F.inline(notes.lone_chunk()))
    return found.unionByName(lone).withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query("chunk_merge", f"{_CHUNKS} select doc_id, nth, section_id, title, raw as raw_text, array_to_string(pages, ',') as pages from merged")
def chunk_merge(spark, d):
    return notes.chunks(notebooks(spark, d)).select("doc_id", "nth", "section_id", "title", "raw_text", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


_LISTS = ["key_points", "definitions", "topics", "examples", "use_cases", "important_notes", "common_mistakes", "test_yourself", "chart"]


@query(
    "fallback_sections",
    f"{_SEC} select doc_id, nth, section_id, title, explanation, why_this_matters, sentence, "
    f"{", ".join(f"array_to_string({c}, '|') as {c}" for c in _LISTS)}, array_to_string(list_transform(outline, lambda x: x.heading || ': ' || "
    f"array_to_string(x.points, '; ')), '|') as outline from sec",
)
def fallback_sections(spark, d):
    flat = F.array_join(F.transform("outline", lambda x: F.concat(x.heading, F.lit(": "), F.array_join(x.points, "; "))), "|")
    return _sections(spark, d).select("doc_id", "nth", "section_id", "title", "explanation", "why_this_matters", "sentence", *[F.array_join(c, "|").alias(c) for c in _LISTS], flat.alias("outline"))


_OPTIONS_SQL = {k: "[" + ", ".join(map(notes.say_sql, v)) + "]" for k, v in notes.QUESTION_OPTIONS.items()}
_ASKED = " union all ".join(
    f"select doc_id, nth, {i} as place, '{kind}' as type, '{hard}' as difficulty, {notes.say_sql(q)} as question, array_to_string({_OPTIONS_SQL.get(kind, '[]')}, '|') as options,"
    f" 0 as answer_index, {notes.say_sql(hint)} as answer_hint, {notes.say_sql(notes.QUESTION_EXPLANATIONS[kind])} as explanation from sec"
    for i, (kind, hard, q, hint) in enumerate(notes.QUESTIONS)
)


@query("exam_questions", f"{_SEC} {_ASKED}")
def exam_questions(spark, d):
    return notes.exam_questions(_sections(spark, d)).withColumn("options", F.array_join("options", "|"))


@query("branch_tree", f"{_SEC} select doc_id, nth, b.name, array_to_string(b.sub, '|') as sub from (select doc_id, nth, unnest(branches) as b from sec)")
def branch_tree(spark, d):
    return _sections(spark, d).select("doc_id", "nth", F.inline_outer("branches")).where("name is not null").select("doc_id", "nth", "name", F.array_join("sub", "|").alias("sub"))


@query("mermaid_text", f"{_SEC} select doc_id, nth, {_MINDMAP('title', _TREE('branches', '    '))} as mermaid from sec")
def mermaid_text(spark, d):
    return _sections(spark, d).select("doc_id", "nth", notes.mindmap(F.col("title"), notes.branch_lines(F.col("branches"), 2)).alias("mermaid"))


def _package(spark, d, *only: str) -> DataFrame:
    diagrams = table(spark, d, "benchmark").select((F.col("item_id") % 50).alias("doc_id"))
    return notes.package(_sections(spark, d), diagrams, only=list(only))


_PKG = f"""{_SEC},
cues as (select doc_id, list(c order by place) as cue from (select doc_id, arg_min(c, place) as c, min(place) as place from (select doc_id, nth * 10 + i as place, {_STRIP("regexp_replace(cue[i], '\\s+', ' ', 'g')")} as c from (select doc_id, nth, cue, unnest([1, 2, 3]) as i from sec)) group by doc_id, lower(c)) group by doc_id),
n_pages as (select doc_id, count(*) as source_pages from pages group by doc_id),
shown as (select item_id % 50 as doc_id, count(*) as total_diagrams from benchmark group by 1),
pkg as (
  select doc_id, document_title as t, count(*) as n, array_to_string(list(title || chr(10) || cornell order by nth), chr(10) || chr(10)) as notes, array_to_string(list(summary order by nth)[1:6], ' ') as summary,
    flatten(list(outline order by nth)) as outline, {_MINDMAP('document_title', "array_to_string(list(chr(10) || '    ' || title || " + _TREE('branches', '      ') + " order by nth), '')")} as mindmap, list(array_to_string(chart, ' | ') order by nth) as chart,
    list(chart order by nth) as chart_rows, list({{'name': title, 'sub_branches': list_transform(branches, lambda b: {{'name': b.name, 'sub_branches': list_transform(b.sub, lambda x: {{'name': x, 'sub_branches': cast([] as varchar[])}})}})}} order by nth) as tree,
    array_to_string(list(title || ': ' || summary order by nth)[1:4], ' ') as overview, array_to_string(list(sentence order by nth), chr(10) || chr(10)) as told
  from sec group by doc_id, document_title),
package as (select pkg.*, array_to_string(cue[1:15], '|') as cue, cue[1:15] as cue_list, overview || chr(10) || chr(10) || told as sentence, source_pages, coalesce(total_diagrams, 0) as total_diagrams,
  case when source_pages <= 1 then 1 else greatest(1, cast(round_even(source_pages * 0.35::double, 0) as bigint)) end as least_pages, case when source_pages <= 1 then 2 else greatest(2, cast(round_even(source_pages * 0.55::double, 0) as bigint)) end as most_pages
  from pkg join cues using (doc_id) join n_pages using (doc_id) left join shown using (doc_id))"""


@query("agg_cornell", f"{_PKG} select doc_id, t || ' - Cornell Notes' as title, cue, notes, summary from package")
def agg_cornell(spark, d):
    return _package(spark, d, "cue", "notes", "summary").select("doc_id", F.col("cornell_title").alias("title"), F.array_join("cue", "|").alias("cue"), "notes", "summary")


@query(
    "agg_outline",
    f"{_PKG} select doc_id, t || ' - Outline' as title, place, outline[place + 1].heading as heading, array_to_string(outline[place + 1].points, "
    f"'|') as points from (select *, unnest(range(len(outline))) as place from package)",
)
def agg_outline(spark, d):
    rows = _package(spark, d, "outline").select("doc_id", F.col("outline_title").alias("title"), F.posexplode("outline").alias("place", "o"))
    return rows.select("doc_id", "title", F.col("place").cast("bigint").alias("place"), "o.heading", F.array_join("o.points", "|").alias("points"))


@query("agg_mindmap", f"{_PKG} select doc_id, t || ' - Mind Map' as title, mindmap from package")
def agg_mindmap(spark, d):
    return _package(spark, d, "mindmap").select("doc_id", F.col("mindmap_title").alias("title"), "mindmap")


@query(
    "agg_chart",
    f"{_PKG} select doc_id, t || ' - Chart' as title, '{" | ".join(notes.CHART_COLUMNS)}' as columns, place, chart[place + 1] as line from (select "
    f"*, unnest(range(len(chart))) as place from package)",
)
def agg_chart(spark, d):
    rows = _package(spark, d, "chart").select("doc_id", F.col("chart_title").alias("title"), F.posexplode("chart").alias("place", "c"))
    return rows.select("doc_id", "title", F.lit(" | ".join(notes.CHART_COLUMNS)).alias("columns"), F.col("place").cast("bigint").alias("place"), F.array_join("c", " | ").alias("line"))


@query("agg_sentence", f"{_PKG} select doc_id, sentence from package")
def agg_sentence(spark, d):
    return _package(spark, d, "sentence").select("doc_id", "sentence")


@query("global_summary", f"{_PKG} select doc_id, overview as global_summary from package")
def global_summary(spark, d):
    return _package(spark, d, "global_summary").select("doc_id", "global_summary")


@query(
    "package_totals",
    f"{_PKG} select doc_id, n as total_sections, n * 4 as total_questions, total_diagrams, source_pages, least_pages, most_pages, "
    f"'{notes.VOLUME_RULE}' as volume_rule from package",
)
def package_totals(spark, d):
    return _package(spark, d).select("doc_id", "total_sections", "total_questions", "total_diagrams", "source_pages", "least_pages", "most_pages", "volume_rule")


_S = notes.STRATEGIES


@query(
    "revision_strategy",
    f"{_CHUNKS}, n as (select doc_id, count(*) as n from merged group by 1) select doc_id, case when n <= 1 then '{_S['single']}' when length(text) "
    f"< 1500 then '{_S['other']}' when length(text) < 6000 then '{_S['intermediate']}' else '{_S['advanced']}' end as strategy from cleaned join n "
    f"using (doc_id)",
)
def revision_strategy(spark, d):
    docs = notebooks(spark, d)
    counts = notes.chunks(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    levels = docs.select("doc_id", fn.difficulty(fn.clean(F.col("text"))).alias("level"))
    return levels.join(counts, "doc_id").select("doc_id", notes.revision_strategy(F.col("n"), F.col("level")).alias("strategy"))


_VIEWS = ["cornell", "Sentence", "mindmap", "outline", "chart", "full", "unknown"]


_LAYOUTS_SQL = {
    "cornell": "{'title': t || ' - Cornell Notes', 'format': 'cornell', 'cue': cue_list, 'notes': notes, 'summary': summary}",
    "outline": "{'title': t || ' - Outline', 'format': 'outline', 'sections': outline}",
    "mindmap": "{'title': t || ' - Mind Map', 'format': 'mindmap', 'root': t, 'mermaid': mindmap, 'branches': tree}",
    "chart": f"{{'title': t || ' - Chart', 'format': 'chart', 'columns': [{', '.join(repr(c) for c in notes.CHART_COLUMNS)}], 'rows': chart_rows}}",
}
_FIELDS_SQL = ", ".join(f"'{k}': {({'excerpt': f'substr(raw, 1, {notes.EXCERPT})'}).get(c, c)}" for k, c in notes.SECTION_FIELDS.items())
_QUESTION_SQL = ", ".join(
    f"{{'type': '{kind}', 'difficulty': '{hard}', 'question': {notes.say_sql(q)}, 'options': {_OPTIONS_SQL.get(kind, 'cast([] as varchar[])')}, 'answer_index': 0,"
    f" 'answer_hint': {notes.say_sql(hint)}, 'explanation': {notes.say_sql(notes.QUESTION_EXPLANATIONS[kind])}}}"
    for kind, hard, q, hint in notes.QUESTIONS
)
#: Diagrams of a document's sections: each with its best section, as in ``matching.attached``.
_ATTACHED = f"""shown_of as (select item_id as diagram_id, item_id % 50 as doc_id, cast(item_id % 10 as int) as page, text as caption from benchmark),
scored as (
  select d.*, s.nth, s.section_id, s.title, case when list_contains(s.pages, page) then 5 else 0 end + 3 * len(list_filter(topics, lambda x: contains(lower(caption), lower(x))))
    + case when title <> '' and contains(lower(caption), lower(title)) then 4 else 0 end as score
  from shown_of d join sec s using (doc_id)),
attached as (
  select doc_id, nth, section_id, diagram_id, page, caption, '{matching.BELONGS[0]}' || title || '{matching.BELONGS[1]}' as explanation,
    'flowchart TD\n  A[' || title || '] --> B[' || caption || ']\n  B --> C[{matching.SHOWN[0]}]\n  C --> D[{matching.SHOWN[1]}]' as mermaid_code
  from scored qualify row_number() over (partition by diagram_id order by score desc, nth) = 1)"""
_FULL = f"""{_PKG}, {_ATTACHED},
gathered as (select doc_id, list({{{_FIELDS_SQL}}} order by nth) as sections, flatten(list([{_QUESTION_SQL}] order by nth)) as questions from sec group by doc_id),
pictures as (select doc_id, list({{'diagram_id': diagram_id, 'section_id': section_id, 'page_number': page, 'caption': caption, 'explanation': explanation, 'mermaid_code': mermaid_code}} order by diagram_id) as diagrams from attached group by doc_id),
levels as (select doc_id, case when length(text) < 1500 then 'beginner' when length(text) < 6000 then 'intermediate' else 'advanced' end as level from cleaned),
fulls as (
  select package.*, sections, questions, coalesce(diagrams, []) as diagrams, level,
    case when n <= 1 then '{_S["single"]}' when level = 'beginner' then '{_S["other"]}' when level = 'intermediate' then '{_S["intermediate"]}' else '{_S["advanced"]}' end as strategy
  from package join gathered using (doc_id) join levels using (doc_id) left join pictures using (doc_id))"""
_FULL_SQL = (
    "{'document_title': t, 'total_sections': n, 'sections': sections, 'notes': {" + ", ".join(f"'{k}': {v}" for k, v in _LAYOUTS_SQL.items()) + ", 'sentence': sentence}, 'diagrams': diagrams,"
    " 'questions': questions, 'global_summary': overview, 'difficulty_level': level, 'recommended_revision_strategy': strategy,"
    f" 'note_volume_policy': {{'source_pages': source_pages, 'target_note_pages': {{'min': least_pages, 'max': most_pages}}, 'rule': '{notes.VOLUME_RULE}'}}}}"
)
_AS_JSON = lambda x: f"cast(to_json({x}) as varchar)"


def attached_diagrams(spark, d) -> DataFrame:
    """The items of ``benchmark`` as diagrams of the documents 0 to 49, with their best sections; only documents that have
    diagrams are made into sections for it."""
    i = F.col("item_id")
    shown = table(spark, d, "benchmark").select((i % 50).alias("note_id"), i.alias("diagram_id"), (i % 10).cast("int").alias("page"), F.col("text").alias("caption"))
    docs = notebooks(spark, d).select("doc_id", "filename", "text").join(shown.select(F.col("note_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return matching.attached(shown, notes.sections(docs).withColumnRenamed("doc_id", "note_id")).withColumnRenamed("note_id", "doc_id")


@query(
    "note_format_view",
    f"""{_FULL}, v as (select *, [{", ".join(f"'{v}'" for v in _VIEWS)}][doc_id % {len(_VIEWS)} + 1] as format from fulls)
select doc_id, format, case lower(format) when 'sentence' then sentence when 'mindmap' then {_AS_JSON(_LAYOUTS_SQL["mindmap"])} when 'outline' then {_AS_JSON(_LAYOUTS_SQL["outline"])}
  when 'chart' then {_AS_JSON(_LAYOUTS_SQL["chart"])} when 'full' then {_AS_JSON(_FULL_SQL)} else {_AS_JSON(_LAYOUTS_SQL["cornell"])} end as content from v""",
)
def note_format_view(spark, d):
    s = _sections(spark, d)
    p = notes.package(s, attached_diagrams(spark, d), full=True)
    p = p.withColumn("format", F.get(F.array(*map(F.lit, _VIEWS)), (F.col("doc_id") % len(_VIEWS)).cast("int")))
    return p.select("doc_id", "format", notes.format_view(p, F.col("format")).alias("content"))


_COUNT = lambda x: f"cast(len(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+')) as bigint)"
_FLAT_TREE = "array_to_string(list_transform(branches, lambda b: b.name || ' ' || array_to_string(b.sub, ' ')), ' ')"
_SECTION_WORDS = _COUNT(
    f"concat_ws(' ', title, array_to_string(topics, ' '), array_to_string(cue, ' '), cornell, summary, title, "
    f"array_to_string(list_transform(outline, lambda x: x.heading || ' ' || array_to_string(x.points, ' ')), ' '), title, "
    f"{_MINDMAP('title', _TREE('branches', '    '))}, {_FLAT_TREE}, array_to_string(chart, ' '), sentence)"
)
_COUNTED = f"{_SEC}, counted as (select doc_id, title, row_number() over (partition by doc_id order by nth) - 1 as order_index, {_SECTION_WORDS} as word_count from sec where title <> '')"


@query("sections_table", f"{_COUNTED} select sha256(doc_id || '|' || order_index) as id, doc_id as note_id, title, order_index, word_count from counted")
def sections_table(spark, d):
    return notes.sections_table(_sections(spark, d))


@query(
    "note_record",
    f"{_COUNTED} select doc_id as note_id, count(*) as total_sections, cast(sum(word_count) as bigint) as word_count, greatest(1, "
    f"cast(round_even(sum(word_count) / 180.0, 0) as bigint)) as estimated_read_time, 0 as progress, false as is_favorite from counted group by 1",
)
def note_record(spark, d):
    return notes.note_record(_sections(spark, d))


@query("formats_table", f"""{_SEC}, picked as (select *, (doc_id + nth) % 5 = 0 as bare from sec)
select doc_id, nth, unnest(['cornell', 'outline', 'mindmap', 'chart', 'sentence']) as format_type,
unnest([cast(to_json({{'cue': cue, 'notes': cornell, 'summary': summary}}) as varchar), case when bare then '{notes.EMPTY_FORMATS["outline"]}' else cast(to_json({{'title': title, 'sections': outline}}) as varchar) end, cast(to_json({{'root': title, 'branches': branches}}) as varchar),
  case when bare then '{notes.EMPTY_FORMATS["chart"]}' else cast(to_json({{'columns': [{", ".join(f"'{c}'" for c in notes.CHART_COLUMNS)}], 'rows': [chart]}}) as varchar) end, sentence]) as content from picked""")
def formats_table(spark, d):
    """A fifth of the sections lack two of their layouts."""
    bare = (F.col("doc_id") + F.col("nth")) % 5 == 0
    s = _sections(spark, d)
    return notes.formats_table(s.withColumns({c: F.when(~bare, F.col(c)) for c in ("outline", "chart")}))


@query("section_word_count", f"{_SEC} select doc_id, nth, {_SECTION_WORDS} as words from sec")
def section_word_count(spark, d):
    return notes.sections_table(_sections(spark, d)).select(F.col("note_id").alias("doc_id"), F.col("order_index").alias("nth"), F.col("word_count").alias("words"))


@query("read_time", f"{_COUNTED} select doc_id, greatest(1, cast(round_even(sum(word_count) / 180.0, 0) as bigint)) as minutes from counted group by 1")
def read_time(spark, d):
    return notes.note_record(_sections(spark, d)).select(F.col("note_id").alias("doc_id"), F.col("estimated_read_time").alias("minutes"))


@query(
    "notes_metadata",
    "select doc_id as note_id, coalesce(nullif(case when doc_id % 3 = 0 then source end, ''), 'generated') as source, 0 as progress, "
    "coalesce(quality = 1, false) as is_favorite from documents left join labels using (doc_id)",
)
def notes_metadata(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    given = F.when(F.col("doc_id") % 3 == 0, F.col("source"))
    return rows.select(
        F.col("doc_id").alias("note_id"), F.coalesce(quiz.missing(given), F.lit("generated")).alias("source"), F.lit(0).alias("progress"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("is_favorite"),
    )


@query("upload_history", "select doc_id, row_number() over (partition by source order by doc_id desc) as rank, source from documents where doc_id % 3 <> 0")
def upload_history(spark, d):
    rows = table(spark, d, "documents").where("doc_id % 3 <> 0").select("doc_id", "source")
    return quiz.last_attempts(rows.withColumnRenamed("doc_id", "attempt_id"), "source", 2**31).withColumnRenamed("attempt_id", "doc_id")


@query("diagram_filter", f"select item_id, regexp_matches(lower(text), '{'|'.join(fn.DIAGRAM_WORDS)}') or item_id * 1000 >= 30000 as is_diagram from benchmark")
def diagram_filter(spark, d):
    return table(spark, d, "benchmark").select("item_id", fn.is_diagram(F.col("item_id"), F.lit(1000), F.col("text")).alias("is_diagram"))


@query(
    "captions",
    f"select item_id, case when item_id % 4 = 0 then 'Diagram extracted from page ' || item_id % 10 else "
    f"substr({_STRIP("regexp_replace(text, '\\s+', ' ', 'g')")}, 1, 140) end as caption from benchmark",
)
def captions(spark, d):
    near = F.when(F.col("item_id") % 4 == 0, "").otherwise(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", fn.caption(F.col("item_id") % 10, near).alias("caption"))


@query(
    "diagram_mermaid",
    "select item_id, 'flowchart TD\n  A[Note ' || item_id || '] --> B[' || substr(text, 1, 20) || ']\n  B --> C[Structure or flow]\n  C --> D[Exam "
    "explanation]' as mermaid from benchmark",
)
def diagram_mermaid(spark, d):
    return table(spark, d, "benchmark").select("item_id", fn.mermaid(F.concat(F.lit("Note "), "item_id"), F.substring("text", 1, 20), "Structure or flow", "Exam explanation").alias("mermaid"))


_EXPLAINED = " || title || ".join(f"'{x}'" for x in matching.EXPLANATION)


@query(
    "diagram_defaults",
    f"""with given as (select item_id, 'Note ' || item_id as title, coalesce(case when item_id % 2 = 0 then nullif(text, '') end, '{matching.CAPTION}Note ' || item_id) as caption from benchmark)
select item_id, title, caption, case when item_id % 3 = 0 then 'own' else {_EXPLAINED} end as explanation, 'flowchart TD\n  A[' || title || '] --> B[' || caption || ']\n  B --> C[{matching.STEPS[0]}]\n  C --> D[{matching.STEPS[1]}]' as mermaid_code from given""",
)
def diagram_defaults(spark, d):
    i = F.col("item_id")
    given = table(spark, d, "benchmark").select(
        "item_id", F.concat(F.lit("Note "), i).alias("title"), F.when(i % 2 == 0, F.col("text")).otherwise("").alias("caption"),
        F.when(i % 3 == 0, "own").alias("explanation"), F.lit("").alias("mermaid_code"),
    )
    return matching.enrich(given)


def _diagrams(spark, d) -> tuple[DataFrame, DataFrame]:
    """A note has two diagrams and twenty sections."""
    diagrams = table(spark, d, "benchmark").select(
        F.floor(F.col("item_id") / 2).alias("note_id"), F.col("item_id").alias("diagram_id"), (F.col("item_id") % 10).cast("int").alias("page"),
        F.col("text").alias("caption"),
    )
    s = table(spark, d, "part").select(
        F.floor(F.col("p_partkey") / 20).alias("note_id"), F.col("p_partkey").alias("nth"), F.concat(F.lit("s"), "p_partkey").alias("section_id"),
        F.col("p_brand").alias("title"), F.array(F.substring("p_type", 1, 2), F.lit("the")).alias("topics"),
        F.array((F.col("p_size") % 10).cast("int")).alias("pages"),
    )
    return diagrams, s


@query(
    "diagram_best_section",
    """with s as (select d.item_id as diagram_id, p_partkey as nth, 's' || p_partkey as section_id, case when p_size % 10 = d.item_id % 10 then 5 else 0 end
 + 3 * (case when contains(lower(text), lower(substr(p_type, 1, 2))) then 1 else 0 end + case when contains(lower(text), 'the') then 1 else 0 end)
 + case when contains(lower(text), lower(p_brand)) then 4 else 0 end as score from benchmark d join part on p_partkey // 20 = d.item_id // 2)
select diagram_id, section_id, cast(score as bigint) as score from s qualify row_number() over (partition by diagram_id order by score desc, nth) = 1""",
)
def diagram_best_section(spark, d):
    return matching.best_section(*_diagrams(spark, d))


@query(
    "diagram_hints",
    "with m as (select p_partkey // 20 as note_id, p_partkey as nth, item_id as diagram_id, row_number() over (partition by p_partkey order by "
    "item_id) as rank from part join benchmark on p_partkey // 20 = item_id // 2 and p_size % 10 = item_id % 10) select * from m where rank <= 3",
)
def diagram_hints(spark, d):
    return matching.hints(*_diagrams(spark, d))


@query(
    "nearby_text",
    """with blocks as (select cast(p_size as bigint) as page_id, p_partkey as nth, p_partkey % 97 * 5.0::double as x0, p_partkey % 31 * 20.0::double as y0, p_partkey % 97 * 5.0::double + 60 as x1, p_partkey % 31 * 20.0::double + 12 as y1, p_brand as text from part),
images as (select item_id as image_id, item_id % 50 + 1 as page_id, 100.0 as l, 200.0 as t, 180.0 as r, 260.0 as b from benchmark),
n as (select image_id, nth, text, least(abs(y1 - t), abs(y0 - b)) as gap from images join blocks using (page_id) where least(abs(y1 - t), abs(y0 - b)) <= 120 or not (x1 < l or x0 > r)),
k as (select *, row_number() over (partition by image_id order by gap, nth) as rank from n qualify rank <= 3)
select image_id, coalesce(string_agg(text, ' ' order by rank), '') as near from images left join k using (image_id) group by 1""",
)
def nearby_text(spark, d):
    p, num = F.col("p_partkey"), lambda x: F.lit(float(x))
    blocks = table(spark, d, "part").select(
        F.col("p_size").cast("bigint").alias("page_id"), p.alias("nth"), (p % 97 * num(5)).alias("x0"), (p % 31 * num(20)).alias("y0"),
        (p % 97 * num(5) + 60).alias("x1"), (p % 31 * num(20) + 12).alias("y1"), F.col("p_brand").alias("text"),
    )
    images = table(spark, d, "benchmark").select(
        F.col("item_id").alias("image_id"), (F.col("item_id") % 50 + 1).alias("page_id"), num(100).alias("left"), num(200).alias("top"),
        num(180).alias("right"), num(260).alias("bottom"),
    )
    return matching.nearby_text(images, blocks)


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


@query("too_similar")
def too_similar(spark, d):
    """Whether an item's text is over 0.82 alike to the next item's, on 2500 characters of single blanks."""
    flat = lambda c: F.substring(F.lower(F.regexp_replace(c, r"\s+", " ")), 1, 2500)
    a = table(spark, d, "benchmark")
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return a.join(b, "item_id").select("item_id", (_ratio(flat(F.col("text")), flat(F.col("other"))) > 0.82).alias("too_similar"))
