"""Queries over the normalised tables of note packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import normalize as norm
from ..operators import notes
from ..sources.tables import table
from .base import query
from .documents import _ATTACHED, _COUNTED, _sections, attached_diagrams

_KEYED = f"""{_COUNTED}, kept as (select sec.*, order_index, word_count, sha256(sec.doc_id || '|' || order_index) as section_key
  from (select *, row_number() over (partition by doc_id order by nth) - 1 as k from sec where title <> '') sec join counted on counted.doc_id = sec.doc_id and order_index = k)"""
_SUBJECT = "case when doc_id % 3 > 0 then upper(lang) else '' end"


def _tables(spark, d, written: bool = False) -> norm.Tables:
    s = _sections(spark, d)
    docs = table(spark, d, "documents")
    subjects = docs.select(F.col("doc_id").alias("note_id"), F.when(F.col("doc_id") % 3 > 0, F.upper("lang")).otherwise("").alias("subject"))
    return norm.normalize(s, subjects, attached_diagrams(spark, d).withColumnRenamed("doc_id", "note_id"), written)


@query(
    "normalized_note",
    f"""{_COUNTED}, totals as (select doc_id, count(*) as n, sum(word_count) as w from counted group by 1),
titles as (select doc_id, any_value(document_title) as title from sec group by 1)
select doc_id as note_id, coalesce(nullif(title, ''), 'Untitled Note') as title, coalesce(nullif({_SUBJECT}, ''), 'general') as subject,
       case when length(c.text) < 1500 then 'beginner' when length(c.text) < 6000 then 'intermediate' else 'advanced' end as difficulty, {_SUBJECT} as tags, n as total_sections,
       greatest(1, cast(round_even(w / 180.0, 0) as bigint)) as estimated_read_time, 0 as progress, false as is_favorite
from documents join totals using (doc_id) join titles using (doc_id) join cleaned c using (doc_id)""",
)
def normalized_note(spark, d):
    return _tables(spark, d).note.withColumn("tags", F.array_join("tags", "|"))


@query("normalized_sections", f"{_KEYED} select section_key as section_id, doc_id as note_id, title, order_index, word_count from kept")
def normalized_sections(spark, d):
    return _tables(spark, d).sections


@query(
    "normalized_content",
    f"""{_KEYED} select section_key as section_id, {", ".join(f"array_to_string({c}, '|') as {c}" for c in norm.LISTS)}, {", ".join(norm.TEXTS)}, 4 as questions from kept""",
)
def normalized_content(spark, d):
    joined = {c: F.array_join(c, "|") for c in norm.LISTS}
    return _tables(spark, d).section_content.withColumns(joined | {"questions": F.size("questions")})


@query(
    "normalized_formats",
    f"""{_KEYED} select section_key as section_id, unnest(['cornell', 'outline', 'mindmap', 'chart', 'sentence']) as format_type,
unnest([cast(to_json({{'cue': cue, 'notes': cornell, 'summary': summary}}) as varchar), cast(to_json({{'title': title, 'sections': outline}}) as varchar), cast(to_json({{'root': title, 'branches': branches}}) as varchar),
  cast(to_json({{'columns': [{", ".join(f"'{c}'" for c in notes.CHART_COLUMNS)}], 'rows': [chart]}}) as varchar), sentence]) as content from kept""",
)
def normalized_formats(spark, d):
    return _tables(spark, d).formats


@query("normalized_diagrams", f"{_KEYED}, {_ATTACHED} select section_key as section_id, diagram_id, page, caption, attached.explanation, mermaid_code from attached join kept using (doc_id, nth)")
def normalized_diagrams(spark, d):
    return _tables(spark, d).diagrams


_KINDS = {"mcq": "mcq", "conceptual": "short", "theory": "long", "application": "long"}
_ASKED = " union all ".join(
    f"select doc_id, section_key, order_index, {i} as i, '{_KINDS[kind]}' as kind, {notes.say_sql(q)} as question from kept" for i, (kind, _, q, _) in enumerate(notes.QUESTIONS)
)


@query(
    "normalized_quiz",
    f"{_KEYED}, asked as ({_ASKED}) select doc_id as note_id, section_key as section_id, kind, row_number() over (partition by doc_id, kind order by order_index, i) - 1 as place, question from asked",
)
def normalized_quiz(spark, d):
    return _tables(spark, d).quiz


@query(
    "normalized_links",
    f"""{_KEYED}, {_ATTACHED}
select 'section_content' as child, 'sections' as parent, count(*) as rows, 0 as orphans from kept union all select 'formats', 'sections', 5 * count(*), 0 from kept
union all select 'diagrams', 'sections', count(*), 0 from attached union all select 'sections', 'note', count(*), 0 from kept union all select 'quiz', 'note', 4 * count(*), 0 from kept""",
)
def normalized_links(spark, d):
    """Rows of each table, and those that lead nowhere: none."""
    return _tables(spark, d, written=True).orphans()
