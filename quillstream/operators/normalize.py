"""Note packages to six linked tables, from one written pass over their sections, or one of them from its own.

Keys are hashes of the note and the section's place in it, so a job that runs again gives the same ones, and every table is
made from the same written rows: what links one to another is a column that both copy. Only the note and its quiz counts
are grouped, by notes whose sections are neighbours in the written rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..sources.stores import scratch
from . import notes
from .quiz import bucket

MOST = 2000
LISTS = ["topics", "key_points", "definitions", "examples", "use_cases", "important_notes", "common_mistakes", "test_yourself"]
TEXTS = ["explanation", "why_this_matters"]


@dataclass
class Tables:
    """The normalised tables; ``note_id`` and ``section_id`` link them."""

    note: DataFrame
    sections: DataFrame
    section_content: DataFrame
    formats: DataFrame
    diagrams: DataFrame
    quiz: DataFrame

    def orphans(self) -> DataFrame:
        """(child, parent, rows, orphans): for each link the child's rows, and those whose key its parent lacks."""
        links = [(n, "sections", "section_id") for n in ("section_content", "formats", "diagrams")] + [(n, "note", "note_id") for n in ("sections", "quiz")]
        found = None
        for child, parent, key in links:
            keys = getattr(self, parent).select(key).distinct().withColumn("met", F.lit(1))
            counts = getattr(self, child).select(key).join(keys, key, "left").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("met").isNull()).alias("orphans"))
            row = counts.select(F.lit(child).alias("child"), F.lit(parent).alias("parent"), "rows", "orphans")
            found = row if found is None else found.unionByName(row)
        return found


def trimmed(c: Column) -> Column:
    return F.substring(fn.strip(F.coalesce(c, F.lit(""))), 1, MOST)


def normalize(sections: DataFrame, subjects: DataFrame, diagrams: DataFrame, written: bool = True) -> Tables:
    """The tables of ``sections`` (:func:`notes.sections`, a package's sections), ``subjects`` (note_id, subject) and
    ``diagrams`` (:func:`matching.attached`).

    Sections without a title go, and the rest are numbered from 0; lists lose what repeats but for case and outer blanks;
    texts are stripped and cut at 2000 characters. A note without titled sections keeps its row, with nothing to read.
    ``quiz`` has a row for each question with its group: mcq, short or long.

    Where one table alone is wanted, without ``written`` it evaluates of the sections what it has of them, and no more.
    """
    titled = F.coalesce("title", F.lit("")) != ""
    place = F.row_number().over(Window.partitionBy("doc_id", titled).orderBy("nth")) - 1
    rows = sections.withColumn("order_index", F.when(titled, place).cast("bigint")).withColumn("word_count", F.when(titled, notes.section_words(sections)).otherwise(0))
    rows = rows.withColumn("questions", notes.questions_of()).select(
        F.col("doc_id").alias("note_id"), "nth", F.when(titled, F.sha2(F.concat_ws("|", "doc_id", "order_index"), 256)).alias("section_id"), trimmed(F.col("title")).alias("title"), "order_index", "word_count",
        "document_title", "level", *[trimmed(F.col(c)).alias(c) for c in TEXTS], *[fn.dedupe_stripped(F.col(c)).alias(c) for c in LISTS], "questions", notes.format_rows().alias("formats"),
    )
    kept = rows
    if written:
        path = scratch(rows.sparkSession, "normal")
        rows.write.parquet(path)
        kept = rows.sparkSession.read.schema(rows.schema).parquet(path)
    own = kept.where("section_id is not null")
    totals = kept.groupBy("note_id").agg(
        F.first("document_title").alias("title"), F.first("level").alias("difficulty"), F.count("section_id").alias("total_sections"),
        F.sum("word_count").alias("words"),
    )
    subject = F.coalesce(F.nullif("subject", F.lit("")), F.lit("general"))
    note = totals.join(subjects, "note_id", "left").select(
        "note_id", F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled Note")).alias("title"), subject.alias("subject"), "difficulty",
        F.filter(F.array(fn.strip(F.coalesce("subject", F.lit("")))), lambda x: x != "").alias("tags"), "total_sections",
        notes.read_time(F.col("words"), F.col("total_sections")).alias("estimated_read_time"), F.lit(0).alias("progress"), F.lit(False).alias("is_favorite"),
    )
    met = diagrams.join(own.select("note_id", "nth", F.col("section_id").alias("__section")), ["note_id", "nth"])
    asked = own.select("note_id", "section_id", "order_index", F.posexplode("questions").alias("i", "q"))
    of = Window.partitionBy("note_id", bucket(F.col("q.type"))).orderBy("order_index", "i")
    return Tables(
        note,
        own.select("section_id", "note_id", "title", "order_index", "word_count"),
        own.select("section_id", *LISTS, *TEXTS, F.col("questions")),
        own.select("section_id", F.inline("formats")),
        met.select(F.col("__section").alias("section_id"), "diagram_id", "page", "caption", "explanation", "mermaid_code"),
        asked.select("note_id", "section_id", bucket(F.col("q.type")).alias("kind"), (F.row_number().over(of) - 1).cast("bigint").alias("place"), "q.question"),
    )

