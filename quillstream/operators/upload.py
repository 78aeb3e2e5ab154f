"""The upload flow: files to registered notes, with what was found in them on record in the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..sources import files as read
from ..sources.stores import append, register, scratch
from ..sources.versioned import VersionedStore
from . import matching, notes

PREVIEW = 500
#: What an upload leaves in the log.
EVENT = "note_id string, kind string, ts string, filename string, size_kb double, topic string, total_questions bigint, diagrams_count bigint"


def _written(rows: DataFrame, name: str) -> DataFrame:
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def upload(files: DataFrame, diagrams: DataFrame, store: VersionedStore, log: str, now: str, written: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(uploads, sections, diagrams) of ``files`` (filename, content) and ``diagrams`` (filename, diagram_id, page, caption).

    Files of an allowed type are read as text, given a topic, and made into notes; diagrams go to their best sections; notes
    are registered in ``store``, and an event with sizes and counts is appended to ``log``. Uploads has a row for each
    file: note_id, filename, status, size_kb, text_preview, topic, total_sections, total_questions, diagrams_count; a file
    of another type has status 400 and nothing else. A note's key is a hash of its file's name and content, so the same
    file again replaces its note.

    Files are read twice: for what is told of each, with a preview of its text, and for sections. Both are written once; all
    else reads them, so no text is shuffled or read again. Without ``written`` the sections are counted, and their columns
    made by whoever reads them: for uploads of which nothing but the first table is wanted.
    """
    spark = files.sparkSession
    key = F.sha2(F.concat(F.col("filename"), F.lit(":"), F.sha2("content", 256)), 256)
    allowed = fn.extension(F.col("filename")).isin(fn.ALLOWED)
    known = files.where(allowed).withColumns({"__key": key, "size_kb": F.bround(F.octet_length("content") / F.lit(1024.0), 1)})
    read_in = read.extract_text(known)
    preview = F.substring(F.regexp_replace("text", fn.PAGE_MARK + r"\s*", ""), 1, PREVIEW).alias("text_preview")
    told_of = read_in.select("__key", "filename", "size_kb", fn.topic(F.col("filename"), F.col("text")).alias("topic"), preview)
    texts = _written(told_of, "files")
    sections = notes.sections(read_in.select(F.col("__key").alias("doc_id"), "filename", "text"))
    if written:
        sections = _written(sections, "uploads")
    counts = _written(sections.groupBy(F.col("doc_id").alias("__key")).agg(F.first("document_title").alias("document_title"), F.count(F.lit(1)).alias("total_sections")), "counts")
    shown = diagrams.join(texts.select("filename", F.col("__key").alias("note_id")), "filename")
    placed = matching.attached(shown.select("note_id", "diagram_id", "page", "caption"), sections.withColumnRenamed("doc_id", "note_id"))
    per_note = shown.groupBy(F.col("note_id").alias("__key")).agg(F.count(F.lit(1)).alias("diagrams_count"))
    made = texts.join(counts, "__key").join(per_note, "__key", "left").withColumn("diagrams_count", F.coalesce("diagrams_count", F.lit(0).cast("bigint")))
    made = made.withColumn("total_questions", (F.col("total_sections") * len(notes.QUESTIONS)).cast("bigint"))
    register(made.select(F.col("__key").alias("note_key"), "document_title", "topic"), store, now)
    told = made.withColumn("note_id", F.sha2("__key", 256))
    append(told.select("note_id", F.lit("upload_processed").alias("kind"), F.lit(now).alias("ts"), "filename", "size_kb", "topic", "total_questions", "diagrams_count"), log)
    done = told.select("note_id", "filename", F.lit(200).alias("status"), "size_kb", "text_preview", "topic", "total_sections", "total_questions", "diagrams_count")
    return done.unionByName(files.where(~allowed).select("filename", F.lit(400).alias("status")), allowMissingColumns=True), sections, placed
