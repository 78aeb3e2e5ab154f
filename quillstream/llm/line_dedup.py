"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, SPACES, cut, keyed, packed, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    r"""Adds ``n_lines``, ``n_dropped`` and ``kept_text`` to ``docs``.

    A text is split at ``\n``. A line's key (:func:`line_key`) of ``min_chars`` code points or more, found in
    ``min_docs`` documents or more, loses its lines in all of them but the one with the smallest row key.

    Null and empty texts are one empty line. A document that loses every line keeps an empty text. Rows with a null or
    repeated id are documents of their own, in order of ids, null last. Lines are compared by 128 bits of hash.
    Columns of ``docs`` with the names of new ones are replaced. An empty table gives an empty one.

    Plan: lines travel as hashes; counts are combined before the shuffle; the join of lines with the repeated hashes
    reads a written table, so that Spark broadcasts it only if it is small and splits hot hashes otherwise. The text
    is shuffled once, to meet its own dropped positions.
    """
    docs = keyed(docs, id_col)
    lines = (
        docs.select(ROW, F.posexplode(F.split(text_or_empty(text), "\n")).alias("pos", "line"))
        .select(ROW, "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(ROW, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))
    )
    seen = lines.groupBy("h1", "h2").agg(
        F.min(ROW).alias("first"), F.max(ROW).alias("last"), *([F.count_distinct(ROW).alias("n")] if min_docs > 2 else [])
    )
    repeated = cut(seen.where(F.col("first") != F.col("last") if min_docs == 2 else F.col("n") >= min_docs).select("h1", "h2", "first"))
    dropped = (
        lines.join(repeated, ["h1", "h2"]).where(F.col(ROW) != F.col("first")).groupBy(ROW).agg(F.collect_list("pos").alias("__dropped"))
    )
    whole = text_or_empty(text)
    n_lines = (F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    parts = F.split(whole, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__dropped"))
    return (
        docs.join(dropped.hint("shuffle_hash"), ROW, "left")
        .withColumn("n_lines", n_lines)
        .withColumn("n_dropped", F.coalesce(F.size("__dropped"), F.lit(0)).cast("bigint"))
        .withColumn("kept_text", F.when(F.col("__dropped").isNull(), whole).otherwise(F.array_join(F.transform(kept, lambda p: F.get(parts, p)), "\n")))
        .drop("__dropped", ROW)
    )


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with their kept lines as text and its length as n_chars.

    No row goes: a document that loses every line has an empty text. Rows with a null or repeated id are documents of
    their own, in order of ids, null last. Other columns stay as they are, whatever their names; an empty table stays one.
    """
    out = line_dedup(packed(docs, "doc_id", "text"))
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("bigint")}
    return out.select(*[new.get(c, F.col(f"__doc.`{c}`")).alias(c) for c in docs.columns])


LINES_SQL = r"""
lines as (
  select doc_id, pos, line,
         translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(parts) as line, unnest(range(len(parts))) as pos
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from {docs}))
),
firsts as (select key, min(doc_id) as first_id from lines where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
lined as (
  select doc_id, count(*) as n_lines, count(first_id) filter (where lines.doc_id <> first_id) as n_dropped,
         coalesce(string_agg(line, chr(10) order by pos) filter (where first_id is null or lines.doc_id = first_id), '') as kept_text
  from lines left join firsts using (key) group by doc_id
)"""
SQL = "with " + LINES_SQL.format(docs="documents") + " select doc_id, n_lines, n_dropped, sha256(kept_text) as kept_sha256 from lined"
