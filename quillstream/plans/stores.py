"""Queries over stores, files and notes that are looked up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import notes
from ..sources import files, stores
from ..sources.tables import notebooks, table
from .base import query
from .documents import _AS_JSON, _COUNTED, _LAYOUTS_SQL, _PKG, _sections


@query(
    "notes_store",
    "select 'n' || c_custkey as id, c_name as title, upper(c_mktsegment) as topic, case when c_custkey % 2 = 0 then 'generated' else 'static' end "
    "as source, cast(c_custkey % 100 as int) as progress, c_custkey % 3 = 0 as is_favorite from customer",
)
def notes_store(spark, d):
    """Notes appended to a store in two jobs, between lines that are no records, and read again."""
    c = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        c, F.concat(F.lit("n"), c).alias("id"), F.col("c_name").alias("title"), F.upper("c_mktsegment").alias("topic"),
        F.when(c % 2 == 0, "generated").otherwise("static").alias("source"), (c % 100).cast("int").alias("progress"),
        (c % 3 == 0).alias("is_favorite"),
    )
    path = stores.scratch(spark, "notes")
    for part in (c % 2 == 0, c % 2 == 1):
        stores.append(rows.where(part).drop("c_custkey"), path)
    spark.createDataFrame([("{broken",), ("[1, 2]",), ("",)], "value string").write.mode("append").text(path)
    return stores.read(spark, path, stores.NOTE).drop("updated")


@query(
    "attempts_store",
    "select cast(o_orderkey as varchar) as id, cast(o_custkey as varchar) as note_id, case when o_orderkey % 3 = 0 then 'all' else o_orderstatus "
    "end as topic, case when o_orderkey % 5 = 0 then 'Quiz' else o_orderpriority end as topic_label, cast(case when o_orderkey % 4 = 0 then 0 else "
    "o_custkey % 100 end as int) as score, 0 as total, 0 as correct, 0 as n_weak, 60 as duration_seconds from orders",
)
def attempts_store(spark, d):
    o = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        o.cast("string").alias("id"), F.col("o_custkey").cast("string").alias("note_id"), F.when(o % 3 != 0, F.col("o_orderstatus")).alias("topic"), F.when(o % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("topic_label"),
        F.when(o % 4 != 0, F.col("o_custkey") % 100).alias("score"), F.lit(None).cast("int").alias("total"), F.lit(None).cast("int").alias("correct"), F.lit(None).cast("array<string>").alias("weak_topics"), F.lit(60).alias("duration_seconds"),
    )
    path = stores.scratch(spark, "attempts")
    stores.save_attempts(rows, path)
    return stores.read(spark, path, stores.ATTEMPT).withColumn("n_weak", F.size("weak_topics")).drop("weak_topics")


@query("missing_store", "select cast(null as varchar) as id where false")
def missing_store(spark, d):
    """A store whose folder is not there is empty."""
    return stores.read(spark, stores.scratch(spark, "none"), stores.ATTEMPT).select("id")


@query(
    "register_notes",
    """select sha256(cast(doc_id as varchar)) as id, case when doc_id % 4 = 0 then source || ', again' else source end as title, case when doc_id % 3 = 0 then 'UPLOAD' else upper(lang) end as topic,
'generated' as source, case when doc_id % 4 = 0 then '2024-02-01 09:00' else '2024-01-31 10:00' end as updated from documents""",
)
def register_notes(spark, d):
    """Notes registered, some of them again under another title, and compacted in between: one record each."""
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(i.alias("note_key"), F.col("source").alias("document_title"), F.when(i % 3 == 0, "").otherwise(F.col("lang")).alias("topic"))
    store = stores.note_store(spark, stores.scratch(spark, "registered"))
    stores.register(rows, store, "2024-01-31 10:00")
    store.compact()
    again = rows.where("note_key % 4 = 0").withColumn("document_title", F.concat("document_title", F.lit(", again")))
    stores.register(again, store, "2024-02-01 09:00")
    return store.read().select("id", "title", "topic", "source", "updated")


_NAME = "source || '_' || doc_id || ['.txt', '.MD', '.ppt', '', '.Txt'][doc_id % 5 + 1]"


def _named_files(spark, d):
    suffix = F.get(F.array(*map(F.lit, [".txt", ".MD", ".ppt", "", ".Txt"])), (F.col("doc_id") % 5).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("_"), "doc_id", suffix).alias("filename"), F.encode("text", "utf-8").alias("content"))


@query(
    "extract_text",
    f"select doc_id, filename, case when doc_id % 5 in (0, 1, 4) then text else '[Extracted text from ' || filename || ' - install "
    f"PyPDF2/python-docx for real extraction]' end as text from (select *, {_NAME} as filename from documents)",
)
def extract_text(spark, d):
    return files.extract_text(_named_files(spark, d))


@query(
    "extract_text_strict",
    f"select doc_id, filename, case when doc_id % 5 = 0 then text end as text, case when doc_id % 5 = 0 then 200 else 400 end as status from "
    f"(select *, {_NAME} as filename from documents)",
)
def extract_text_strict(spark, d):
    return files.extract_text_strict(_named_files(spark, d))


@query(
    "note_preferences",
    "select doc_id, case when doc_id % 2 = 0 then 'brief' else 'deep' end as note_depth, case when doc_id % 3 = 0 then 'chart' else 'cornell' end "
    "as preferred_format, doc_id % 5 > 0 as exam_focus, true as include_examples, doc_id % 7 <> 1 as include_diagrams from documents",
)
def note_preferences(spark, d):
    i, none = F.col("doc_id"), F.lit(None)
    given = table(spark, d, "documents").select(
        "doc_id", F.when(i % 2 == 0, "brief").alias("note_depth"), F.when(i % 3 == 0, "chart").alias("preferred_format"), F.when(i % 5 == 0, F.lit(False)).alias("exam_focus"), none.cast("boolean").alias("include_examples"), F.when(i % 7 == 1, F.lit(False)).alias("include_diagrams"),
    )
    return notes.preferences(given)


@query(
    "hint_images",
    "select note_id, nth, 'data:image/' || case when nth % 3 = 0 then 'png' else 'jpeg' end || ';base64,' || base64(encode(text)) as image_url from "
    "(select item_id // 4 as note_id, item_id as nth, text, row_number() over (partition by item_id // 4 order by item_id) as r from benchmark) "
    "where r <= 2 and nth % 5 > 0 and strlen(text) <= 4000000",
)
def hint_images(spark, d):
    i = F.col("item_id")
    path = F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("img"), i, F.get(F.array(*map(F.lit, [".png", ".jpg", ".JPEG"])), (i % 3).cast("int"))))
    return notes.hint_images(table(spark, d, "benchmark").select(F.floor(i / 4).alias("note_id"), i.alias("nth"), path.alias("path"), F.encode("text", "utf-8").alias("content")))


@query(
    "hint_files",
    """select note_id, nth, 'data:image/' || case when nth % 3 = 0 then 'png' else 'jpeg' end || ';base64,' || base64(encode(text || chr(10))) as image_url
from (select item_id // 4 as note_id, item_id as nth, text, row_number() over (partition by item_id // 4 order by item_id) as r from benchmark) where r <= 2 and nth % 5 > 0 and nth <> 9""",
)
def hint_files(spark, d):
    """The same of files, one of which is too large."""
    i = F.col("item_id")
    name = F.concat(F.lit("img"), i, F.get(F.array(*map(F.lit, [".png", ".jpg", ".JPEG"])), (i % 3).cast("int")))
    path = stores.scratch(spark, "images")
    text = F.when(i == 9, F.repeat("text", F.ceil(F.lit(5_000_000) / F.length("text")).cast("int"))).otherwise(F.col("text"))
    table(spark, d, "benchmark").select(text.alias("text"), name.alias("image")).write.partitionBy("image").text(path)
    hints = table(spark, d, "benchmark").select(F.floor(i / 4).alias("note_id"), i.alias("nth"), F.when(i % 5 == 0, "").otherwise(name).alias("path"))
    return notes.hint_files(hints, path)


@query(
    "notes_list",
    "select 0 as origin, 's' || page_id as id, url as title, 'web' as topic, 'static' as source, 0 as progress, false as is_favorite from pages "
    "union all select 1, 'g' || doc_id, source, lang, 'generated', cast(doc_id % 100 as int), coalesce(quality = 1, false) from documents left join "
    "labels using (doc_id)",
)
def notes_list(spark, d):
    null = lambda kind: F.lit(None).cast(kind)
    static = table(spark, d, "pages").select(
        F.concat(F.lit("s"), "page_id").alias("id"), F.col("url").alias("title"), F.lit("web").alias("topic"), F.lit("static").alias("source"),
        null("int").alias("progress"), null("boolean").alias("is_favorite"),
    )
    made = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return notes.list_notes(
        static,
        made.select(
            F.concat(F.lit("g"), "doc_id").alias("id"), F.col("source").alias("title"), F.col("lang").alias("topic"), null("string").alias("source"),
            (F.col("doc_id") % 100).cast("int").alias("progress"), (F.col("quality") == 1).alias("is_favorite"),
        ),
    )


_FORMATS = ["cornell", "outline", "sentence", "nothing"]


@query(
    "note_content",
    f"""{_PKG}, wanted as (select doc_id, [{", ".join(f"'{x}'" for x in _FORMATS)}][doc_id % 4 + 1] as format from documents),
made as (
  select doc_id, format, case format when 'sentence' then sentence when 'outline' then {_AS_JSON(_LAYOUTS_SQL["outline"])} else {_AS_JSON(_LAYOUTS_SQL["cornell"])} end as content
  from wanted join package using (doc_id) where doc_id % 2 = 0)
select doc_id as note_id, format, coalesce(content, case when doc_id % 3 = 0 then case when format = 'outline' then 'static outline' else 'static notes' end end, '') as content
from wanted left join made using (doc_id, format)""",
)
def note_content(spark, d):
    i = F.col("note_id")
    ids = table(spark, d, "documents").select(F.col("doc_id").alias("note_id"))
    packages = notes.package(_sections(spark, d).where("doc_id % 2 = 0")).withColumnRenamed("doc_id", "note_id")
    static = ids.where(i % 3 == 0).withColumn("layouts", F.create_map(F.lit("cornell"), F.lit("static notes"), F.lit("outline"), F.lit("static outline")))
    return notes.note_content(ids.withColumn("format", F.get(F.array(*map(F.lit, _FORMATS)), (i % 4).cast("int"))), packages, static)


@query(
    "stored_record",
    f"{_COUNTED} , rec as (select doc_id, count(*) as n, cast(sum(word_count) as bigint) as w from counted where doc_id % 3 > 0 group by 1) select doc_id as note_id, coalesce(cast(to_json({{'total_sections': n, 'word_count': w, 'estimated_read_time': greatest(1, cast(round_even(w / 180.0, 0) as bigint)), 'progress': 0, 'is_favorite': false}}) as varchar), '{{}}') as record from documents left join (select * from rec where n is not null) using (doc_id)".replace(
        "coalesce(cast(to_json", "coalesce(case when n is not null then cast(to_json",
    ).replace(" as varchar), '{}')", " as varchar) end, '{}')"),
)
def stored_record(spark, d):
    ids = table(spark, d, "documents").select(F.col("doc_id").alias("note_id"))
    return notes.stored_record(ids, notes.note_record(notes.sections(notebooks(spark, d).where("doc_id % 3 > 0").select("doc_id", "filename", "text"))))
