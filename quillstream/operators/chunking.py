"""Chunks of documents that are tables of paragraphs, of any length: no row, task or fold holds a whole document.

:func:`notes.chunks` folds a document in its own row. Here a document is rows, dealt over many tasks. Between two headings
a chunk that starts at some paragraph ends where its length passes ``notes.FLUSH``; lengths summed up from the document's
start turn that into a number, and the paragraph in whose stretch of characters the number lies is the last one before it
in a bucket of characters. So each paragraph knows where the next chunk would start if one started with it. Which ones do
start a chunk follows by pointer doubling from each heading's first paragraph: after k rounds the first 2 ** k are known.

All this takes lengths and places only, in tables that go when the next is written. Texts are shuffled once, to their slice
of the document, where they meet the starts of chunks; only chunks at the edges of slices are put together after that.
"""

from __future__ import annotations

import atexit
import gc

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..sources.stores import scratch
from . import notes

#: Paragraphs of a slice, in which sums run, and characters of a bucket.
SLICE, BUCKET = 4096, 65536


def written(df: DataFrame) -> DataFrame:
    """``df`` written and read back, so that what reads it twice does not make it twice. The table goes when the process
    ends, or with :func:`release`."""
    spark = df.sparkSession
    path = scratch(spark, "chunking")
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # Spark deletes shuffle files of frames that nothing refers to any more
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Deletes tables that :func:`written` wrote, once all that reads them is written itself."""
    for t in tables:
        _remove(t.sparkSession, t.written_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone; the folder's owner clears it
        pass


def _slice() -> Column:
    return F.floor(F.col("k") / SLICE)


def with_sums(rows: DataFrame, **amounts: Column) -> DataFrame:
    """Adds each amount summed over a document's rows up to this one, by ``k``: sums of slices of rows, and sums inside a
    slice, so a task holds ``SLICE`` rows of a document, and a number for each slice of it."""
    parts = rows.withColumns({f"__{n}": a.cast("bigint") for n, a in amounts.items()}).withColumn("__slice", _slice())
    totals = parts.groupBy("doc_id", "__slice").agg(*[F.sum(f"__{n}").alias(f"__of_{n}") for n in amounts])
    before = Window.partitionBy("doc_id").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("doc_id", "__slice", *[F.coalesce(F.sum(f"__of_{n}").over(before), F.lit(0)).alias(f"__before_{n}") for n in amounts])
    inside = Window.partitionBy("doc_id", "__slice").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = parts.withColumns({f"__{n}": F.sum(f"__{n}").over(inside) for n in amounts}).join(totals, ["doc_id", "__slice"])
    return summed.select(*rows.columns, *[(F.col(f"__{n}") + F.col(f"__before_{n}")).alias(n) for n in amounts])


def following(items: DataFrame, most: int = notes.FLUSH) -> DataFrame:
    """(doc_id, k, next) of items (doc_id, k, block, low, high): where the next chunk starts if one starts at k. Items
    whose chunk goes on to the end of their block have no row, or one that leads to no item."""
    edges = (F.floor(F.col("low") / BUCKET), F.floor((F.col("high") - 1) / BUCKET))
    spans = items.select("doc_id", F.explode(F.sequence(*edges)).alias("bucket"), F.col("low").alias("at"), F.lit(0).alias("kind"), "k", "block", F.struct("k", "block", "high").alias("e"))
    aims = items.select("doc_id", "k", "block", (F.col("low") + most + 1).alias("at")).select(
        "doc_id", F.floor(F.col("at") / BUCKET).alias("bucket"), "at", F.lit(1).alias("kind"), "k", "block", F.lit(None).cast(spans.schema["e"].dataType).alias("e"),
    )
    upto = Window.partitionBy("doc_id", "bucket").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = spans.unionByName(aims).withColumn("e", F.last("e", ignorenulls=True).over(upto))
    return met.where((F.col("kind") == 1) & (F.col("e.high") > F.col("at")) & (F.col("e.block") == F.col("block"))).select("doc_id", "k", (F.col("e.k") + 1).alias("next"))


def chunk_starts(first: DataFrame, pointers: DataFrame) -> DataFrame:
    """(doc_id, k) of all that pointers lead to from ``first`` (doc_id, k). The longest chain of n takes log2 n rounds."""
    found, pointers = written(first), written(pointers)
    while not pointers.isEmpty():
        more = written(found.unionByName(found.join(pointers, ["doc_id", "k"]).select("doc_id", F.col("next").alias("k"))))
        hop = pointers.select("doc_id", F.col("k").alias("next"), F.col("next").alias("then"))
        further = written(pointers.join(hop, ["doc_id", "next"]).select("doc_id", "k", F.col("then").alias("next")))
        release(found, pointers)
        found, pointers = more, further
    release(pointers)
    return found


def chunk_rows(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, nth, section_id, title, raw_text, pages) of (doc_id, k, page, text, head, document_title), k from 0: what
    :func:`notes.chunks` gives without merging. Documents with nothing but headings have no row, nor has what has no
    doc_id. Reads ``paragraphs`` twice: for lengths and headings, and for texts."""
    head, text, known = F.col("head"), F.col("text"), paragraphs.where("doc_id is not null")
    named = F.when(head, F.nullif(fn.heading_text(text, F.lit("")), F.lit("")))
    first_title = F.when(F.col("k") == 0, F.col("document_title")).alias("document_title")
    lean = written(known.select("doc_id", "k", "head", F.when(head, F.col("page")).alias("head_page"), named.alias("named"), first_title, F.when(head, 0).otherwise(F.length(text) + 1).alias("n")))
    rows = written(with_sums(lean, block=head.cast("int"), titled=F.col("named").isNotNull().cast("int"), high=F.col("n")))
    release(lean)
    items = rows.where(~head).select("doc_id", "k", "block", "titled", (F.col("high") - F.col("n")).alias("low"), "high")
    first = items.groupBy("doc_id", "block").agg(F.min("k").alias("k")).select("doc_id", "k")
    found = chunk_starts(first, following(items))
    starts = written(_named(found.join(items.select("doc_id", "k", "titled"), ["doc_id", "k"]), rows))
    slices = written(_slices(items, starts))
    release(found, rows)
    return _texts(known.where(~head), starts, slices)


def _named(starts: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, k, title, head_page) of the starts of chunks: the last heading with a name, and the page of a heading that
    stands right before."""
    heads = rows.where("head").select("doc_id", (F.col("k") + 1).alias("k"), "head_page")
    titles = rows.where("k = 0").select("doc_id", F.lit(0).cast("bigint").alias("titled"), F.col("document_title").alias("title"))
    titles = titles.unionByName(rows.where("named is not null").select("doc_id", "titled", F.col("named").alias("title")))
    return starts.join(heads, ["doc_id", "k"], "left").join(titles, ["doc_id", "titled"], "left").select("doc_id", "k", "title", "head_page")


def _slices(items: DataFrame, starts: DataFrame) -> DataFrame:
    """(doc_id, slice, n, before, more) of each slice of a document: chunks that start in it and before it, and whether a
    slice follows."""
    both = items.select("doc_id", "k", F.lit(0).alias("n")).unionByName(starts.select("doc_id", "k", F.lit(1).alias("n")))
    order = Window.partitionBy("doc_id").orderBy("slice")
    return both.groupBy("doc_id", _slice().alias("slice")).agg(F.sum("n").alias("n")).select(
        "doc_id", "slice", "n", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lead("slice").over(order).isNotNull().alias("more"),
    )


def _texts(texts: DataFrame, starts: DataFrame, slices: DataFrame) -> DataFrame:
    """The chunks: texts take the number of the last start before them in their slice, or of the chunk that goes on from
    the slice before. The first and the last chunk of a slice may have parts in others, and only these are joined up."""
    inside = Window.partitionBy("doc_id", "slice").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = starts.withColumn("slice", _slice()).withColumn("rank", F.count(F.lit(1)).over(inside)).join(slices, ["doc_id", "slice"])
    none = lambda t: F.lit(None).cast(t)
    of = lambda chunk, edge: F.struct(chunk.alias("chunk"), edge.alias("edge"))
    begun = ranked.select("doc_id", "slice", "k", F.lit(1).alias("kind"), of(F.col("before") + F.col("rank"), (F.col("rank") == F.col("n")) & F.col("more")).alias("of"), "title", "head_page", none("int").alias("page"), none("string").alias("text"))
    carried = slices.where("before > 0").select(
        "doc_id", "slice", (F.col("slice") * SLICE).alias("k"), F.lit(0).alias("kind"), of(F.col("before"), F.lit(True)).alias("of"), none("string").alias("title"), none("int").alias("head_page"), none("int").alias("page"), none("string").alias("text"),
    )
    own = texts.select("doc_id", _slice().alias("slice"), "k", F.lit(2).alias("kind"), none(begun.schema["of"].dataType).alias("of"), none("string").alias("title"), none("int").alias("head_page"), "page", "text")
    upto = Window.partitionBy("doc_id", "slice").orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = own.unionByName(begun).unionByName(carried).withColumn("of", F.last("of", ignorenulls=True).over(upto))
    told = [F.max(c).alias(c) for c in ("title", "head_page")]
    parts = dealt.groupBy("doc_id", "slice", F.col("of.chunk").alias("chunk"), F.col("of.edge").alias("edge")).agg(F.collect_list(F.when(F.col("kind") == 2, F.struct("k", "page", "text"))).alias("own"), *told)
    full = parts.where(~F.col("edge")).select("doc_id", "chunk", "own", "title", "head_page")
    if not slices.where("before > 0").isEmpty():
        full = full.unionByName(parts.where("edge").groupBy("doc_id", "chunk").agg(F.flatten(F.collect_list("own")).alias("own"), *told))
    full = full.withColumn("own", F.sort_array("own"))
    pages = F.concat(F.transform("own", lambda x: x.page), F.when(F.col("head_page").isNotNull(), F.array("head_page")).otherwise(F.array().cast("array<int>")))
    return full.select(
        "doc_id", (F.col("chunk") - 1).alias("nth"), F.concat(F.lit("section-"), "chunk").alias("section_id"), "title",
        F.array_join(F.transform("own", lambda x: x.text), "\n\n").alias("raw_text"), F.array_sort(F.array_distinct(pages)).alias("pages"),
    )
