"""Substring dedup on a de Bruijn graph of words: words of long passages that stand elsewhere too are removed.

Edges are the k-mers, windows of ``LENGTH`` words; nodes are the words that two consecutive ones share. As graph
assemblers do, ``repeats`` deals k-mers out by their minimizer (anchor) in stretches, runs of consecutive k-mers with one
minimizer. A stretch that stands twice or more is a run of repeated edges. Runs are compacted into paths: where every
place of one run is followed by the same next run, and every place of the next is preceded by the first, the node between
them does not branch. Successors and predecessors are joined to find these nodes, and runs between branching nodes become
one path, whose first run's places, times the path's length, give the repeated spans. Of stretches that stand once, edges
shared with another stretch of their minimizer give spans of their own. Equality is of the words at the source
coordinates: word by word in a bucket, by 128-bit digests of the words where whole stretches are equal.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import ROW, PrefixHash, cut, keyed, mix, ranges, utf8_parts, word_bounds
from .repeats import by_document, merged, placed, search

LENGTH, GRAM = 35, 9
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words between ASCII white space, and which word is each text's first."""
    begins, ends, first = word_bounds(~_SPACE[data], starts)
    return PrefixHash(data).of(begins, ends - begins), first


def word_tokens(data: np.ndarray, starts: np.ndarray):
    """Words between ASCII white space, as hashes, and their places where one space follows each of them."""
    begins, ends, first = word_bounds(~_SPACE[data], starts)
    size = ends - begins
    values = PrefixHash(data).of(begins, size)
    flat = np.append(data, np.uint8(32))[ranges(begins, size + 1)]
    stops = np.cumsum(size + 1) - 1
    flat[stops] = 32
    return values, first, stops - size, stops, flat


def twins(bucket: np.ndarray, offset: np.ndarray, place: np.ndarray, values: np.ndarray, begin: np.ndarray, end: np.ndarray, raw: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which edges have an equal one at the same offset in their bucket; equal in their words, not by hash alone."""
    edge = PrefixHash(values).of(place, length)
    key = mix(edge ^ mix(bucket.astype(np.uint64) * np.uint64(1 << 20) + (offset - offset.min()).astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((key[a] == key[b]) & (bucket[a] == bucket[b]) & (offset[a] == offset[b]))
    found, whole = np.zeros(len(place), bool), raw.tobytes()
    begins, ends = begin[place].tolist(), end[place + length - 1].tolist()
    for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
        if whole[begins[x] : ends[x]] == whole[begins[y] : ends[y]]:
            found[x] = found[y] = True
    return found


def compact(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(d1, d2, runs) for the first run of every nonbranching path of repeated runs; ``runs`` is the path's one span.

    ``members`` are the places of all runs, ``classes`` the runs with their number of places ``n``.
    """
    repeated = classes.where("n > 1").select(F.struct("d1", "d2").alias("id"), "n", "one")
    places = members.join(classes.where("n > 1").select("d1", "d2"), ["d1", "d2"]).select(F.struct("d1", "d2").alias("id"), ROW, "lo", "hi")
    in_text = Window.partitionBy(ROW).orderBy("lo")
    follow = places.withColumn("next", F.when(F.lead("lo").over(in_text) == F.col("hi") + 1, F.lead("id").over(in_text)))
    follow = cut(follow.where("next is not null").groupBy("id", "next").agg(F.count(F.lit(1)).alias("times")))
    runs = repeated.select("id", "n")
    # the node between a run and its next does not branch if all places of both runs meet there
    joined = follow.join(runs, "id").where("times = n").drop("n").join(runs.withColumnRenamed("id", "next"), "next").where("times = n")
    linked = joined.select(F.col("next").alias("id"), F.lit(1).alias("inner"))
    # along a path the runs' first places follow each other in one text, so paths are islands in coordinate order
    at = Window.partitionBy("one." + ROW).orderBy("one.lo")
    steps = repeated.join(linked, "id", "left").withColumn("path", F.sum(F.when(F.col("inner").isNull(), 1).otherwise(0)).over(at))
    row, path = F.col("one." + ROW).alias("row"), F.col("path")
    paths = steps.groupBy(row, path).agg(F.min_by("id", "one.lo").alias("head"), F.min("one.lo").alias("lo"), F.max("one.hi").alias("hi"))
    span = F.array(F.struct(F.lit(0).alias("start"), (F.col("hi") - F.col("lo") + LENGTH).cast("int").alias("stop")))
    return paths.select("head.*", span.alias("runs"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (the maximal removed runs of words) and ``kept_text``.

    Words lie between ASCII white space, unchanged; null and empty texts have none, and texts shorter than the window
    lose none. A window counts as repeated if its words also start elsewhere, in the same document or another, overlaps
    included; so all copies of a repeated row lose what they share. ``kept_text`` joins the kept words by one space. Rows
    with a null or repeated id are documents of their own; an empty table gives an empty one. Memory is some 90 bytes for each byte of the longest text, which its task holds whole.
    Columns of ``docs`` with these names are replaced.
    """
    docs = keyed(docs.drop("n_words", "spans", "kept_text"), id_col)
    members, classes, partly = search(docs, text, word_tokens, LENGTH, GRAM, twins, seconds=False)
    alone = partly.join(classes.where("n = 1").select("d1", "d2"), ["d1", "d2"])
    runs = cut(compact(members, classes).unionByName(alone))
    spans = by_document(placed(members, runs))
    joined = docs.join(spans.hint("shuffle_hash"), ROW, "left").drop(ROW)
    run_type = ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())]))
    schema = StructType([*joined.drop("spans").schema.fields, StructField("n_words", IntegerType()), StructField("__spans", run_type), StructField("kept_text", StringType())])
    names = joined.columns

    def run(batches):
        for batch in batches:
            data, starts = utf8_parts(batch.column(names.index(text)))
            lists = batch.column(names.index("spans"))
            counts, runs, kept = [], [], []
            for k in range(batch.num_rows):
                words, found = data[starts[k] : starts[k + 1]].tobytes().split(), lists[k]
                counts.append(len(words))
                if found.is_valid:
                    s = found.values
                    opens, closes = merged(s.field("start").to_numpy(), s.field("stop").to_numpy(), len(words))
                    cuts = [0, *np.column_stack([opens, closes]).ravel().tolist(), len(words)]
                    words = [w for a, b in zip(cuts[::2], cuts[1::2], strict=True) for w in words[a:b]]
                    runs.append([{"start": int(a), "stop": int(b)} for a, b in zip(opens, closes, strict=True)])
                else:
                    runs.append([])
                kept.append(b" ".join(words))
            rest = [batch.column(i) for i, n in enumerate(names) if n != "spans"]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(counts, pa.int32()), pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(kept, pa.binary()).cast(pa.string())], names=[*(n for n in names if n != "spans"), "n_words", "__spans", "kept_text"]
            )

    return joined.mapInArrow(run, schema).withColumnRenamed("__spans", "spans")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s.stop - s.start)
    return out.select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), removed.alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(docs: list[tuple], length: int = LENGTH) -> list[tuple]:
    """For tests."""
    texts = [(i, (t or "").encode().split()) for i, t in docs]
    seen = Counter(tuple(t[s : s + length]) for _, t in texts for s in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = {p for s in range(len(t) - length + 1) if seen[tuple(t[s : s + length])] > 1 for p in range(s, s + length)}
        out.append((i, len(t), len(gone), hashlib.sha256(b" ".join(w for p, w in enumerate(t) if p not in gone)).hexdigest()))
    return out


SQL = rf"""with worded as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') as words from documents),
windows as (
  select doc_id, i, array_to_string(words[i : i + {LENGTH - 1}], ' ') as k
  from (select doc_id, words, unnest(range(1, len(words) - {LENGTH - 2})) as i from worded where len(words) >= {LENGTH})),
repeated as (select k from windows group by k having count(*) > 1),
gone as (select doc_id, list(distinct p) as places from (select doc_id, unnest(range(i, i + {LENGTH})) as p from windows join repeated using (k)) group by doc_id)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(len(places), 0) as bigint) as n_removed,
  sha256(array_to_string(list_filter(words, lambda w, i: places is null or not list_contains(places, i)), ' ')) as kept_sha256
from worded left join gone using (doc_id)"""
