r"""Ranked lexical search by NRA (no random access) over impact-sorted lists.

Documents become vectors of the terms that some query may hold: a bitmap of the queries' terms, of fixed size, goes to
every task, so other words never leave it. Document frequencies and the corpus's sums follow from the vectors. Vectors
are dealt to shards by a hash; queries come to every shard in blocks of bounded size. A shard sorts each term's postings
by impact once. For a query it reads its terms' lists in step, from the highest impact down. A document's score lies
between the sum of what was read of it and that sum with the next unread impact of each list in which it was not yet
met. Reading goes on until no other document, read or unread, can pass or tie with the best ``k``; then only for these,
until each one's two bounds are one. The best of all shards are ranked at last.

All impacts are 64-bit integers, so scores are exact.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, ShortHash, cut, keyed, ranges, release, utf8_parts, word_bounds

BEST = 10
SLICE_BYTES = 2_000_000
#: Postings of a shard, and terms of a block of queries, on average.
SHARD_POSTINGS, BLOCK_TERMS = 1_000_000, 100_000
#: Bits of the bitmap of the queries' terms: 1 MB however many there are.
MARK_BITS = 1 << 23
#: Postings of each list that are read at first; then twice as many each time.
FIRST_DEPTH = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def text_slices(data: np.ndarray, starts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Parts of about ``most`` bytes of texts that lie back to back, so that no word goes over an end."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + most)
        if hi < n:
            outside = np.flatnonzero(~_IN_WORD[data[lo:hi]])
            text_ends = starts[np.searchsorted(starts, hi, "right") - 1]
            best = max(lo + int(outside[-1]) + 1 if len(outside) else lo, int(text_ends))
            if best <= lo:  # inside a long word: on to its end
                best = int(starts[np.searchsorted(starts, hi, "left")])
                while hi < best:
                    outside = np.flatnonzero(~_IN_WORD[data[hi : min(best, hi + most)]])
                    if len(outside):
                        best = hi + int(outside[0]) + 1
                    hi += most
            hi = best
        yield lo, hi
        lo = hi


def _words(column: pa.Array, marked: np.ndarray | None) -> tuple[np.ndarray, pa.Table]:
    """The number of words of each text, and (doc, term, bit, tf) of its terms that are marked; all if ``marked`` is None."""
    data, starts = utf8_parts(column)
    counts, parts, last, again = np.zeros(len(starts) - 1, np.int64), [], -1, False
    for lo, hi in text_slices(data, starts, SLICE_BYTES):
        a, b = int(np.searchsorted(starts, lo, "right")) - 1, int(np.searchsorted(starts, hi, "left"))
        low, local = _LOWER[data[lo:hi]], np.clip(starts[a : b + 1], lo, hi) - lo
        begins, ends, first = word_bounds(_IN_WORD[low], local)
        counts[a:b] += np.diff(first)
        again |= a == last
        last = b - 1
        if not len(begins):
            continue
        bit = ShortHash(low).of(begins, ends - begins) % np.uint64(MARK_BITS)
        doc = np.repeat(np.arange(a, b), np.diff(first))
        if marked is not None:
            kept = (marked[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            begins, ends, bit, doc = begins[kept], ends[kept], bit[kept], doc[kept]
        lengths = ends - begins
        letters = low[ranges(begins, lengths)]
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        spelled = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
        codes, size = spelled.indices.to_numpy(), max(1, len(spelled.dictionary))
        both, at, tf = np.unique(doc * size + codes, return_index=True, return_counts=True)
        parts.append(pa.table({"doc": both // size, "term": spelled.dictionary.take(pa.array(both % size)), "bit": bit[at].astype(np.int64), "tf": tf}))
    if not parts:
        return counts, pa.table({"doc": pa.array([], pa.int64()), "term": pa.array([], pa.string()), "bit": pa.array([], pa.int64()), "tf": pa.array([], pa.int64())})
    found = pa.concat_tables(parts)
    if again:  # a text of several slices
        found = found.group_by(["doc", "term", "bit"]).aggregate([("tf", "sum")]).rename_columns(["doc", "term", "bit", "tf"]).sort_by("doc")
    return counts, found.combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    chunks = table.column(name).chunks
    return chunks[0] if chunks else pa.array([], table.schema.field(name).type)


def query_terms(items: DataFrame, text: str) -> DataFrame:
    """(item, term, bit) of the distinct terms of items, which carry ``ROW``."""

    def run(batches):
        for batch in batches:
            _, found = _words(batch.column(1), None)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(_column(found, "doc")), _column(found, "term"), _column(found, "bit")], names=["item", "term", "bit"])

    return items.select(ROW, text).mapInArrow(run, "item bigint, term string, bit bigint")


def bitmap(terms: DataFrame) -> np.ndarray:
    """The terms' bits, as words of 64: at most ``MARK_BITS`` / 64 rows come to the driver."""
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % 64).cast("int"))
    rows = terms.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(MARK_BITS // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def vectors(docs: DataFrame, text: str, marked: np.ndarray) -> DataFrame:
    """(ROW, n, terms, tfs) of documents, which carry ``ROW``: the number of all words, and the marked terms; written."""

    def run(batches):
        for batch in batches:
            n, found = _words(batch.column(1), marked)
            bounds = pa.array(np.searchsorted(_column(found, "doc").to_numpy(), np.arange(len(n) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, _column(found, c)) for c in ("term", "tf")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], names=[ROW, "n", "terms", "tfs"])

    return cut(docs.select(ROW, text).mapInArrow(run, f"{ROW} bigint, n bigint, terms array<string>, tfs array<bigint>"))


class Lists:
    """The postings of a shard: for each term, documents by falling impact."""

    def __init__(self, terms: pa.Array, owners: np.ndarray, tfs: np.ndarray, m: np.ndarray):
        spelled = terms.dictionary_encode()
        self.terms, codes = spelled.dictionary, spelled.indices.to_numpy()
        impact = (1_000_000_000 * tfs) // (1000 * tfs + 8 * m[owners])
        order = np.lexsort((-impact, codes))
        self.docs, self.impacts, self.n_docs = owners[order], impact[order], len(m)
        self.heads = np.searchsorted(codes[order], np.arange(len(self.terms) + 1))


def best_of(lists: Lists, codes: np.ndarray, weights: np.ndarray, k: int = BEST, depth: int = FIRST_DEPTH) -> tuple[np.ndarray, np.ndarray, int]:
    """The documents with the ``k`` highest scores above 0, equal scores by document, their scores, and the postings read."""
    starts, stops = lists.heads[codes], lists.heads[codes + 1]
    lower, met, at = np.zeros(lists.n_docs, np.int64), np.zeros(lists.n_docs, bool), starts.copy()

    def read(to: np.ndarray, only: np.ndarray | None) -> None:
        for t in np.flatnonzero(to > at):
            docs, gain = lists.docs[at[t] : to[t]], weights[t] * lists.impacts[at[t] : to[t]]
            if only is not None:
                mine = only[docs]
                docs, gain = docs[mine], gain[mine]
            lower[docs] += gain
            met[docs] = True
        at[:] = to

    def bounds(docs: np.ndarray) -> tuple[np.ndarray, int]:
        """The upper bounds of documents that were met, and that of any other."""
        known = np.zeros(lists.n_docs, np.int64)
        following = np.where(at < stops, weights * lists.impacts[np.minimum(at, len(lists.impacts) - 1)], 0)
        for t in np.flatnonzero(following):
            known[lists.docs[starts[t] : at[t]]] += following[t]
        rest = int(following.sum())
        return lower[docs] + rest - known[docs], rest

    while True:
        read(np.minimum(stops, starts + depth), None)
        docs = np.flatnonzero(met)
        upper, rest = bounds(docs)
        order = np.lexsort((docs, -lower[docs]))
        top, others = order[:k], order[k:]
        if not rest:
            break
        if len(top) == k and rest < (least := lower[docs[top[-1]]]):
            last = docs[top[-1]]
            if not ((upper[others] > least) | ((upper[others] == least) & (docs[others] < last))).any():
                break
        depth *= 2
    found = docs[top]
    only = np.zeros(lists.n_docs, bool)
    only[found] = True
    while (bounds(found)[0] > lower[found]).any():
        depth *= 2
        read(np.minimum(stops, starts + depth), only)
    found = found[lower[found] > 0]
    order = np.lexsort((found, -lower[found]))
    return found[order], lower[found][order], int((at - starts).sum())


def search(docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, id, score): the ``k`` documents of ``docs`` with the highest scores above 0 for each of ``items``.

    Terms, weights and impacts are those of the contract: a rare term weighs more, a short document's counts more. Each
    distinct term of an item counts once. Equal scores go by the smaller id. Null and empty texts hold no term: such
    items have no row, and such documents are in none and do not count. Rows with a null or repeated id are documents or
    items of their own; among repeated ids the order is that of :func:`common.keyed`. Columns of other names are
    ignored. Empty tables give none.
    """
    items, docs = keyed(items, item_col), keyed(docs, id_col)
    asked = cut(query_terms(items, item_text))
    found = vectors(docs, text, bitmap(asked))
    total = found.agg(F.count_if(F.col("n") > 0), F.sum("n"), F.sum(F.size("terms"))).first()
    n_docs, n_words, n_postings = (int(x or 0) for x in total)
    held = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("bigint")
    weighed = cut(asked.join(held, "term").select("item", "term", weight.alias("w")).where("w > 0"))
    shards, blocks = max(1, math.ceil(n_postings / SHARD_POSTINGS)), max(1, math.ceil(weighed.count() / BLOCK_TERMS))
    m = F.lit(10).cast("bigint") + F.expr(f"(90 * n * {n_docs}) div {max(1, n_words)}")
    spread = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held_by = found.where(F.size("terms") > 0).select(spread(ROW, shards).alias("shard"), every(blocks).alias("block"), ROW, m.alias("m"), "terms", "tfs")
    block = weighed.groupBy(spread("item", blocks).alias("block")).agg(F.collect_list(F.struct("item", "term", "w")).alias("asked"))
    asked_of = block.select(every(shards).alias("shard"), "block", "asked")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            left = left.sort_by(ROW).combine_chunks()
            terms, tfs = (left.column(c).combine_chunks() for c in ("terms", "tfs"))
            terms, tfs = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (terms, tfs))
            owners = np.repeat(np.arange(left.num_rows), np.diff(terms.offsets.to_numpy()))
            lists = Lists(terms.flatten(), owners, tfs.flatten().to_numpy(), left.column("m").to_numpy())
            rows = pc.list_flatten(right.column("asked").combine_chunks())
            item, term, w = (pc.struct_field(rows, i) for i in range(3))
            codes = pc.index_in(term, lists.terms)
            here = codes.is_valid().to_numpy(zero_copy_only=False)
            codes, item, w = codes.fill_null(0).to_numpy()[here], item.to_numpy()[here], w.to_numpy()[here]
            order = np.argsort(item, kind="stable")
            keys = left.column(ROW).to_numpy()
            for part in np.split(order, np.flatnonzero(np.diff(item[order])) + 1):
                if len(part):
                    docs, scores, _ = best_of(lists, codes[part].astype(np.int64), w[part], k)
                    out[0].append(np.full(len(docs), item[part[0]]))
                    out[1].append(keys[docs])
                    out[2].append(scores)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table({"item": flat[0], "row": flat[1], "score": flat[2]})

    keys = ("shard", "block")
    local = held_by.groupBy(*keys).cogroup(asked_of.groupBy(*keys)).applyInArrow(run, "item bigint, row bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "row"))
    best = cut(local.withColumn("rank", rank).where(F.col("rank") <= k))
    release(found, asked, weighed)
    named = best.join(items.select(F.col(ROW).alias("item"), F.col(item_col).alias("__item")), "item")
    return named.join(docs.select(F.col(ROW).alias("row"), F.col(id_col).alias("__id")), "row").select(F.col("__item").alias("item"), "rank", F.col("__id").alias("id"), "score")


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return search(docs, items).select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
SQL = f"""with docs as (select doc_id, {_TERMS} as ws from documents),
sums as (select count(*) filter (len(ws) > 0) as nd, sum(len(ws)) as nw from docs),
asked as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
held as (select doc_id, len(ws) as n, unnest(ws) as term from docs),
postings as (select doc_id, n, term, count(*) as tf from held where term in (select term from asked) group by all),
weights as (select term, cast(floor(1000 * ln((2.0::double * nd + 2) / (2 * count(*) + 1))) as bigint) as w from postings, sums group by term, nd),
scored as (
  select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nw)))) as bigint) as score
  from asked join weights using (term) join postings using (term), sums group by all),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from ranked where rank <= {BEST}"""


# Brute force, for tests.
def brute_force(docs: list[tuple], items: list[tuple], k: int = BEST) -> list[tuple]:
    """(item, rank, id, score) of every score, computed in whole and sorted."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    held = [(i, Counter(w), len(w)) for i, w in ((i, words(t)) for i, t in docs) if w]
    n_docs, n_words = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, tf, _ in held for t in tf)
    out = []
    for item, text in items:
        scores = []
        for i, tf, n in held:
            m = 10 + (90 * n * n_docs) // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in {*words(text)} if t in tf)
            if score > 0:
                scores.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out
