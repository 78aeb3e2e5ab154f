r"""Benchmark decontamination over a distributed positional inverted index.

The index is sharded by document and stored: each row holds the postings of a slice of documents: the sorted terms, and
for each term the sorted positions at which it stands. The test windows go to every shard in blocks of bounded size.
A shard starts each window with its own rarest term, shifts that term's positions by its place in the window, and
intersects with the shifted lists of the other terms, rarest first, until none or all are met. A term is a 64-bit hash
of its word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import row_slices
from .common import ROW, PrefixHash, cut, keyed, packed, ranges, release, utf8_parts, word_bounds

WINDOW = 13
#: Words of test items that go to the shards at once.
BLOCK_WORDS = 200_000
#: Candidates that a shard holds at once.
BLOCK_CANDIDATES = 1_000_000
SLICE_BYTES = 2_000_000
#: Slices that a task holds at once when it writes or reads the index, however many its file has.
GROUP_ROWS = 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True

INDEX = "rows array<bigint>, ids array<string>, word_starts array<bigint>, terms array<bigint>, term_starts array<bigint>, positions array<int>"


def terms_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of texts that lie back to back, and which word is each text's first."""
    low = _LOWER[data]
    begins, ends, first = word_bounds(_IN_WORD[low], starts)
    return PrefixHash(low).of(begins, ends - begins), first


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index of ``docs``, which carry ``ROW``: a row for each slice of about 2 MB of text."""

    def run(batches):
        for whole in batches:
            data, starts = utf8_parts(whole.column(2))
            for a, b in row_slices(starts, SLICE_BYTES):
                terms, word_starts = terms_of(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                order = np.argsort(terms, kind="stable")
                ordered = terms[order]
                heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
                one = lambda x, kind: pa.ListArray.from_arrays([0, len(x)], pa.array(x, kind))
                yield pa.RecordBatch.from_arrays(
                    [
                        one(whole.column(0).slice(a, b - a), pa.int64()),
                        one(whole.column(1).slice(a, b - a), pa.string()),
                        one(word_starts, pa.int64()),
                        one(ordered[heads].view(np.int64), pa.int64()),
                        one(np.append(heads, len(ordered)), pa.int64()),
                        one(order.astype(np.int32), pa.int32()),
                    ],
                    names=["rows", "ids", "word_starts", "terms", "term_starts", "positions"],
                )

    return cut(docs.select(ROW, F.col(id_col).cast("string").alias("id"), text).mapInArrow(run, INDEX), GROUP_ROWS)


class Windows:
    """Test windows as arrays: for window w its item, and its terms ``terms[starts[w]:starts[w + 1]]``."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        spread, lengths, self.items, owners = [], [], [i for i, _ in items], []
        for k, (_, text) in enumerate(items):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            terms, _ = terms_of(raw, np.array([0, len(raw)]))
            n = min(len(terms), size)
            if n:
                count = len(terms) - n + 1
                spread.append(np.lib.stride_tricks.sliding_window_view(terms, n).ravel())
                lengths.append(np.full(count, n))
                owners.append(np.full(count, k))
        none = np.zeros(0, np.int64)
        self.terms = np.concatenate(spread) if spread else np.zeros(0, np.uint64)
        self.lengths = np.concatenate(lengths) if lengths else none
        self.owners = np.concatenate(owners) if owners else none
        self.starts = np.cumsum(self.lengths) - self.lengths


def blocks_of(benchmark: DataFrame, item_col: str, text: str, size: int, most: int = BLOCK_WORDS) -> Iterator[Windows]:
    """The items in blocks of about ``most`` words, one collected at a time.

    A longer item is dealt out in parts of half as many words, each with the ``size`` - 1 words before it, so the parts
    have the item's windows, each once.
    """
    part = max(size, most // 2)
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("[0-9A-Za-z\\x80-\\x{10FFFF}]+"), F.lit(0))
    item = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)), F.lit(part))
    parts = cut(item.select("i", F.explode(starts).alias("s"), "w").select("i", "s", F.array_join(F.slice("w", F.col("s") + 1, part + size - 1), " ").alias("t")))
    total = parts.agg(F.sum(F.size(F.split("t", " ")))).first()[0] or 0
    n = max(1, -(-int(total) // part))
    for k in range(n):
        block = parts if n == 1 else parts.where(F.pmod(F.xxhash64("i", "s", "t"), F.lit(n)) == k)
        yield Windows([(r.i, r.t) for r in block.collect()], size)


def search_shard(shard: dict, q: Windows, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, word at which it begins) of every match in a shard: each term within ``slop`` words of its place."""
    terms, heads, positions, word_starts = shard["terms"], shard["term_starts"], shard["positions"], shard["word_starts"]
    if not len(terms) or not len(q.terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.minimum(np.searchsorted(terms, q.terms), len(terms) - 1)
    size = np.where(terms[rank] == q.terms, heads[rank + 1] - heads[rank], 0)
    n_words = len(positions)
    listed = np.repeat(np.arange(len(terms), dtype=np.int64), np.diff(heads)) * (n_words + 1) + positions  # sorted: term, then position
    n_terms, window = len(q.terms), np.repeat(np.arange(len(q.lengths)), q.lengths)
    order = np.lexsort((size, window))  # each window's terms, rarest first
    live = size[order[q.starts]] > 0
    found = [], []
    chosen = np.flatnonzero(live)
    loads = np.cumsum(size[order[q.starts[chosen]]])
    for part in np.split(chosen, np.searchsorted(loads, np.arange(BLOCK_CANDIDATES, (loads[-1] if len(loads) else 0), BLOCK_CANDIDATES))):
        if not len(part):
            continue
        rarest = order[q.starts[part]]
        w = np.repeat(part, size[rarest])
        at = positions[ranges(heads[rank[rarest]], size[rarest])].astype(np.int64) - np.repeat(rarest - q.starts[part], size[rarest])
        inside = (at >= 0) & (at + q.lengths[w] <= n_words)
        w, at = w[inside], at[inside]
        doc = np.searchsorted(word_starts, at, "right")
        whole = at + q.lengths[w] <= word_starts[np.minimum(doc, len(word_starts) - 1)]
        w, at = w[whole], at[whole]
        for k in range(1, int(q.lengths.max())):
            more = q.lengths[w] > k
            term = order[np.minimum(q.starts[w] + k, n_terms - 1)]
            place = at + (term - q.starts[w])
            base = rank[term] * (n_words + 1)
            i = np.searchsorted(listed, base + np.maximum(place - slop, 0))
            near = (i < len(listed)) & (size[term] > 0)
            near[near] = listed[i[near]] <= (base + place + slop)[near]
            near[near] &= listed[i[near]] < (base + n_words + 1)[near]
            ok = near | ~more
            w, at = w[ok], at[ok]
            if not len(w):
                break
        found[0].append(w)
        found[1].append(at)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(found[0] or none), np.concatenate(found[1] or none)


MATCHES = "row bigint, item string, start bigint, stop bigint"


def find(index: DataFrame, blocks: Iterable[Windows], slop: int = 0) -> DataFrame:
    """(row, item, start, stop): runs of words of a document that windows of an item cover, starts counted in words.

    ``slop`` 0 gives exact phrases; more gives proximity matches, where each term is within ``slop`` words of its place.
    """
    spark, out = index.sparkSession, None
    for q in blocks:
        sent = spark.sparkContext.broadcast(q)  # at most BLOCK_WORDS * WINDOW terms

        def run(batches, sent=sent):
            q = sent.value
            for batch in batches:
                for k in range(batch.num_rows):
                    shard = {n: batch.column(i)[k].values.to_numpy() for i, n in enumerate(("rows", "word_starts", "terms", "term_starts", "positions"))}
                    shard["terms"] = shard["terms"].view(np.uint64)
                    w, at = search_shard(shard, q, slop)
                    if not len(w):
                        continue
                    doc, item = np.searchsorted(shard["word_starts"], at, "right") - 1, q.owners[w]
                    order = np.lexsort((at, item, doc))
                    doc, item, at, stop = doc[order], item[order], at[order], (at + q.lengths[w])[order]
                    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] > stop[:-1])])
                    head = np.flatnonzero(new)
                    tail = np.append(head[1:], len(at)) - 1  # windows of one item have one length, so the last ends last
                    base = shard["word_starts"][doc[head]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard["rows"][doc[head]]), pa.array([q.items[i] for i in item[head]], pa.string()), pa.array(at[head] - base), pa.array(stop[tail] - base)], names=["row", "item", "start", "stop"]
                    )

        part = index.select("rows", "word_starts", "terms", "term_starts", "positions").mapInArrow(run, MATCHES)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """(ROW, id, n_words, n_hit, items, contaminated) for every row of ``docs``.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. A word
    inside any occurrence of a window is hit; a document is contaminated if hit words are a twentieth of its words or
    more. ``items`` are the ids of the items found, as strings, sorted as strings.

    Null and empty texts have no words. Items without words match nothing; repeated items count once by their id; a
    null item id is the empty string. Rows with a null or repeated id are documents of their own. An empty table gives an
    empty one, and without test items nothing is hit. Other columns of ``docs`` are not read, whatever their names.
    """
    return _judged(build_index(keyed(docs, id_col), id_col, text), blocks_of(benchmark, item_col, item_text, window))


def _judged(index: DataFrame, blocks: Iterable[Windows]) -> DataFrame:
    runs = find(index, blocks).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("runs"), F.sort_array(F.collect_set("item")).alias("items"))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    step = lambda a, r: F.struct((a.n + F.greatest(r.stop - F.greatest(r.start, a.end), F.lit(0))).alias("n"), F.greatest(a.end, r.stop).alias("end"))
    hit = runs.select("row", "items", F.aggregate("runs", zero, step).n.alias("n_hit"))
    own = index.select(F.posexplode(F.arrays_zip("rows", "ids")).alias("k", "d"), "word_starts").select(
        F.col("d.rows").alias("row"), F.col("d.ids").alias("id"), (F.get("word_starts", F.col("k") + 1) - F.get("word_starts", F.col("k"))).alias("n_words")
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return own.join(hit, "row", "left").select(
        F.col("row").alias(ROW),
        "id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def proximity_matches(
    docs: DataFrame, benchmark: DataFrame, slop: int = 3, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id",
    item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """(row, item, start, stop) of windows whose terms all stand within ``slop`` words of their places.

    Null and empty texts and items match nothing; rows with a null or repeated id are documents of their own, told apart
    by ``row``. Empty tables give none.
    """
    return find(build_index(keyed(docs, id_col), id_col, text), blocks_of(benchmark, item_col, item_text, window), slop)


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        F.col("id").cast("bigint").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go. Spark broadcasts their row keys only if they are few.

    Rows with a null or repeated id are documents of their own; texts without words stay, and without test items all do; an
    empty table stays one. Memory is some 90 bytes for each byte of the longest text, which its task holds whole.
    """
    docs_k = keyed(packed(docs, "doc_id", "text"))
    index = build_index(docs_k)
    bad = cut(_judged(index, blocks_of(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text", WINDOW)).where("contaminated").select(ROW))
    release(index)
    return docs_k.join(bad, ROW, "left_anti").select("__doc.*")


# Brute force, for tests.
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    wanted: dict[tuple, set] = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            wanted.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in wanted}:
            for i in range(len(w) - n + 1):
                if x := wanted.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= x
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
SQL = f"""with docs as (select doc_id, {_TERMS} as ws from documents),
items as (select coalesce(cast(item_id as varchar), '') as item, ws, least(len(ws), {WINDOW}) as n from (select item_id, {_TERMS} as ws from benchmark)),
wanted as (select distinct item, n, array_to_string(ws[i : i + n - 1], ' ') as k from (select *, unnest(range(1, len(ws) - n + 2)) as i from items where n > 0)),
met as (
  select doc_id, i, n, item from (
    select doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') as k
    from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from docs cross join (select distinct n from wanted)))
  join wanted using (n, k)),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from met) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from met) group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from docs left join hits using (doc_id) left join found using (doc_id)"""
