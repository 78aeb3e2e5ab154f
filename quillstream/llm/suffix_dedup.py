"""Suffix-array dedup: bytes of long strings that stand elsewhere too are removed.

``repeats`` brings the places that may be equal together in buckets, by an anchor that equal windows share. In a bucket the
suffixes that begin at the anchors are sorted, and so are the texts before the anchors, read backwards. Both sorts are
mergesorts whose comparisons take the longest common extension of two suffixes from prefix polynomial hashes by binary
search, so a comparison takes a logarithm of the window length. What neighbours in an order have in common, checked byte
by byte, is all that is needed: two suffixes agree over n bytes where all neighbours between them do. So for each place of
a window around its anchor the suffixes that agree far enough behind it are runs of one order, those that agree far
enough before it are runs of the other, and windows in the same two runs are equal.

What holds for a class's two sorted members holds for its others, whose stretches have the same 128-bit digest.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .common import ROW, PrefixHash, keyed, utf8_parts
from .repeats import by_document, merged, placed, search

LENGTH, GRAM = 200, 48


def byte_tokens(data: np.ndarray, starts: np.ndarray):
    """Every byte is a token."""
    at = np.arange(len(data) + 1)
    return data, starts, at[:-1], at[1:], data


def common_extension(hashes: PrefixHash, a: np.ndarray, b: np.ndarray, most: np.ndarray, forward: bool) -> np.ndarray:
    """How many elements from ``a`` and from ``b`` on (or before them, going back) agree, up to ``most``: a binary search
    over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_] + 1) >> 1
        x, y = (a[open_], b[open_]) if forward else (a[open_] - mid, b[open_] - mid)
        same = hashes.of(x, mid) == hashes.of(y, mid)
        low[open_] = np.where(same, mid, low[open_])
        high[open_] = np.where(same, high[open_], mid - 1)
    return low


def sort_suffixes(hashes: PrefixHash, values: np.ndarray, at: np.ndarray, room: np.ndarray, group: np.ndarray, forward: bool) -> np.ndarray:
    """The order of the suffixes at ``at``, of ``room`` elements, within groups: a stable bottom-up mergesort. Backwards, the
    elements before ``at``, read from there. A suffix goes before those that it is the beginning of.

    All merges of a round run at once: an element's place is its place in its run plus the number of elements of the
    sister run that go before it, found by binary search.
    """
    order = np.argsort(group, kind="stable")
    sizes = np.unique(group, return_counts=True)[1]
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    nth, size = np.arange(len(at)) - begin, np.repeat(sizes, sizes)
    width = 1
    while width < (sizes.max() if len(sizes) else 0):
        live = np.flatnonzero(size > width)
        b, p = begin[live], nth[live]
        run = p // width
        left = run % 2 == 0
        low = np.minimum((run + np.where(left, 1, -1)) * width, size[live])
        sister = low.copy()
        high = np.minimum(low + width, size[live])
        mine = order[live]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            x, y = mine[open_], order[b[open_] + mid]
            most = np.minimum(room[x], room[y])
            k = common_extension(hashes, at[x], at[y], most, forward)
            inner = np.minimum(k, np.maximum(most - 1, 0))  # in bounds where a suffix ends; not looked at there
            one, two = (at[x] + inner, at[y] + inner) if forward else (at[x] - 1 - inner, at[y] - 1 - inner)
            last = len(values) - 1
            less = values[np.clip(two, 0, last)] < values[np.clip(one, 0, last)]
            shorter = (room[y] < room[x]) | ((room[y] == room[x]) & ~left[open_])  # on ties the left run goes first
            before = np.where(k < most, less, shorter)
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        to = b + (run - (run % 2)) * width + (p - run * width) + (low - sister)
        new = order.copy()
        new[to] = order[live]
        order = new
        width *= 2
    return order


def neighbours(hashes: PrefixHash, values: np.ndarray, raw: bytes, at: np.ndarray, room: np.ndarray, group: np.ndarray, forward: bool) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes, and what each but the last has in common with the next one: -1 at the end of a group. An
    extension that a collision of hashes made too long is cut to what the bytes say."""
    order = sort_suffixes(hashes, values, at, room, group, forward)
    a, b = order[:-1], order[1:]
    found = common_extension(hashes, at[a], at[b], np.minimum(room[a], room[b]), forward)
    found[group[a] != group[b]] = -1
    starts = (at[a], at[b]) if forward else (at[a] - found, at[b] - found)
    for i, x, y, n in zip(range(len(found)), starts[0].tolist(), starts[1].tolist(), found.tolist(), strict=True):
        if n > 0 and raw[x : x + n] != raw[y : y + n]:
            one, two = (raw[x : x + n], raw[y : y + n]) if forward else (raw[x : x + n][::-1], raw[y : y + n][::-1])
            found[i] = next(k for k in range(n) if one[k] != two[k])
    return order, found


def runs_of(order: np.ndarray, extensions: np.ndarray, least: int) -> np.ndarray:
    """For each suffix the run of the order in which all neighbours have ``least`` elements or more in common."""
    run = np.empty(len(order), np.int64)
    run[order] = np.concatenate([[0], np.cumsum(extensions < least)])
    return run


def twins(bucket: np.ndarray, offset: np.ndarray, place: np.ndarray, values: np.ndarray, begin: np.ndarray, end: np.ndarray, raw: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows have an equal one at the same offset in their bucket.

    Windows that follow each other around one anchor are a stretch; its suffix goes from the anchor to the end of its last
    window, and back from the anchor to the start of its first.
    """
    found = np.zeros(len(place), bool)
    if not len(place):
        return found
    head = np.flatnonzero(np.concatenate([[True], np.diff(place) != 1]))
    count = np.diff(np.append(head, len(place)))
    group, anchor = bucket[head], (place - offset)[head]
    back = anchor - place[head]
    ahead = length + count - 1 - back
    hashes, whole = PrefixHash(values), raw.tobytes()
    behind = neighbours(hashes, values, whole, anchor, ahead, group, True)
    before = neighbours(hashes, values, whole, anchor, back, group, False)
    least = back - count + 1
    for o in range(int(least.min()), int(back.max()) + 1):
        live = np.flatnonzero((least <= o) & (o <= back))
        key = runs_of(*behind, length - o)[live] * len(head) + runs_of(*before, o)[live]
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        same = live[times[which] > 1]
        found[head[same] + back[same] - o] = True
    return found


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``spans`` (the maximal removed runs of bytes) and ``kept`` (the remaining bytes).

    Texts are UTF-8 bytes; null and empty ones have none, and texts shorter than the window lose none. A window counts
    as repeated if it also starts elsewhere, in the same document or another, overlaps included; so all copies of a
    repeated row lose what they share. ``kept`` is binary: a cut may part the bytes of a character. Rows with a null or
    repeated id are documents of their own; an empty table gives an empty one. Memory is some 90 bytes for each byte of the longest text, which its task holds whole.
    Columns of ``docs`` with these names are replaced.
    """
    docs = keyed(docs.drop("n_bytes", "spans", "kept"), id_col)
    members, _, runs = search(docs, text, byte_tokens, LENGTH, GRAM, twins, seconds=True)
    spans = by_document(placed(members, runs))
    joined = docs.join(spans.hint("shuffle_hash"), ROW, "left").drop(ROW)
    run_type = ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())]))
    schema = StructType([*joined.drop("spans").schema.fields, StructField("n_bytes", IntegerType()), StructField("__spans", run_type), StructField("kept", BinaryType())])
    names = joined.columns

    def run(batches):
        for batch in batches:
            data, starts = utf8_parts(batch.column(names.index(text)))
            raw, lists = data.tobytes(), batch.column(names.index("spans"))
            kept, runs = [], []
            for k in range(batch.num_rows):
                own, found = raw[starts[k] : starts[k + 1]], lists[k]
                if not found.is_valid:
                    kept.append(own)
                    runs.append([])
                    continue
                s = found.values
                opens, closes = merged(s.field("start").to_numpy(), s.field("stop").to_numpy(), len(own))
                cuts = [0, *np.column_stack([opens, closes]).ravel().tolist(), len(own)]
                kept.append(b"".join(own[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
                runs.append([{"start": int(a), "stop": int(b)} for a, b in zip(opens, closes, strict=True)])
            rest = [batch.column(i) for i, n in enumerate(names) if n != "spans"]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(np.diff(starts).astype(np.int32)), pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(kept, pa.binary())], names=[*(n for n in names if n != "spans"), "n_bytes", "__spans", "kept"]
            )

    return joined.mapInArrow(run, schema).withColumnRenamed("__spans", "spans")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("n_bytes").cast("bigint").alias("n_bytes"),
        (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def brute_force(docs: list[tuple], length: int = LENGTH) -> list[tuple]:
    """For tests."""
    texts = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(hash(t[s : s + length]) for _, t in texts for s in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        starts = np.array([s for s in range(len(t) - length + 1) if seen[hash(t[s : s + length])] > 1], np.int64)
        opens, closes = merged(starts, starts + length, len(t))
        cuts = [0, *np.column_stack([opens, closes]).ravel().tolist(), len(t)]
        kept = b"".join(t[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
        out.append((i, len(t), len(t) - len(kept), len(opens), hashlib.sha256(kept).hexdigest()))
    return out
