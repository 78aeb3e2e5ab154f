"""What byte-level and word-level dedup share: the distributed search for places where a long window stands twice.

A window is ``length`` tokens (bytes or words). Of the short grams in a window the one with the smallest hash, the
leftmost on ties, is its anchor; it depends on the window's own tokens alone, so equal windows have equal anchors at
equal offsets. Consecutive windows with one anchor form a stretch. So comparing stretches that share an anchor's hash
compares all windows that may be equal, with one row for about (length - gram) / 2 tokens.

1. ``stretches``: hash of the anchor, 128-bit digest of the stretch's tokens, row, first and last window start, anchor
   position. Anchors that stand once go (a count, combined before the shuffle, then a join that splits hot anchors).
2. Stretches of one digest are a class. Of each class one member, and on demand a second one, sends its tokens to the
   anchor's bucket; there a method of the operator finds the windows that two stretches share and compares their tokens.
3. An anchor of more than ``HOT`` stretches, a common passage in many surroundings, has no bucket. Its windows are dealt
   out by their text: first ``STEP`` neighbouring windows at once, and where only a part of these agrees, window by
   window; counts of digests are combined before the shuffle, so no task grows with the anchor.
4. Classes' repeated runs are joined to their members, and members to their documents.

Every shuffle but those of pieces and documents moves hashes; tables between steps are written (see ``cut``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import row_slices
from .common import ROW, cut, digests, gram_hashes, release, utf8_parts

SLICE, HOT, STEP = 2_000_000, 1024, 8
_LOW32 = np.uint64(0xFFFFFFFF)

#: (data, text starts) -> (token values, first token of each text, first byte of each token, byte after each token, the
#: bytes in which these places are: equal stretches of tokens are equal bytes there)
Tokens = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive keys, by doubling."""
    have, span = keys, 1
    while span * 2 <= width:
        have, span = np.minimum(have[: len(have) - span], have[span:]), span * 2
    return np.minimum(have[: len(keys) - width + 1], have[width - span :]) if width > span else have


def stretches_of(values: np.ndarray, first: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(h1, text, lo, hi, at) of every stretch; positions count over all tokens."""
    n, width = len(values), length - gram + 1
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    grams = gram_hashes(values, gram)
    # a hash's upper half orders grams; on ties the left one wins, wherever the text stands
    anchor = (window_minima((grams & ~_LOW32) | np.arange(len(grams), dtype=np.uint64), width) & _LOW32).astype(np.int64)
    sizes = np.diff(first)
    valid = np.zeros(n + 1, np.int32)
    long = sizes >= length
    np.add.at(valid, first[:-1][long], 1)
    np.add.at(valid, first[1:][long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[: len(anchor)]) > 0)
    at = anchor[starts]
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])) if len(at) else np.zeros(0, np.int64)
    lo, hi, at = starts[head], starts[np.append(head[1:], len(starts)) - 1] if len(head) else head, at[head]
    return grams[at], np.searchsorted(first, lo, "right") - 1, lo, hi, at


def stretches(docs: DataFrame, text: str, tokens: Tokens, length: int, gram: int, anchors_only: bool = False) -> DataFrame:
    def run(batches):
        for whole in batches:
            data, starts = utf8_parts(whole.column(1))
            for a, b in row_slices(starts, SLICE):
                values, first, begin, end, raw = tokens(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                h1, owner, lo, hi, at = stretches_of(values, first, length, gram)
                columns = [pa.array(h1.view(np.int64))]
                if not anchors_only:
                    d1, d2 = digests(raw.tobytes(), begin[lo], end[hi + length - 1])
                    columns += [d1, d2, whole.column(0).slice(a, b - a).take(pa.array(owner)), *(pa.array((x - first[owner]).astype(np.int32)) for x in (lo, hi, at))]
                yield pa.RecordBatch.from_arrays(columns, names=["h1", "d1", "d2", ROW, "lo", "hi", "at"][: len(columns)])

    kinds = f"h1 bigint, d1 bigint, d2 bigint, {ROW} bigint, lo int, hi int, at int"
    return docs.select(ROW, text).mapInArrow(run, "h1 bigint" if anchors_only else kinds)


PIECE = "h1 bigint, d1 bigint, d2 bigint, k bigint, second boolean, at int, n int, piece binary"


def contexts(docs: DataFrame, members: DataFrame, text: str, tokens: Tokens, length: int) -> DataFrame:
    """``PIECE`` for each stretch in ``members``: ``at`` is the anchor's offset, ``n`` the number of its windows, and
    ``piece`` has the bytes from its first to its last token."""
    by_doc = members.groupBy(ROW).agg(F.collect_list(F.struct("h1", "d1", "d2", "k", "second", "lo", "hi", "at")).alias("wanted"))

    def run(batches):
        for whole in batches:
            data, starts = utf8_parts(whole.column(0))
            wanted = whole.column(1)
            owner = np.repeat(np.arange(whole.num_rows), np.diff(wanted.offsets.to_numpy()))
            fields = {n: wanted.flatten().field(n) for n in ("h1", "d1", "d2", "k", "second", "lo", "hi", "at")}
            for a, b in row_slices(starts, SLICE):
                _, first, begin, end, raw = tokens(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                raw = raw.tobytes()
                x, y = np.searchsorted(owner, [a, b])
                own = {n: f.slice(x, y - x) for n, f in fields.items()}
                lo, hi, at = (own[n].to_numpy().astype(np.int64) for n in ("lo", "hi", "at"))
                base = first[owner[x:y] - a]
                pieces = [raw[s:e] for s, e in zip(begin[base + lo].tolist(), end[base + hi + length - 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [own["h1"], own["d1"], own["d2"], own["k"], own["second"], pa.array((at - lo).astype(np.int32)), pa.array((hi - lo + 1).astype(np.int32)), pa.array(pieces, pa.binary())],
                    names=["h1", "d1", "d2", "k", "second", "at", "n", "piece"],
                )

    joined = docs.select(ROW, text).join(by_doc.hint("shuffle_hash"), ROW)
    return joined.select(text, "wanted").mapInArrow(run, PIECE)


RUNS = "d1 bigint, d2 bigint, runs array<struct<start: int, stop: int>>"
Shared = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def shared_windows(pieces: DataFrame, tokens: Tokens, length: int, method: Shared) -> DataFrame:
    """(d1, d2, runs): the runs of windows, as [start, stop) from the stretch's first, that another piece of the anchor
    has too. Rows of one anchor, ``HOT`` at most, meet in one task, in order; a task holds one slice of them at a time.

    ``method(bucket, offset, place, values, begin, end, raw)`` says which windows have a twin in their bucket.
    """

    def run(batches):
        rest = None
        for batch in (*batches, None):
            have = [x for x in (rest, batch) if x is not None and x.num_rows]
            if not have:
                continue
            table = pa.Table.from_batches(have).combine_chunks().to_batches()[0]
            if batch is not None:  # rows of the last anchor wait for more
                h1 = table.column(0).to_numpy()
                last = len(h1) - int(np.argmax((h1 != h1[-1])[::-1])) if (h1 != h1[-1]).any() else 0
                table, rest = table.slice(0, last), table.slice(last)
            if not table.num_rows:
                continue
            h1, n, second = table.column(0).to_numpy(), table.column(6).to_numpy().astype(np.int64), table.column(4).to_numpy(zero_copy_only=False)
            data, starts = utf8_parts(table.column(7))
            edges = np.append(np.flatnonzero(np.concatenate([[True], h1[1:] != h1[:-1]])), len(h1))
            for ea, eb in row_slices(starts[edges], SLICE):
                a, b = edges[ea], edges[eb]
                values, first, begin, end, raw = tokens(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                counts = n[a:b]
                owner = np.repeat(np.arange(b - a), counts)
                nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                offset = nth - table.column(5).to_numpy()[a:b].astype(np.int64)[owner]
                bucket = np.cumsum(np.concatenate([[0], h1[a + 1 : b] != h1[a : b - 1]]))[owner]
                hit = method(bucket, offset, first[owner] + nth, values, begin, end, raw) & ~second[a:b][owner]  # a second member speaks for the first
                flags = np.concatenate([[False], hit, [False]])
                edge = np.concatenate([[True], owner[1:] != owner[:-1], [True]])
                opens = np.flatnonzero(flags[1:-1] & (~flags[:-2] | edge[:-1]))
                closes = np.flatnonzero(flags[1:-1] & (~flags[2:] | edge[1:]))
                if not len(opens):
                    continue
                who = owner[opens]
                heads = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
                runs = pa.StructArray.from_arrays([pa.array(nth[opens].astype(np.int32)), pa.array((nth[closes] + length).astype(np.int32))], names=["start", "stop"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(who)), pa.int32()), runs)
                keep = pa.array(who[heads] + a)
                yield pa.RecordBatch.from_arrays([table.column(1).take(keep), table.column(2).take(keep), lists], names=["d1", "d2", "runs"])

    dealt = pieces.repartition("h1").sortWithinPartitions("h1")
    return dealt.mapInArrow(run, RUNS)


def window_digests(pieces: DataFrame, tokens: Tokens, length: int, step: int) -> DataFrame:
    """(c1, c2, u1, u2, d1, d2, second, i, m, o): a row for each group ``o`` of each piece: its windows, ``m`` from ``i``
    on, in which the anchor's offset divided by ``step`` is ``o``.

    Digests: c of the tokens that all windows of a full group share, wherever the piece has just some of them, and u of
    the tokens that the piece's windows cover. Where ``pieces`` has ``wanted``, groups of ``STEP``, only these are taken.
    """
    chosen = "wanted" in pieces.columns

    def run(batches):
        for whole in batches:
            data, starts = utf8_parts(whole.column(4))
            for a, b in row_slices(starts, SLICE):
                _, first, begin, end, raw = tokens(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                at, n = (whole.column(k).slice(a, b - a).to_numpy().astype(np.int64) for k in (2, 3))
                low, high = (at - n + 1) // step, at // step
                owner = np.repeat(np.arange(b - a), high - low + 1)
                o = np.arange(len(owner)) - np.repeat(np.cumsum(high - low + 1) - (high + 1), high - low + 1)
                if chosen:
                    wanted = whole.column(6).slice(a, b - a)
                    pairs = np.repeat(np.arange(b - a), np.diff(wanted.offsets.to_numpy())) * length + wanted.flatten().to_numpy()
                    keep = np.isin(owner * length + o * step // STEP, pairs)
                    owner, o = owner[keep], o[keep]
                base, at, n, raw = first[owner], at[owner], n[owner], raw.tobytes()
                i, last = np.maximum(at - step * o - step + 1, 0), np.minimum(at - step * o, n - 1)
                core = base + at - step * o
                c1, c2 = digests(raw, begin[core], end[core + length - step])
                u1, u2 = (c1, c2) if step == 1 else digests(raw, begin[base + i], end[base + last + length - 1])
                take = pa.array(owner + a)
                yield pa.RecordBatch.from_arrays(
                    [c1, c2, u1, u2, *(whole.column(k).take(take) for k in (0, 1, 5)), *(pa.array(x.astype(np.int32)) for x in (i, last - i + 1, o))],
                    names=["c1", "c2", "u1", "u2", "d1", "d2", "second", "i", "m", "o"],
                )

    columns = ["d1", "d2", "at", "n", "piece", "second"] + ["wanted"] * chosen
    return pieces.select(*columns).mapInArrow(run, "c1 bigint, c2 bigint, u1 bigint, u2 bigint, d1 bigint, d2 bigint, second boolean, i int, m int, o int")


def dealt_by_text(pieces: DataFrame, tokens: Tokens, length: int) -> DataFrame:
    """What :func:`shared_windows` gives, for pieces of hot anchors, by counts of digests.

    A group of windows whose whole text stands twice is repeated at once. Of groups with the same core and different
    texts, one piece for each text has its windows counted; so copies, however many, are one row there.
    """
    groups = cut(window_digests(pieces, tokens, length, STEP))
    core, text = ["c1", "c2"], ["u1", "u2"]
    texts = cut(groups.groupBy(*core, *text).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("d1", "d2", "second", "o")).alias("one")))
    whole = groups.where("not second").join(texts.where("copies > 1").select(*core, *text), [*core, *text]).select("d1", "d2", "i", "m")
    mixed = texts.groupBy(*core).agg(F.count(F.lit(1)).alias("k"), F.min("copies").alias("least")).where("k > 1 and least = 1").select(*core)
    near = texts.join(mixed, core).groupBy("one.d1", "one.d2", "one.second").agg(F.collect_set("one.o").alias("wanted"))
    windows = cut(window_digests(pieces.join(cut(near), ["d1", "d2", "second"]), tokens, length, 1))
    twice = windows.groupBy(*core).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select(*core)
    single = windows.where("not second").join(twice, core).select("d1", "d2", "i", "m")
    runs = F.collect_list(F.struct(F.col("i").alias("start"), (F.col("i") + F.col("m") - 1 + length).cast("int").alias("stop")))
    return whole.unionByName(single).groupBy("d1", "d2").agg(runs.alias("runs"))


def search(docs: DataFrame, text: str, tokens: Tokens, length: int, gram: int, method: Shared, seconds: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, runs): stretches whose anchor stands twice; their classes with ``n`` members and the
    coordinates of ``one``; and for classes the runs of windows that stand elsewhere too.

    With ``seconds`` a class of two or more sends two members to its bucket, so the method decides on its runs too;
    without, it sends one, and the runs are only those that another class has.
    """
    anchors = stretches(docs, text, tokens, length, gram, True).groupBy("h1").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("h1")
    members = cut(stretches(docs, text, tokens, length, gram).join(cut(anchors), "h1"))
    place = F.struct(ROW, "lo", "hi", "at")
    classes = cut(members.groupBy("d1", "d2").agg(F.first("h1").alias("h1"), F.count(F.lit(1)).alias("n"), F.min(place).alias("one"), F.max(place).alias("other")))
    pair = (F.col("n") > 1) & F.lit(seconds)
    several = cut(classes.groupBy("h1").agg(F.sum(F.when(pair, 2).otherwise(1)).alias("k")).where("k > 1"))
    member = lambda c, second: F.struct(F.col(c).alias("m"), F.lit(second).alias("second"))
    picked = classes.join(several, "h1").select(
        "h1", "d1", "d2", "k", F.inline(F.when(pair, F.array(member("one", False), member("other", True))).otherwise(F.array(member("one", False)))),
    )
    picked = picked.select("h1", "d1", "d2", "k", "second", "m.*")
    pieces = cut(contexts(docs, picked, text, tokens, length))
    runs = shared_windows(pieces.where(F.col("k") <= HOT), tokens, length, method)
    found = cut(runs.unionByName(dealt_by_text(pieces.where(F.col("k") > HOT), tokens, length)))
    release(pieces, several)
    return members, classes, found


def placed(members: DataFrame, runs: DataFrame) -> DataFrame:
    """(ROW, s): the runs of each class at the places of its members."""
    shifted = F.transform("runs", lambda r: F.struct((r.start + F.col("lo")).alias("start"), (r.stop + F.col("lo")).alias("stop")))
    return members.join(runs, ["d1", "d2"]).select(ROW, shifted.alias("s"))


def by_document(spans: DataFrame) -> DataFrame:
    """(ROW, spans): a document's spans together; there are at most as many as it has stretches."""
    return spans.groupBy(ROW).agg(F.flatten(F.collect_list("s")).alias("spans"))


def merged(starts: np.ndarray, stops: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that spans cover, of ``size`` places."""
    depth = np.zeros(size + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, stops, -1)
    covered = np.concatenate([[False], np.cumsum(depth[:size]) > 0, [False]])
    return np.flatnonzero(covered[1:] & ~covered[:-1]), np.flatnonzero(covered[:-1] & ~covered[1:])
