"""BPE encoding and decoding with content-defined chunk reuse.

1. A rolling hash over the last ``WINDOW`` bytes of a text picks cut points, each moved on to the next ASCII white space
   of the same text. They depend on the text alone, so equal passages of different documents give equal chunks.
2. Chunks travel as 128-bit digests. One that stands twice or more in the corpus, from ``SHARED_BYTES`` on, has an owner:
   its first place. The owner's text is encoded there once; the ids, packed, are joined to all places of the chunk.
3. Each text is then put together: shared chunks from their ids, all other chunks by encoding their words.
4. The joins are repaired: the words on both sides of a join are encoded together, and more of them, until that agrees
   with what the chunks gave; where it doesn't, the joint encoding takes their place.

A worker remembers words and pre-tokens that it has encoded, up to ``MAX_WORDS`` and ``MAX_PARTS``, and starts afresh
when they are full; results don't depend on it.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import ROW, cut, digests, keyed, marked, marks, ranges, utf8_parts

WINDOW, MASK = 8, np.uint32(2**11 - 1)
MAX_WORDS, MAX_PARTS, SLICE_BYTES, SHARED_BYTES = 200_000, 250_000, 1_000_000, 128
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Words of these characters are in composed form, and lower-casing keeps their length; the pre-tokens of such a word
#: are found by the tokenizer's own pattern, narrowed to them.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
_PARTS = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\na-z0-9ß-öø-ÿ]+").findall
_BASE = np.uint32(0x9E3779B1)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut_points(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where chunks begin in ``data``: at every text's start, and at the white space that follows a hash hit in it."""
    n = len(data)
    if n <= WINDOW:
        return np.unique(starts[:-1])
    h = np.zeros(n - WINDOW + 1, np.uint32)
    for i in range(WINDOW):  # vector steps; in the end h[j] covers bytes j to j + WINDOW - 1
        h *= _BASE
        h += data[i : n - WINDOW + 1 + i]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    hits = np.flatnonzero((h >> np.uint32(16)) & MASK == 0) + WINDOW
    spaces = np.flatnonzero(_SPACE[data])
    at = np.searchsorted(spaces, hits)
    hits, cuts = hits[at < len(spaces)], spaces[at[at < len(spaces)]]
    same = np.searchsorted(starts, hits - WINDOW, "right") == np.searchsorted(starts, cuts, "right")  # no cut sees another text
    return np.unique(np.concatenate([starts[:-1], cuts[same]]))


class Numbers(dict):
    """Numbers its keys in the order in which they are first looked up; ``new`` are those since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n

    def of(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))


class Encoder:
    """Encodes texts as ``tokenizer.encode(text, add_special_tokens=False)`` does, for tokenizers whose pre-tokens
    never span ASCII white space; joins are checked all the same."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.most_words, self.most_parts = MAX_WORDS, MAX_PARTS
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ends = None  # which ids end a pre-token, for tokenizers that mark it
        if (suffix := getattr(self.tokenizer.model, "end_of_word_suffix", None)) == "</w>":
            size = self.tokenizer.get_vocab_size()
            self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(size)])
        self.forget_parts()
        self.reset()

    def forget_parts(self) -> None:
        self.parts = Numbers()
        self.parts["\n"] = 0  # what parts words has no ids
        self.part_counts, self.part_starts, self.part_ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def reset(self) -> None:
        self.index = Numbers()
        self.names: list[bytes] = []
        self.counts, self.starts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.agreed: set[tuple[int, int]] = set()

    def learn_parts(self) -> None:
        """Encodes pre-tokens that are new; each must end with the one id that the tokenizer marks as an end."""
        parts, self.parts.new = self.parts.new, []
        ids, ends = [], []
        for i in range(0, len(parts), 1024):
            block = parts[i : i + 1024]
            found = np.array(self.tokenizer.encode_batch_fast([" ".join(block)], add_special_tokens=False)[0].ids, np.int32)
            end = np.flatnonzero(self.ends[found]) + 1
            if len(end) != len(block) or end[-1] != len(found):
                alone = [np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, np.int32) for p in block]
                found, end = np.concatenate(alone), np.cumsum([len(x) for x in alone])
            ids.append(found)
            ends.append(np.diff(end, prepend=0))
        if parts:
            counts = np.concatenate(ends)
            self.part_starts = np.concatenate([self.part_starts, len(self.part_ids) + np.cumsum(counts) - counts])
            self.part_counts = np.concatenate([self.part_counts, counts])
            self.part_ids = np.concatenate([self.part_ids, *ids])

    def encode_plain(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain words, back to back, and how many each has, by their pre-tokens, of which fewer are new."""
        at = self.parts.of(_PARTS("\n".join(names).lower()))
        self.learn_parts()
        counts = self.part_counts[at]
        word = np.cumsum(at == 0)
        return self.part_ids[ranges(self.part_starts[at], counts)], np.bincount(word, counts, len(names)).astype(np.int64)

    def encode_others(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any words, by the library's offsets."""
        e = self.tokenizer.encode(" ".join(names), add_special_tokens=False)
        begins = np.cumsum([0] + [len(name) + 1 for name in names])
        return np.array(e.ids, np.int32), np.diff(np.searchsorted(np.array([o for o, _ in e.offsets], np.int64), begins))

    def learn(self) -> None:
        """Encodes words that are new."""
        words, self.index.new = self.index.new, []
        names = [n for i in range(0, len(words), 4096) for n in b" ".join(words[i : i + 4096]).decode("utf-8", "replace").split(" ")]
        plain, rest = [], []
        for i in range(0, len(names), 256):
            block = "".join(names[i : i + 256])
            if self.ends is not None and _PLAIN(block) and "<|" not in block:
                plain += range(i, min(i + 256, len(names)))
            else:
                for k in range(i, min(i + 256, len(names))):
                    (plain if self.ends is not None and _PLAIN(names[k]) and "<|" not in names[k] else rest).append(k)
        counts, starts, ids, at = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64), [], len(self.ids)
        groups = [(plain, self.encode_plain)] if plain else []
        for which, encode in groups + [(rest[i : i + 512], self.encode_others) for i in range(0, len(rest), 512)]:
            found, n = encode([names[k] for k in which])
            counts[which], starts[which] = n, at + np.cumsum(n) - n
            ids.append(found)
            at += len(found)
        self.names += words
        self.starts, self.counts = np.concatenate([self.starts, starts]), np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, *ids])

    def words(self, chunks: list[bytes]) -> list[np.ndarray]:
        """For each chunk, the numbers of its words."""
        found = [self.index.of(c.split()) for c in chunks]
        if self.index.new:
            self.learn()
        return found

    def flat(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, back to back, and how many each has."""
        counts = self.counts[words]
        return self.ids[ranges(self.starts[words], counts)], counts

    def agree(self, left: bytes, right: bytes) -> bool:
        """Whether the last word on the left and the first on the right give the same ids together as alone."""
        pair = tuple(self.index.of([left, right]).tolist())
        if self.index.new:
            self.learn()
        if pair not in self.agreed:
            both = self.tokenizer.encode(b" ".join(self.names[i] for i in pair).decode("utf-8", "replace"), add_special_tokens=False).ids
            if both != self.flat(np.array(pair))[0].tolist():
                return False
            self.agreed.add(pair)
        return True

    def repaired(self, text: bytes, chunks: list[bytes]) -> np.ndarray | None:
        """None if all joins agree, else the ids of the text with more and more of it encoded at once."""
        ends = [(c.split(None, 1)[0], c.rsplit(None, 1)[-1]) for c in chunks if not c.isspace()]
        if all(self.agree(a[1], b[0]) for a, b in zip(ends, ends[1:], strict=False)):
            return None
        parts = self.words(chunks)
        words, known = text.split(), np.concatenate(parts)
        ends, span = np.cumsum([len(p) for p in parts])[:-1], 1
        ids = self.flat(known)[0]
        while True:  # twice as many words around each join, until one more doubling changes nothing
            span *= 2
            pieces, at = [], 0
            for e in ends:
                lo, hi = max(at, int(e) - span), min(len(words), int(e) + span)
                pieces += [self.flat(known[at:lo])[0], np.array(self.tokenizer.encode(b" ".join(words[lo:hi]).decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32)]
                at = hi
            again = np.concatenate([*pieces, self.flat(known[at:])[0]])
            if np.array_equal(ids, again) or span > len(words):
                return again
            ids = again

    def encode(self, data: np.ndarray, starts: np.ndarray, given: list[dict[int, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that lie back to back in ``data``, back to back, and where each text's begin.

        ``given`` has, for each text, the ids of chunks that are known, by the byte at which the chunk begins.
        """
        if len(self.index) > self.most_words:
            self.reset()
        if len(self.parts) > self.most_parts:
            self.forget_parts()
        raw = data.tobytes()
        cuts = np.minimum(cut_points(data, starts), len(data))
        ends = np.append(cuts[1:], len(data)) if len(cuts) else cuts
        of_text = np.searchsorted(cuts, starts)
        chunks = [raw[a:b] for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
        known = {int(np.searchsorted(cuts, starts[k] + at)): ids for k, some in enumerate(given or ()) for at, ids in some.items()}
        words = self.words([b"" if i in known else c for i, c in enumerate(chunks)])
        ids, counts = self.flat(np.concatenate(words)) if words else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        n_words = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)[n_words]
        if known:
            pieces = [known[i] if i in known else ids[upto[i] : upto[i + 1]] for i in range(len(chunks))]
            ids, upto = np.concatenate(pieces).astype(np.int32), np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        begins = upto[of_text]
        texts = None
        for k in range(len(starts) - 1):
            own = chunks[of_text[k] : of_text[k + 1]]
            if len(own) > 1 and (fixed := self.repaired(raw[starts[k] : starts[k + 1]], own)) is not None:
                texts = texts or [ids[begins[i] : begins[i + 1]] for i in range(len(starts) - 1)]
                texts[k] = fixed
        if texts:
            begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            ids = np.concatenate(texts)
        return ids, begins


_ENCODERS: dict[str, Encoder] = {}  # one for each worker process and tokenizer


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def row_slices(starts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; a longer row is a run of its own."""
    n, at = len(starts) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to


class Decoder:
    """``tokenizer.decode(ids, skip_special_tokens=False)`` of tokenizers without a decoder: tokens joined by a space."""

    def __init__(self, path: str):
        t = encoder(path).tokenizer
        self.table = np.array([(t.id_to_token(i) or "").encode() for i in range(t.get_vocab_size())], object)
        self.decimals = np.array([b"%d" % i for i in range(len(self.table))], object)

    def decode(self, ids: np.ndarray, begins: np.ndarray) -> pa.Array:
        tokens, at = self.table[ids], (begins - begins[0]).tolist()
        return pa.array([b" ".join(tokens[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary()).cast(pa.string())

    def sha256(self, ids: np.ndarray, begins: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Digests of the ids, as decimals joined by one space, and of the decoded text, for each text."""
        at = (begins - begins[0]).tolist()
        of = lambda table: pa.array([hashlib.sha256(b" ".join(table[ids[s:e]])).hexdigest() for s, e in zip(at[:-1], at[1:], strict=True)], pa.string())
        return of(self.decimals), of(self.table)


def decode(encoded: DataFrame, ids: str = "ids", tokenizer: str | None = None, out: str = "decoded") -> DataFrame:
    """Adds the decoded text of the ids as ``out``; see :class:`Decoder`. Null and empty ids give an empty text, an empty
    table an empty one; rows are decoded one by one, so repeated ones are too."""
    encoded = encoded.drop(out)
    path = tokenizer or default_tokenizer()
    schema = StructType([*encoded.schema.fields, StructField(out, StringType(), False)])
    names = encoded.columns

    def run(batches):
        decoder = Decoder(path)
        for whole in batches:
            lists = whole.column(names.index(ids))
            if lists.null_count:
                lists = pa.array([x or [] for x in lists.to_pylist()], pa.list_(pa.int32()))
            starts, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for a, b in row_slices(starts, SLICE_BYTES // 2):
                yield pa.RecordBatch.from_arrays([*whole.slice(a, b - a).columns, decoder.decode(values[starts[a] : starts[b]], starts[a : b + 1])], names=[*names, out])

    return encoded.mapInArrow(run, schema)


#: What :func:`round_trip` can add to each row.
OUTPUTS = {
    "ids": ArrayType(IntegerType(), False), "decoded": StringType(), "n_tokens": LongType(), "ids_sha256": StringType(), "decoded_sha256": StringType()
}


def chunk_places(docs: DataFrame, text: str) -> DataFrame:
    """(d1, d2, row, start, stop): digest and bytes of every chunk of ``SHARED_BYTES`` or more."""

    def run(batches):
        for whole in batches:
            data, starts = utf8_parts(whole.column(1))
            for a, b in row_slices(starts, SLICE_BYTES):
                own, at = data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]
                cuts = np.minimum(cut_points(own, at), len(own))
                ends = np.append(cuts[1:], len(own)) if len(cuts) else cuts
                long = ends - cuts >= SHARED_BYTES
                cuts, ends, raw = cuts[long], ends[long], own.tobytes()
                owner = np.searchsorted(at, cuts, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [*digests(raw, cuts, ends), whole.column(0).slice(a, b - a).take(pa.array(owner)), pa.array(cuts - at[owner], pa.int32()), pa.array(ends - at[owner], pa.int32())],
                    names=["d1", "d2", "row", "start", "stop"],
                )

    return docs.select(ROW, text).mapInArrow(run, "d1 bigint, d2 bigint, row bigint, start int, stop int")


def shared_chunks(docs: DataFrame, text: str, path: str) -> DataFrame | None:
    """(d1, d2, row, start, ids): the places of shared chunks with their ids, as packed int32; None without any.

    Places are counted before they are shuffled; a chunk with many places meets its ids in a join, which Spark splits.
    """
    places = cut(chunk_places(docs, text))
    repeated = places.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "start", "stop")).alias("one"))
    repeated = cut(repeated.where("n > 1").select("d1", "d2", "one.*"))
    if repeated.isEmpty():
        return None
    owned = repeated.groupBy(F.col("row").alias(ROW)).agg(F.collect_list(F.struct("d1", "d2", "start", "stop")).alias("owned"))

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            data, starts = utf8_parts(batch.column(0))
            lists, raw = batch.column(1), data.tobytes()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            f = {n: lists.flatten().field(n) for n in ("d1", "d2", "start", "stop")}
            at, to = (starts[row] + f[n].to_numpy() for n in ("start", "stop"))
            for i in range(0, len(row), 256):
                chunks = [raw[s:e] for s, e in zip(at[i : i + 256].tolist(), to[i : i + 256].tolist(), strict=True)]
                ids, begins = enc.encode(np.frombuffer(b"".join(chunks), np.uint8), np.cumsum([0] + [len(c) for c in chunks]))
                packed = [ids[s:e].astype("<i4").tobytes() for s, e in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([f["d1"].slice(i, len(chunks)), f["d2"].slice(i, len(chunks)), pa.array(packed, pa.binary())], names=["d1", "d2", "ids"])

    owners, _ = marked(docs.select(ROW, text), marks(repeated, "row"))
    ids = cut(owners.join(owned.hint("shuffle_hash"), ROW).select(text, "owned").mapInArrow(run, "d1 bigint, d2 bigint, ids binary"))
    return places.join(ids, ["d1", "d2"]).select("row", "start", "ids")


def round_trip(docs: DataFrame, text: str = "text", tokenizer: str | None = None, outputs: tuple[str, ...] = ("ids", "decoded"), id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``outputs``: of each whole text the token ``ids``, the text ``decoded`` from them, their number
    ``n_tokens``, and the sha256 of the ids (decimals joined by a space) and of the decoded text.

    Null and empty texts have no ids. Bytes that aren't UTF-8 count as U+FFFD. Rows with a null or repeated id are
    documents of their own; ids, order and repeats of rows don't change what a text gives. An empty table gives an
    empty one. Columns of ``docs`` with the names of outputs are replaced.
    Only texts that own or have shared chunks are shuffled, to meet their ids. A task holds a slice of about 1 MB of text, or one longer text, at a
    time, and the digests are taken there, so that neither ids nor decoded text need leave it.
    """
    docs = keyed(docs.drop(*outputs), id_col)
    path = tokenizer or default_tokenizer()
    placed, rest = shared_chunks(docs, text, path), docs
    given = F.lit(None).cast("array<struct<start: int, ids: binary>>").alias("__given")
    if placed is not None:
        some, rest = marked(docs, marks(placed, "row"))
        listed = placed.groupBy(F.col("row").alias(ROW)).agg(F.collect_list(F.struct("start", "ids")).alias("__given"))
        some = some.join(listed.hint("shuffle_hash"), ROW, "left")
    joined = rest.select("*", given)
    if placed is not None:
        joined = joined.unionByName(some.select(joined.columns))
    kept = [c for c in docs.columns if c != ROW]
    joined = joined.select(*kept, "__given")
    schema = StructType([*joined.schema.fields[:-1], *(StructField(c, OUTPUTS[c], False) for c in outputs)])
    at = kept.index(text)

    def run(batches):
        enc, decoder = encoder(path), Decoder(path)
        for whole in batches:
            data, starts = utf8_parts(whole.column(at))
            for a, b in row_slices(starts, SLICE_BYTES):
                some = [{x["start"]: np.frombuffer(x["ids"], "<i4") for x in row or ()} for row in whole.column(len(kept)).slice(a, b - a).to_pylist()]
                ids, begins = enc.encode(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a], some)
                made = {
                    "ids": lambda: pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids)),
                    "decoded": lambda: decoder.decode(ids, begins), "n_tokens": lambda: pa.array(np.diff(begins)),
                }  # noqa: B023
                if {"ids_sha256", "decoded_sha256"} & set(outputs):
                    sums = decoder.sha256(ids, begins)
                    made |= {"ids_sha256": lambda: sums[0], "decoded_sha256": lambda: sums[1]}  # noqa: B023
                yield pa.RecordBatch.from_arrays([*whole.slice(a, b - a).columns[:-1], *(made[c]() for c in outputs)], names=[*kept, *outputs])

    return joined.mapInArrow(run, schema)


def encode(docs: DataFrame, text: str = "text", tokenizer: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the token ids of each whole text as array<int> ``ids``; see :func:`round_trip`."""
    return round_trip(docs, text, tokenizer, ("ids",), id_col)


DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), outputs=DIGESTS).select("doc_id", *DIGESTS)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: each document's id, its ids and their count, and digests of ids and decoded text.

    A row for each row of ``docs``, null and repeated ids included; null and empty texts have no ids; an empty table stays
    one. Long texts are encoded slice by slice.
    """
    return round_trip(docs.select("doc_id", "text"), outputs=("ids", *DIGESTS)).select("doc_id", "ids", *DIGESTS)
