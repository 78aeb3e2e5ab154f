"""What the operators of this package share: row keys, written intermediate tables and text batches."""

from __future__ import annotations

import atexit
import gc
import hashlib
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column that identifies a row inside an operator.
ROW = "__row"
#: ASCII white space, as the contracts list it: space, and tab to carriage return.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[ \t\n\x0B\f\r]"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one is set where the session has none (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="quillstream-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
    return found.rstrip("/")


def cut(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Writes ``df`` to a table in the shared folder and reads it back.

    A writer and a reader hold a row group, so where rows are megabytes ``group_rows`` says how many rows one may have.

    Lineage ends there, so a lost executor costs one read, and the optimizer plans what follows with the table's
    real size. The table goes when the session's process ends, or with :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.option("parquet.block.row.count.limit", group_rows) if group_rows else writer).parquet(path)
    atexit.register(_remove, spark, path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # Spark deletes shuffle files of frames that nothing refers to any more
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Deletes tables that :func:`cut` wrote, once all that reads them is written itself."""
    for t in tables:
        _remove(t.sparkSession, t.cut_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone; the folder's owner clears it
        pass


def keyed(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds the bigint ``ROW`` that tells rows apart and is in the order of ids.

    That is ``id_col`` itself if it is an integer column, never null and never repeated. Otherwise rows are sorted by id,
    nulls last, and among equal ids by a hash of the row, and numbered in that order, and written once, so that the numbers
    stay the same when a task runs again: repeated rows are documents of their own, the smallest number is a row of the
    smallest id, and how the table was split does not matter. With ``id_col`` ``ROW`` the frame has it already; another
    column of that name is replaced.
    """
    if id_col == ROW:
        return docs
    docs = docs.drop(ROW)
    if dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint"):
        per_id = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
        if per_id.where("n > 1 or " + f"`{id_col}` is null").isEmpty():
            return docs.withColumn(ROW, F.col(id_col).cast("bigint"))
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    order = [F.col(f"`{id_col}`").asc_nulls_last(), F.col("__tie"), F.col("__read")]  # the last parts rows that are all equal
    numbered = docs.withColumns({"__tie": hashed, "__read": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(numbered.drop("__tie", "__read").withColumn(ROW, F.monotonically_increasing_id()))


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """``docs`` with all its columns in one, ``__doc``, beside those that an operator reads: so none of its columns can
    clash with the operator's."""
    return docs.select(F.struct(*docs.columns).alias("__doc"), *needed)


#: Bits of a marks table: 131,072 words of 64, some 4 MB however many rows there are.
MARK_BITS = 1 << 23


def _mark(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(MARK_BITS))


def marks(rows: DataFrame, key: str) -> DataFrame:
    """(word, bits): a bitmap of the hashes of ``key``, written; small enough to be broadcast by its very form."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (_mark(F.col(key)) % 64).cast("int"))
    return cut(rows.groupBy((_mark(F.col(key)) / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")))


def marked(docs: DataFrame, found: DataFrame, key: str = ROW) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two parts: rows whose key may be in ``found``, and rows whose key is not. Neither is shuffled, so of
    texts only those that a join may need have to move. (A hash of another key may set a row's bit.)"""
    word, bit = (_mark(F.col(key)) / 64).cast("int"), (_mark(F.col(key)) % 64).cast("int")
    both = docs.join(F.broadcast(found.withColumnsRenamed({"word": "__word", "bits": "__bits"})), word == F.col("__word"), "left")
    hit = F.coalesce(F.call_function("shiftright", F.col("__bits"), bit).bitwiseAND(F.lit(1).cast("bigint")) == 1, F.lit(False))
    return both.where(hit).select(*docs.columns), both.where(~hit).select(*docs.columns)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary Arrow array, back to back, and where each value starts (one more than values).

    Nulls count as empty.
    """
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = column.cast(pa.large_binary())
    _, offsets, data = large.buffers()
    at = np.frombuffer(offsets, np.int64)[large.offset : large.offset + len(large) + 1]
    if data is None or not len(large):
        return np.zeros(0, np.uint8), np.zeros(len(large) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_bounds(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of texts that lie back to back begin and end, and which word is each text's first.

    ``inside`` says of every byte whether it belongs to a word; no word goes on from one text into the next.
    """
    padded = np.concatenate([[False], inside, [False]])
    opens, closes = padded[1:] & ~padded[:-1], padded[:-1] & ~padded[1:]
    bounds = starts[1:-1]
    joined = bounds[padded[bounds] & padded[bounds + 1]]
    opens[joined] = closes[joined] = True
    begins = np.flatnonzero(opens)
    return begins, np.flatnonzero(closes), np.searchsorted(begins, starts)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, back to back."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


#: Two primes and a base for each; a hash is a pair of remainders.
_PRIMES = (2**31 - 1, 2**31 - 19)
_BASES = (1_220_703_133, 1_664_525_707)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}
#: Powers that a worker keeps from call to call; those of a longer text go with it.
_KEPT = 1 << 22


def _modulo(x: np.ndarray, prime: int) -> np.ndarray:
    p = np.uint64(prime)
    return x - (x // p) * p


def _powers(k: int, down: bool, n: int) -> np.ndarray:
    """The first n powers of the k-th base, or of its inverse, kept from call to call."""
    have = _POWERS.get((k, down), np.ones(1, np.uint64))
    base = pow(_BASES[k], -1, _PRIMES[k]) if down else _BASES[k]
    while len(have) < n:
        have = np.concatenate([have, _modulo(have * np.uint64(pow(base, len(have), _PRIMES[k])), _PRIMES[k])])
    _POWERS[k, down] = have[:_KEPT] if len(have) <= _KEPT else have[:_KEPT].copy()
    return have[:n]


class PrefixHash:
    """Prefix polynomial hashes of a sequence: the hash of any stretch takes two subtractions and two products.

    Elements are bytes or 64-bit values. Arithmetic is modulo two primes: modulo a power of two,
    sequences that nest two elements in each other (Thue-Morse) have equal hashes whatever the base.
    """

    def __init__(self, values: np.ndarray):
        n, self.sums, self.down = len(values), [], []
        for k, prime in enumerate(_PRIMES):
            small = values.dtype == np.uint8
            v = values.astype(np.uint64) + np.uint64(1) if small else (values >> np.uint64(33) if k else values & np.uint64(2**31 - 1))
            terms = v * _powers(k, False, n)
            if not small or n >= 1 << 22:  # else sums stay below 2 ** 63
                terms = _modulo(terms, prime)
            self.sums.append(_modulo(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)]), prime))
            self.down.append(_powers(k, True, n + 1))

    def _pair(self, parts: list[np.ndarray], lengths) -> np.ndarray:
        return mix(((parts[0] << np.uint64(32)) | parts[1]) ^ mix(np.atleast_1d(np.asarray(lengths)).astype(np.uint64)))

    def of(self, starts: np.ndarray, lengths) -> np.ndarray:
        """The hashes of the stretches [start, start + length); equal stretches have equal hashes wherever they stand."""
        pairs = zip(self.sums, self.down, _PRIMES, strict=True)
        return self._pair([_modulo((s[starts + lengths] + np.uint64(p) - s[starts]) * d[starts], p) for s, d, p in pairs], lengths)

    def every(self, length: int) -> np.ndarray:
        """The hashes of all stretches of this length, in order."""
        pairs, n = zip(self.sums, self.down, _PRIMES, strict=True), max(0, len(self.sums[0]) - length)
        return self._pair([_modulo((s[length:] + np.uint64(p) - s[:n]) * d[:n], p) for s, d, p in pairs], length)


_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_WRAPPED: dict[str, np.ndarray] = {}


def _wrapped(kind: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_WRAPPED.get(kind, ())) < n or kind not in _WRAPPED:
        full = np.full(max(n, 1), base, np.uint64)
        full[0] = 1
        powers = np.multiply.accumulate(full)
        if n > _KEPT:
            return powers
        _WRAPPED[kind] = powers
    return _WRAPPED[kind][:n]


def gram_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all stretches of ``length``, modulo 2 ** 64: a third of the work of :class:`PrefixHash`, for uses where
    equal hashes are no proof of anything."""
    n = len(values) - length + 1
    spread = _BYTES[values] if values.dtype == np.uint8 else values
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread * _wrapped("up", _ODD, len(values)))])
    return mix((sums[length:] - sums[:n]) * _wrapped("down", _ODD_INVERSE, len(values))[:n])


class ShortHash:
    """Hashes of short stretches of bytes, modulo 2 ** 64: cheaper than :class:`PrefixHash`, and sound for a few bytes,
    where no pattern can nest deep enough to cancel."""

    def __init__(self, data: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _wrapped("up", _ODD, len(data)))])
        self.down = _wrapped("down", _ODD_INVERSE, len(data))

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        return mix((self.sums[starts + length] - self.sums[starts]) * self.down[starts])


def digests(raw: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """128-bit BLAKE2 digests of stretches of bytes, as two columns of bigint."""
    found = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), stops.tolist(), strict=True))
    halves = np.frombuffer(found, np.int64).reshape(-1, 2)
    return pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1]))
