"""Token-ID output: ids bit-packed at a fixed width, in blocks with offsets.

Format, as rows of a Parquet table: ``shard`` and ``block`` number the blocks; a block holds whole documents, in order:
their first and last id, all ``doc_ids``, the ``offsets`` of their first ids in the block (one more than documents), ``width`` in bits and
``payload``, where id i takes bits i * width to (i + 1) * width, low bits first. Any id is found by arithmetic, any
document by its block's offsets, and a block unpacks in a few numpy steps. Shards, blocks and documents ascend by document
id.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import SLICE_BYTES, default_tokenizer, encoder, row_slices
from .common import ROW, shared_dir, utf8_parts

END_ID = 2
#: Words and pre-tokens that a worker remembers: more than in :mod:`bpe`, as nothing else is done with a text here.
MOST_WORDS, MOST_PARTS = 300_000, 500_000


def width_of(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """``ids`` at ``width`` bits each, padded with zeros to a whole byte."""
    ids = ids.astype("<u4")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    out = []
    for i in range(0, len(ids), 1 << 16):  # each piece but the last fills whole bytes
        bits = np.unpackbits(ids[i : i + (1 << 16)].view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        out.append(np.packbits(bits.ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(payload: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a packed block, as uint32, reading no others."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", stop - start, start * width // 8).astype("<u4")
    first, last = start * width // 8, (stop * width + 7) // 8
    near = np.frombuffer(payload, np.uint8, last - first, first)
    near = np.concatenate([near, np.zeros(8, np.uint8)])
    bit = np.arange(start, stop, dtype=np.int64) * width - first * 8
    at, value = bit >> 3, np.zeros(stop - start, np.uint64)
    for k in range(5):
        value |= near[at + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype("<u4")


BLOCKS = "shard int, block int, first_id bigint, last_id bigint, doc_ids array<bigint>, offsets array<bigint>, width int, payload binary"


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encodes every whole text, adds ``end_id`` and writes the blocks to ``path`` in ascending order of the id.

    Null and empty texts are the end id alone. Every row has its place: null ids come first, and rows of one id follow
    each other in the order of their texts. The one shuffle deals the texts out by ranges of the id; its bounds come
    from Spark's sample of ids, which decides where files begin, not what is written. An empty table gives no block. A
    long text is encoded slice by slice; its ids are one row of its block.
    """
    at = tokenizer or default_tokenizer()
    head = F.substring(text, 1, 64)  # rows of one id are dealt out too
    ranged = docs.select(F.col(id_col).cast("bigint").alias(ROW), F.col(text).alias("text"), head.alias("head")).repartitionByRange(ROW, "head")
    ordered = ranged.sortWithinPartitions(ROW, "head", "text").select(F.spark_partition_id().alias("shard"), ROW, "text")

    def run(batches):
        enc = encoder(at)
        enc.most_words, enc.most_parts = MOST_WORDS, MOST_PARTS
        width, block = width_of(enc.tokenizer.get_vocab_size()), 0
        for whole in batches:
            data, starts = utf8_parts(whole.column(2))
            for a, b in row_slices(starts, SLICE_BYTES):
                ids, begins = enc.encode(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                ids = np.insert(ids, begins[1:], end_id)
                offsets = begins + np.arange(b - a + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([whole.column(0)[0].as_py()], pa.int32()),
                        pa.array([block], pa.int32()),
                        pa.array([pc.min(whole.column(1).slice(a, b - a)).as_py()], pa.int64()),
                        pa.array([pc.max(whole.column(1).slice(a, b - a)).as_py()], pa.int64()),
                        pa.ListArray.from_arrays([0, b - a], whole.column(1).slice(a, b - a)),
                        pa.ListArray.from_arrays([0, b - a + 1], pa.array(offsets, pa.int64())),
                        pa.array([width], pa.int32()),
                        pa.array([pack(ids, width)], pa.binary()),
                    ],
                    names=["shard", "block", "first_id", "last_id", "doc_ids", "offsets", "width", "payload"],
                )
                block += 1

    ordered.mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(BLOCKS).parquet(path)


def read_tokens(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document in the files: ``start`` counts the ids of all documents before it. Null and
    repeated ids come back as they were written, each document once; files without blocks give none."""
    sizes = blocks.groupBy("shard", "block").agg(F.sum(F.element_at("offsets", -1)).alias("n"))
    # a row for each block: first within its shard, then over the shards, of which there are as many as files
    within = sizes.withColumn("in_shard", F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n"))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("total"))
    before = shards.withColumn("before", F.sum("total").over(Window.orderBy("shard")) - F.col("total")).select("shard", "before")
    first = within.join(before, "shard").select("shard", "block", (F.col("before") + F.col("in_shard")).alias("first"))
    placed = blocks.join(first, ["shard", "block"])

    def run(batches):
        for batch in batches:
            for doc_ids, offsets, width, payload, first in zip(*(batch.column(i) for i in range(5)), strict=True):
                at = offsets.values.to_numpy()
                ids = unpack(payload.as_py(), width.as_py(), 0, int(at[-1]))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.values, pa.array(at[:-1] + first.as_py()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view(np.int32)))], names=["doc_id", "start", "ids"]
                )

    return placed.select("doc_ids", "offsets", "width", "payload", "first").mapInArrow(run, "doc_id bigint, start bigint, ids array<int>")


def read_document(blocks: DataFrame, doc_id: int) -> list[int]:
    """The ids of one document, by random access: blocks whose range of ids does not hold it are skipped by the file's
    statistics, and only its bits are unpacked. Of repeated ids the first document; an id that is not there gives none."""
    within = (F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)
    found = blocks.where(within).where(
        F.array_contains("doc_ids", F.lit(doc_id).cast("bigint"))
    ).orderBy("shard", "block").select("doc_ids", "offsets", "width", "payload").limit(1).collect()
    if not found:
        return []
    k = found[0].doc_ids.index(doc_id)
    return unpack(bytes(found[0].payload), found[0].width, found[0].offsets[k], found[0].offsets[k + 1]).tolist()


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32); the checksum is over the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return tokens.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    blocks = write_tokens(docs, f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}")
    return checksums(read_tokens(blocks))
