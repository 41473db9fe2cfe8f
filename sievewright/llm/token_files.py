"""Token-ID output: ids in the fewest bits of the vocabulary, in blocks that unpack by numpy.

File format
-----------
A folder of Parquet files; each row is a block that ends with a document:

    shard int       blocks of a shard hold a range of doc_ids; shards ascend with doc_id
    block int       number in the shard, from 0
    first long      ids of the shard before the block
    low long, high long   least and greatest doc_id; blocks ascend, so Parquet's statistics find a document's
    bits int        width of an id
    n_ids long      ids in the block
    doc_ids array<long>, doc_starts array<long>   each document's first id, from the block's start
    payload binary  the ids, little-endian, id i in bits [i*bits, (i+1)*bits)

Any run of ids is read without the rest: `unpack(payload, bits, start, n)` touches only its bytes.
Blocks are framed by Parquet, so they are written and read by Spark alone, wherever the store is.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, encode

BLOCK_SCHEMA = "shard int, block int, first long, low long, high long, bits int, n_ids long, doc_ids array<long>, doc_starts array<long>, payload binary"


#: Chunks of text that a worker remembers the ids of (some 250 bytes each).
KEEP = 1_000_000


def width(vocabulary: int) -> int:
    """Bits of an id below `vocabulary`."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids (< 2**bits, bits <= 32) one after another, low bits first."""
    if bits in (8, 16, 32):
        return np.ascontiguousarray(ids, f"<u{bits // 8}").tobytes()
    out = []
    for i in range(0, len(ids), 1 << 16):  # whole bytes, as 2**16 * bits is a multiple of 8
        part = np.ascontiguousarray(ids[i : i + (1 << 16)], "<u4").view(np.uint8).reshape(-1, 4)
        out.append(np.packbits(np.unpackbits(part, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(payload: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """ids [start, start + n) of a payload, as unsigned 32-bit integers."""
    if n <= 0:
        return np.empty(0, "<u4")
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", n, start * bits // 8).astype("<u4")
    low = start * bits
    data = np.frombuffer(payload, np.uint8)[low // 8 : -(-(start + n) * bits // 8)]
    flat = np.unpackbits(data, bitorder="little")[low % 8 : low % 8 + n * bits].reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide.ravel(), bitorder="little").view("<u4")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 1 << 16, shards: int | None = None) -> None:
    """Encode every whole text, add end_id, write the blocks to path in ascending doc_id order.

    Nulls, empty texts, repeated ids: as in `common`; an empty text is end_id alone. One document is
    never cut, so a block holds block_ids or one very long document. Memory is one block a task.
    """
    rows = common.keyed(docs, id_col, text_col)
    bits = width(encode.vocabulary_size(tokenizer, end_id))
    n = shards or common.buckets(docs, 12)

    def run(batches):
        enc = encode.worker_wide(encode.Encoder, tokenizer, KEEP)
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        ids, names, starts, held = [], [], [], 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array(names[:1], pa.int64()), pa.array(names[-1:], pa.int64()), pa.array([bits], pa.int32()), pa.array([held], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int64())), pa.array([pack(np.concatenate(ids), bits)], pa.binary())],
                ["shard", "block", "first", "low", "high", "bits", "n_ids", "doc_ids", "doc_starts", "payload"],
            )

        end = np.array([end_id], "<u4")
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for a, b in encode.slices(texts):
                for key, got in zip(keys[a:b], enc.encode(texts[a:b])):
                    names.append(key)
                    starts.append(held)
                    ids += [np.frombuffer(got, enc.dtype), end]
                    held += len(got) // enc.dtype.itemsize + 1
                    if held >= block_ids:
                        yield row()
                        ids, names, starts, block, first, held = [], [], [], block + 1, first + held, 0
        if names:
            yield row()

    blocks = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, BLOCK_SCHEMA)
    blocks.write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard, block of the written files.

    The shards' totals, one row for each file, are summed on the driver: their number is a parameter
    of `write`, not a count of documents.
    """
    blocks = read(spark, path)
    before, bases = 0, []
    for shard, ids in sorted(blocks.groupBy("shard").agg(F.sum("n_ids")).collect()):
        bases.append((shard, before))
        before += ids
    base = spark.createDataFrame(bases, "shard int, base long")

    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                ids = unpack(x["payload"], x["bits"], 0, x["n_ids"])
                ends = [*x["doc_starts"][1:], x["n_ids"]]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["doc_ids"], pa.int64()), pa.array([x["first"] + s for s in x["doc_starts"]], pa.int64()), pa.array([e - s for s, e in zip(x["doc_starts"], ends)], pa.int64()), pa.array([zlib.crc32(ids[s:e]) for s, e in zip(x["doc_starts"], ends)], pa.int64()), pa.array([x["shard"]] * n, pa.int32()), pa.array([x["block"]] * n, pa.int32())],
                    ["doc_id", "local", "n_tokens", "ids_crc32", "shard", "block"],
                )

    rows = blocks.mapInArrow(run, "doc_id long, local long, n_tokens long, ids_crc32 long, shard int, block int")
    small = F.broadcast(base) if len(bases) <= 200_000 else base
    return rows.join(small, "shard").select(common.id_out(), (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "shard", "block")


def blocks_of(spark: SparkSession, path: str, doc_id: int | None) -> DataFrame:
    """The block that holds a document. The conditions on low and high reach the Parquet reader, whose
    statistics leave out all files, row groups and pages without it."""
    key = F.lit(common.NULL_ID if doc_id is None else doc_id).cast("long")
    return read(spark, path).where((F.col("low") <= key) & (F.col("high") >= key)).where(F.array_contains("doc_ids", key))


def token_range(spark: SparkSession, path: str, doc_id: int | None, start: int = 0, n: int | None = None) -> np.ndarray:
    """ids [start, start + n) of one document: one block is found, and of it only the bytes of those ids
    are unpacked. KeyError if there is no such document."""
    row = blocks_of(spark, path, doc_id).select("bits", "n_ids", "doc_ids", "doc_starts", "payload").first()
    if row is None:
        raise KeyError(doc_id)
    k = row["doc_ids"].index(common.NULL_ID if doc_id is None else doc_id)
    low, high = row["doc_starts"][k], (*row["doc_starts"][1:], row["n_ids"])[k]
    start = min(max(start, 0), high - low)
    count = high - low - start if n is None else max(0, min(n, high - low - start))
    return unpack(row["payload"], row["bits"], low + start, count)
