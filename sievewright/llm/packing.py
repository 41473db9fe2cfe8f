"""Packing documents into training sequences: first-fit decreasing in randomised groups.

Documents are dealt to groups by a hash of their id, some `group_bytes` of text to a group, and each group is
packed on its own: whole sequences are cut from documents that are longer; what remains of each is
placed, longest first, into the first sequence with room for it. The first one with room is found in
a tournament tree over the sequences' free places, in the logarithm of their number. At the end the
emptiest sequences of the group are dissolved and cut up into the gaps of the others, so all of a
group's sequences together have fewer free places than one has places. A document with more text than
that is a group of its own, so a task holds a group or one document, whatever the corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, encode

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Chunks of text that a worker remembers the ids of (some 250 bytes each).
KEEP = 300_000


class FreePlaces:
    """Tournament tree: each inner node has the most free places of any sequence below it."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.most = [capacity] * (2 * self.leaves)

    def take(self, length: int) -> int:
        """Place `length` into the first sequence that has room, and return its number."""
        most, k = self.most, 1
        while k < self.leaves:
            k *= 2
            if most[k] < length:
                k += 1
        most[k] -= length
        at = k
        while k > 1:
            k //= 2
            most[k] = max(most[2 * k], most[2 * k + 1])
        return at - self.leaves


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The sequence of each piece (0 < length <= capacity); equal lengths go in the order given."""
    tree, out = FreePlaces(max(1, len(lengths)), capacity), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        out[i] = tree.take(lengths[i])
    return out


def plan(tokens: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece of documents with these lengths."""
    pieces, full = [], 0
    rest = []
    for d, n in enumerate(tokens):
        whole = n // capacity
        for k in range(whole):
            pieces.append((d, k * capacity, capacity, full, 0))
            full += 1
        if n % capacity:
            rest.append((d, whole * capacity, n % capacity))
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for piece, b in zip(rest, first_fit_decreasing([p[2] for p in rest], capacity)):
        bins.setdefault(b, []).append(piece)
    order = sorted(bins.values(), key=lambda b: -sum(p[2] for p in b))
    need = -(-sum(p[2] for p in rest) // capacity)
    loose = [p for b in order[need:] for p in b][::-1]
    for b in order[:need]:
        free = capacity - sum(p[2] for p in b)
        while free and loose:
            d, start, length = loose.pop()
            if length > free:
                loose.append((d, start + free, length - free))
                length = free
            b.append((d, start, length))
            free -= length
        at = 0
        for d, start, length in b:
            pieces.append((d, start, length, full, at))
            at += length
        full += 1
    return pieces


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, *, capacity: int = 2048, group_bytes: int = 8 << 20, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Every whole text is encoded and gets end_id; null and empty texts are end_id alone. ids (binary,
    little-endian unsigned 32-bit) is left out with with_ids=False. sequence_id is unique over all
    groups, not dense. Ids that repeat, nulls and empty tables: as in `common`.
    """
    rows = common.keyed(docs, id_col, text_col)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    groups = max(1, (rows.agg(F.sum(size)).first()[0] or 0) // group_bytes)
    schema = PIECES + (", ids binary" if with_ids else "")

    def tokens(batches):
        enc = encode.worker_wide(encode.Encoder, tokenizer, KEEP)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            keys, texts, group = batch.column(0), [x or "" for x in batch.column(1).to_pylist()], batch.column(2)
            home = homes[group.to_numpy() % parts]
            for a, b in encode.slices(texts):
                got = [x + end for x in enc.encode(texts[a:b])]
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(got, pa.binary()), pa.array([enc.dtype.itemsize] * (b - a), pa.int32()), group.slice(a, b - a), pa.array(home[a:b])], ["doc_id", "ids", "size", "group", "home"])
            encode.release()

    def pack(key, table):
        table = table.sort_by("doc_id")
        keys, sizes = table.column("doc_id").to_pylist(), table.column("size").to_pylist()
        ids = [np.frombuffer(x.as_buffer(), f"<u{s}") for x, s in zip(table.column("ids"), sizes)]
        done = plan([len(x) for x in ids], capacity)
        parts = [ids[d][s : s + n].astype("<u4") for d, s, n, _, _ in done]
        cols = [[keys[p[0]] for p in done], [p[1] for p in done], [p[2] for p in done], [zlib.crc32(x) for x in parts], [len(ids[p[0]]) for p in done], [(key[1].as_py() << 24) + p[3] for p in done], [p[4] for p in done]]
        out = [pa.array(c, pa.int64()) for c in cols]
        names = [c.split()[0] for c in PIECES.split(", ")]
        if with_ids:
            out, names = [*out, pa.array([x.tobytes() for x in parts], pa.binary())], [*names, "ids"]
        encode.release()
        return pa.table(out, names=names)

    # a hash of the id deals documents to groups 0 to groups - 1, and long ones to numbers above
    spread = F.xxhash64(F.lit(seed), "doc_id")
    group = F.when(F.col("long_one"), groups + F.pmod(spread, F.lit(1 << 36))).otherwise(F.pmod(spread, F.lit(groups)))
    rows = rows.withColumn("long_one", size > group_bytes).select("doc_id", "text", group.alias("group"))
    parts = min(max(12, groups), common.MOST_PARTITIONS)
    homes = common.homes(parts)
    # the ids are a table of their own: batches of texts stay small, and a lost group isn't encoded again
    with common.arrow_batches(docs.sparkSession, 8):
        ids, _ = common.written(rows.mapInArrow(tokens, "doc_id long, ids binary, size int, group long, home long"), "ids", "snappy")
    dealt = ids.repartition(parts, "home")
    out = dealt.groupBy("home", "group").applyInArrow(pack, schema)
    return out.withColumn("doc_id", common.id_out())
