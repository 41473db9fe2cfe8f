"""Suffix-array dedup to a fixed depth: bytes of any 100-byte string that started earlier are cut.

Suffixes need ordering only through their first `depth` bytes. They are ordered by a radix sort from
the most significant digit; a group that is down to one suffix leaves after each pass, and the groups
of equal suffixes left after the last pass are exactly the repeated windows.

* First digit. It deals suffixes to tasks and is any function of the window; here, of the hashes of
  all 32-byte strings in the window, the least (the leftmost of equals), with its place. A run of
  windows that have the same least string is one entry (an anchor and how far its windows reach), so
  some 3 entries stand for 100 suffixes. Anchors whose string is found once leave: of most texts
  nothing goes on.
* Second digit. Anchors that are left go to buckets with the bytes that their windows cover, by the
  first digit and the bytes on the side of the string where a window has more of them. Where one
  string has very many anchors (a passage in a large part of all documents), its windows are parted
  by more bytes, those on both sides that all windows of a range have, so that what differs in the
  text around the passage goes to different buckets.
* Further digits. There, each window is a suffix, and digits of 8 bytes split the groups until `depth`.
  In a group the first occurrence stays and the others are cut.

Whole copies of a text are found by a digest before that: all but the first are cut whole. What is
equal within a batch of rows is reduced to its first occurrence before each shuffle (the others are
known to be cut), so a passage in a third of all documents brings an entry for each batch.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, encode
from .ngram_join import U, mix, text_buffers

GRAM = 32
CHUNK = 1 << 18
PLACE_BITS = 20


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes in a row, by doubling."""
    h = mix(np.arange(256, dtype=U) + U(0x51ED))[data]
    size = 1
    while size < GRAM:
        h = h[:-size] * U((0x9E3779B97F4A7C15 + 0x1000003D1 * size) | 1) + h[size:]
        size *= 2
    return mix(h)


def anchors(data: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """(hash, text number, first window, windows, place of the string in the first window) of each
    run of windows with the same least string. Windows are counted from their text's start."""
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    wide = depth - GRAM + 1  # strings in a window
    out = []
    for at in range(0, max(0, len(data) - depth + 1), CHUNK):
        part = data[at : at + CHUNK + depth - 1]
        if len(part) < depth:
            break
        hashes = gram_hashes(part)
        low = hashes >> U(PLACE_BITS) << U(PLACE_BITS) | np.arange(len(hashes), dtype=U)
        size = 1
        while 2 * size <= wide:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < wide:
            low = np.minimum(low[: len(low) - (wide - size)], low[wide - size :])
        place = (low & U((1 << PLACE_BITS) - 1)).astype(np.int64)
        window = np.arange(at, at + len(place))
        text = np.searchsorted(ends, window, "right")
        inside = window + depth <= ends[np.minimum(text, len(ends) - 1)]
        window, place, text = window[inside], place[inside], text[inside]
        if not len(window):
            continue
        new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1))))
        many = np.diff(np.concatenate((new, [len(window)])))
        out.append((hashes[place[new]], text[new], window[new] - starts[text[new]], many, place[new] + at - window[new]))
    if not out:
        return tuple(np.empty(0, t) for t in (U, np.int64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


FOUND = "bucket long, keys binary, docs binary, starts binary, many binary, places binary, known binary"
CANDIDATES = "key long, doc_id long, start long, many int, place int"


def _packed(bucket: np.ndarray, cols: list[np.ndarray], names: list[str]):
    """Rows of columns packed to bytes, one for each bucket (rows are sorted by it)."""
    at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    stop = np.concatenate((at[1:], [len(bucket)]))
    for i in range(0, len(at), 500):
        part = list(zip(at[i : i + 500].tolist(), stop[i : i + 500].tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[at[i : i + 500]], pa.int64()), *(pa.array([c[a:b].tobytes() for a, b in part], pa.binary()) for c in cols)], ["bucket", *names])


def first_digit(batches, depth: int, homes: np.ndarray):
    """Anchors by bucket of their hash. Of those with one hash in a batch only the first goes there,
    marked; the others are known to be candidates, so they need meet no one and go by their document."""
    n_buckets = len(homes)
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        got = []
        for a, data, ends in text_buffers(batch.column(1), 1 << 20):
            h, text, start, many, place = anchors(data, ends, depth)
            got.append((h, ids[a + text], start, many.astype(np.uint8), place.astype(np.uint8)))
        if not got or not sum(len(g[0]) for g in got):
            continue
        h, docs, start, many, place = (np.concatenate(x) for x in zip(*got))
        del got
        order = np.argsort(h, kind="stable")
        h, docs, start, many, place = h[order], docs[order], start[order], many[order], place[order]
        first = np.concatenate(([True], h[1:] != h[:-1]))
        last = np.concatenate((first[1:], [True]))
        known = np.where(first, (~last).astype(np.uint8), 2).astype(np.uint8)
        # the least hash of a window is a low one, so it is mixed before it deals
        bucket = (((mix(h) >> U(32)) * U(n_buckets)) >> U(32)).astype(np.int64)
        bucket[~first] = (mix(docs[~first].astype(np.int64).view(U)) % U(n_buckets)).astype(np.int64)
        bucket = homes[bucket]
        order = np.argsort(bucket, kind="stable")
        yield from _packed(bucket[order], [x[order] for x in (h, docs, start.astype(np.int32) if start.max(initial=0) < 2**31 else start, many, place, known)], ["keys", "docs", "starts", "many", "places", "known"])
        encode.release()


def _joined(table, name: str, dtype):
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)


def repeated(key, table):
    """A bucket's anchors whose hash is found more than once."""
    keys, docs, many, place, known = (_joined(table, n, t) for n, t in (("keys", U), ("docs", np.int64), ("many", np.uint8), ("places", np.uint8), ("known", np.uint8)))
    starts = np.concatenate([np.frombuffer(s, np.int64 if len(s) == len(d) else np.int32).astype(np.int64) for s, d in zip(table.column("starts").to_pylist(), table.column("docs").to_pylist())])
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.concatenate(([False], k[1:] == k[:-1]))
    keep = order[same | np.concatenate((same[1:], [False])) | (known[order] > 0)]
    return pa.table([pa.array(keys[keep].view(np.int64)), pa.array(docs[keep]), pa.array(starts[keep]), pa.array(many[keep].astype(np.int32)), pa.array(place[keep].astype(np.int32))], names=["key", "doc_id", "start", "many", "place"])


PASSAGES = "bucket long, keys binary, docs binary, starts binary, many binary, places binary, bytes binary"
CUTS = "doc_id long, first long, last long"


#: Anchors of one string from which on its windows are parted by more bytes.
CROWD = 1000


def ranges(depth: int, crowded: bool) -> list[tuple[int, int]]:
    """Ranges (least, most) of the bytes that a window has left of its least string: two halves, or,
    for crowded strings, ranges that get narrower towards both ends. All windows of a range have
    `least` bytes left of the string and depth - GRAM - most right of it; those are the digit."""
    room = depth - GRAM
    edges = {0, room // 2, room + 1}
    if crowded:
        steps = [1 << k for k in range(8) if 1 << k < room // 2]
        edges |= {*steps, *(room + 1 - x for x in steps)}
    edges = sorted(edges)
    return [(a, b - 1) for a, b in zip(edges[:-1], edges[1:])]


def passages(batches, depth: int, homes: np.ndarray):
    """The bytes that candidates' windows cover, by bucket of the next digit (see ranges).

    Of equal ones in a batch the first goes there; the windows of the others are cut for sure (no
    bytes, buckets by document).
    """
    import xxhash

    n_buckets = len(homes)
    room, parted = depth - GRAM, {c: ranges(depth, c) for c in (False, True)}
    for batch in batches:
        first: dict[tuple, tuple[int, int]] = {}
        cut: list[tuple[int, int, int]] = []
        docs = batch.column(0).to_pylist()
        texts = batch.column(1).cast(pa.large_binary())
        found = batch.column(2)
        sizes = pc.list_value_length(found).to_pylist()
        flat = found.flatten()
        keys, starts, many, places, crowds = (flat.field(i).to_pylist() for i in range(5))
        at = 0
        for doc, size, text in zip(docs, sizes, texts):
            text = text.as_py()
            for i in range(at, at + size):
                key, start, n, place = keys[i], starts[i], many[i], places[i]
                gram = start + place
                seed = key & (2**64 - 1)
                parts = []
                for k, (least, most) in enumerate(parted[crowds[i]]):
                    high, low = min(place, most), max(place - n + 1, least)
                    if low <= high:
                        digit = xxhash.xxh64_intdigest(text[gram - least : gram] + text[gram + GRAM : gram + GRAM + room - most], seed ^ k)
                        parts.append((digit, high, high - low + 1, start + place - high))
                for digit, at_place, windows, begin in parts:
                    what = (digit, at_place, windows, text[begin : begin + windows - 1 + depth])
                    here = (doc, begin)
                    seen = first.get(what)
                    if seen is None:
                        first[what] = here
                    elif seen <= here:
                        cut.append((doc, begin, windows))
                    else:
                        first[what] = here
                        cut.append((*seen, windows))
            at += size
        del keys, starts, many, places, crowds
        if first:
            rows = sorted(((k >> 32) * n_buckets >> 32, k, place, text, n, doc, start) for (k, place, n, text), (doc, start) in first.items())
            del first
            bucket = homes[np.array([x[0] for x in rows])]
            at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            stop = np.concatenate((at[1:], [len(rows)]))
            for i in range(0, len(at), 200):
                part = [rows[a:b] for a, b in zip(at[i : i + 200], stop[i : i + 200])]
                pack = lambda n, t: pa.array([np.array([x[n] for x in p], t).tobytes() for p in part], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(bucket[at[i : i + 200]], pa.int64()), pack(1, np.uint64), pack(5, np.int64), pack(6, np.int64), pack(4, np.uint8), pack(2, np.uint8), pa.array([b"".join(x[3] for x in p) for p in part], pa.binary())], ["bucket", "keys", "docs", "starts", "many", "places", "bytes"])
            del rows
        if cut:
            c = np.array(cut, np.int64)
            doc, begin, end = _runs_of(c[:, 0], c[:, 1], c[:, 1] + c[:, 2] - 1)
            where = homes[(mix(doc.view(U)) % U(n_buckets)).astype(np.int64)]
            order = np.argsort(where, kind="stable")
            for rb in _packed(where[order], [doc[order], begin[order], (end - begin + 1)[order]], ["docs", "starts", "many"]):
                none = pa.nulls(rb.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([rb.column(0), none, rb.column(1), rb.column(2), rb.column(3), none, none], ["bucket", "keys", "docs", "starts", "many", "places", "bytes"])
        encode.release()


def _runs_of(docs: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals (included ends) of each document, joined where they touch or overlap."""
    order = np.lexsort((first, docs))
    d, a, b = docs[order], first[order], last[order]
    # the furthest end so far in the document; documents are set apart by more than any end
    step = int(b.max()) + 2
    number = np.cumsum(np.concatenate(([0], d[1:] != d[:-1])))
    reach = np.maximum.accumulate(b + number * step)
    new = np.flatnonzero(np.concatenate(([True], a[1:] + number[1:] * step > reach[:-1] + 1)))
    ends = np.concatenate((new[1:], [len(d)])) - 1
    return d[new], a[new], reach[ends] - number[ends] * step


def _intervals(docs: np.ndarray, windows: np.ndarray) -> pa.Table:
    """Runs of neighbouring windows."""
    order = np.lexsort((windows, docs))
    d, w = docs[order], windows[order]
    new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (w[1:] > w[:-1] + 1)))) if len(d) else np.empty(0, np.int64)
    last = np.concatenate((new[1:], [len(d)])) - 1 if len(d) else new
    return pa.table([pa.array(d[new], pa.int64()), pa.array(w[new], pa.int64()), pa.array(w[last], pa.int64())], names=["doc_id", "first", "last"])


def radix_passes(data: bytes, at: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of data that start at `at`, in groups so far: those equal to another of their group
    through depth, and the groups they end in. One pass for each 8 bytes; what is alone leaves."""
    digits = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    which = np.arange(len(at))
    for offset in range(0, depth, 8):
        place = at[which] + min(offset, depth - 8)
        digit = digits[place].astype(U)
        order = np.lexsort((digit, group))
        which, group, digit = which[order], group[order], digit[order]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1]))) if len(which) else np.empty(0, bool)
        alone = new & np.concatenate((new[1:], [True])) if len(which) else new
        group = np.cumsum(new)
        which, group = which[~alone], group[~alone]
        if not len(which):
            break
    return which, group


#: Windows whose digits a task holds at once; those of one key are never parted.
WINDOWS = 400_000


def _cut_windows(data: bytes, begin: np.ndarray, keys: np.ndarray, places: np.ndarray, docs: np.ndarray, starts: np.ndarray, many: np.ndarray, depth: int) -> pa.Table:
    """Windows that are cut: equal to one that comes first. Entry i has many[i] windows, from byte
    begin[i] on, the first starting at starts[i] of its document."""
    entry = np.repeat(np.arange(len(many), dtype=np.int32), many)
    step = np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many)
    place = places[entry] - step
    order = np.lexsort((place, keys[entry]))
    k, p = keys[entry][order], place[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (p[1:] != p[:-1])))
    alone = new & np.concatenate((new[1:], [True]))
    group, order = np.cumsum(new)[~alone], order[~alone]
    del k, p, place, new, alone
    which, group = radix_passes(data, begin[entry[order]] + step[order], group, depth)
    which = order[which]
    d, w = docs[entry[which]], starts[entry[which]] + step[which]
    order = np.lexsort((w, d, group))
    first = np.concatenate(([True], group[order][1:] != group[order][:-1])) if len(order) else np.empty(0, bool)
    return _intervals(d[order[~first]], w[order[~first]])


def further_digits(depth: int):
    def run(key, table):
        known = table.filter(pc.is_null(table.column("bytes")))
        docs, starts, many = (_joined(known, n, np.int64) for n in ("docs", "starts", "many"))
        gone = [pa.table([pa.array(docs), pa.array(starts), pa.array(starts + many - 1)], names=["doc_id", "first", "last"])]
        table = table.filter(pc.is_valid(table.column("bytes")))
        if not table.num_rows:
            return gone[0]
        docs, starts = _joined(table, "docs", np.int64), _joined(table, "starts", np.int64)
        many = _joined(table, "many", np.uint8).astype(np.int64)
        keys, places = _joined(table, "keys", U), _joined(table, "places", np.uint8).astype(np.int64)
        data = b"".join(table.column("bytes").to_pylist())
        begin = np.concatenate(([0], np.cumsum(many - 1 + depth)[:-1]))
        del table
        # keys are taken one after another, so many at a time that their windows fit into memory
        order = np.argsort(keys, kind="stable")
        total = np.cumsum(many[order])
        new = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1], [True])))
        a = 0
        while a < len(new) - 1:
            before = total[new[a] - 1] if new[a] else 0
            b = max(a + 1, int(np.searchsorted(total[new[1:] - 1], before + WINDOWS, "right")))
            part = order[new[a] : new[b]]
            gone.append(_cut_windows(data, begin[part], keys[part], places[part], docs[part], starts[part], many[part], depth))
            a = b
        encode.release()
        return pa.concat_tables(gone)

    return run


def _kept(batches, depth: int):
    """What is left of each document whose cuts are given."""
    for batch in batches:
        docs = batch.column(0).to_pylist()
        texts = batch.column(1).cast(pa.large_binary())
        out = []
        for r in range(len(docs)):
            text = texts[r].as_py()
            spans: list[list[int]] = []
            for a, b in sorted((x["first"], x["last"] + depth) for x in batch.column(2)[r].as_py()):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            left, at = [], 0
            for a, b in spans:
                left.append(text[at:a])
                at = b
            left.append(text[at:])
            kept = b"".join(left)
            out.append((docs[r], len(text) - len(kept), [{"first": a, "after": b} for a, b in spans], kept))
        cols = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))), pa.array(cols[3], pa.binary())], ["doc_id", "n_removed", "spans", "kept"])


KEPT = "doc_id long, n_removed long, spans array<struct<first: long, after: long>>, kept binary"


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs with (left_semi) or without (left_anti) these ids (written), broadcast only if few."""
    return docs.join(F.broadcast(ids) if ids.count() <= common.BROADCAST_IDS else ids, "doc_id", how)


def cut_repeats(docs: DataFrame, *, depth: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256 (of kept), kept (bytes).

    A byte goes if a string of `depth` bytes that covers it also starts earlier: in a document with a
    smaller id, or further left in the same one. Strings are judged on the input and never cross
    documents. spans are the maximal runs cut. kept is the rest, which may not be valid UTF-8; it is
    left out with with_kept=False. depth is between GRAM + 8 and 256.

    Null and empty texts have no bytes; ids that are null or repeat: as in `common`.
    """
    if not GRAM + 8 <= depth <= 256:
        raise ValueError(f"depth must be from {GRAM + 8} to 256")
    with common.arrow_batches(docs.sparkSession, 16):
        return _cut_repeats(docs, depth, id_col, text_col)


def _cut_repeats(docs: DataFrame, depth: int, id_col: str, text_col: str) -> DataFrame:
    rows = common.keyed(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    sums, _ = common.written(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "digests")
    # written, so that the join below is one that can part a text with very many copies
    heads, _ = common.written(sums.where(F.col("n_bytes") >= depth).groupBy("sha").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("sha", "rep"), "heads")
    copies, _ = common.written(sums.join(heads, "sha").where("doc_id <> rep").select("doc_id"), "copies")
    n_buckets = common.buckets(docs, 4)
    homes = common.homes(n_buckets)
    work = _only(rows.where(F.octet_length("text") >= depth), copies, "left_anti")

    packed = work.mapInArrow(lambda x: first_digit(x, depth, homes), FOUND)
    again, _ = common.written(common.by_bucket(packed, n_buckets).groupBy("bucket").applyInArrow(repeated, CANDIDATES), "anchors")
    ids, _ = common.written(again.select("doc_id").distinct(), "ids")
    crowds, _ = common.written(again.groupBy("key").count().where(F.col("count") >= CROWD).select("key", F.lit(True).alias("crowd")), "crowds")
    told = again.join(F.broadcast(crowds) if crowds.count() <= common.BROADCAST_IDS else crowds, "key", "left")
    lists = told.groupBy("doc_id").agg(F.collect_list(F.struct("key", "start", "many", "place", F.coalesce("crowd", F.lit(False)).alias("crowd"))).alias("found"))
    bytes_of = _only(work, ids, "left_semi").join(lists, "doc_id").select("doc_id", "text", "found").mapInArrow(lambda x: passages(x, depth, homes), PASSAGES)
    cuts, _ = common.written(common.by_bucket(bytes_of, n_buckets).groupBy("bucket").applyInArrow(further_digits(depth), CUTS), "cuts")

    ids, _ = common.written(cuts.select("doc_id").distinct(), "ids")
    lists = cuts.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("cuts"))
    changed = _only(work, ids, "left_semi").join(lists, "doc_id").select("doc_id", "text", "cuts").mapInArrow(lambda x: _kept(x, depth), KEPT)
    changed, _ = common.written(changed, "changed")
    span = "array<struct<first: long, after: long>>"
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("after")))
    whole = _only(_only(rows, ids, "left_anti"), copies, "left_anti")
    parts = [
        whole.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast(span).alias("spans"), F.col("text").cast("binary").alias("kept")),
        changed.select("doc_id", (F.col("n_removed") + F.octet_length("kept")).alias("n_bytes"), "n_removed", "spans", "kept"),
        _only(sums, copies, "left_semi").select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), all_of_it.cast(span).alias("spans"), F.lit(b"").alias("kept")),
    ]
    return reduce(DataFrame.unionByName, parts).select(common.id_out(), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "spans", F.sha2("kept", 256).alias("kept_sha256"), "kept")
