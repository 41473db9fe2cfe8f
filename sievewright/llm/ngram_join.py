"""n-gram Jaccard join by parity sketches.

A document's set has its distinct 5-word shingles as 64-bit hashes. Documents link when their sets'
Jaccard similarity is at least num/den (4/5); the result is the connected groups.

Method
------
* Sizes fall into bands, each den/num times the last. If the smaller of two linked sets is in a band, the
  sets differ in at most d shingles, d following from the band's largest size.
* A set's sketch for a band has K blocks; a shingle's hash picks its block and toggles it. A block is
  kept as the XOR of its shingles' 64-bit words, which is the parity of a bit vector of that many
  random bits: toggling the same shingle twice leaves nothing. Each shingle on one side only changes
  one block, so the number of blocks that differ (their Hamming distance) is at most the symmetric
  difference, and of K > d blocks at least K - d are equal (pigeonhole).
* Empty blocks would be equal everywhere. They are not joined on; a set with more than d blocks that
  are not empty still shares one of them with each partner. A set that has fewer goes on to the next
  stage, with other blocks; its partners that have enough were joined before, and those that haven't
  come along. After the last stage the rest join on single shingles. So no link is lost.
* Stages 0 and 1 leave very frequent shingles (a passage in a large part of all documents) out of all
  sketches; that only lowers the symmetric difference, so all of the above holds as it is. Stage 1
  has four blocks for each possible difference, so a set with a third of its shingles left is served.
* Candidates with an equal block are compared by their whole sketches of single bits first; where
  those differ in more bits than linked sets may have shingles between them, the pair is out.
* Equal sets are one class and only its least id is compared. Candidates with an equal block are
  first paired with the one that most groups have; groups of equal blocks that are not in one component after
  that are paired across components. Only exact comparisons of sets make links.

Scale: block keys are packed into binary rows, one for each batch of documents and bucket of keys, so
a key costs some 8 bytes in one shuffle. Documents of a batch that share a key are chained before the
shuffle, so a key held by a third of all documents brings a row for each batch.
"""

from __future__ import annotations

import zlib
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, encode

WORDS = 5
STAGES = 10
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers without visible order (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Distinct shingle hashes of many texts at once, from their UTF-8 bytes."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self):
        low = np.arange(256)
        low[65:91] += 32
        self.value = mix(low.astype(U) + U(1))
        self.word = np.ones(256, bool)
        self.word[[0x20, *range(0x09, 0x0E)]] = False
        self.power = self.inverse = np.ones(1, U)

    def grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 1 << 20)
            back = pow(self.BASE, -1, 1 << 64)
            for name, base in (("power", self.BASE), ("inverse", back)):
                steps = np.full(n, U(base))
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U))

    def words(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all words, each text's first and last (not included), and where words begin and stop."""
        self.grow(len(data) + 1)
        inside = self.word[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[0] = True
        cut[ends] = True
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        begins = np.flatnonzero(inside & (~before | cut[:-1]))
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        stops = np.flatnonzero(inside & (~after | cut[1:])) + 1
        total = np.zeros(len(data) + 1, U)
        np.cumsum(self.value[data] * self.power[: len(data)], out=total[1:])
        words = mix((total[stops] - total[begins]) * self.inverse[begins])
        return words, np.searchsorted(begins, np.concatenate(([0], ends[:-1]))), np.searchsorted(begins, ends), begins, stops

    def sets(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all texts' sets, each sorted, one after another, and each set's size.

        data: the texts' bytes; ends: where each ends.
        """
        sizes = np.zeros(len(ends), np.int64)
        words, first, last, _, _ = self.words(data, ends)
        n = last - first
        if len(words) >= WORDS:
            rolled = np.zeros(len(words) - WORDS + 1, U)
            for k in range(WORDS):
                rolled += words[k : len(words) - WORDS + 1 + k] * U(2 * k + 3)
                rolled = rolled * U(self.BASE)
            rolled = mix(rolled)
        out = []
        for d in range(len(ends)):
            if n[d] >= WORDS:
                x = np.sort(rolled[first[d] : last[d] - WORDS + 1])
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
            elif n[d]:
                x = words[first[d] : last[d]]
                x = mix(np.array([(sum(int(v) * 31**k for k, v in enumerate(x, 1)) + int(n[d])) % (1 << 64)], U))
            else:
                continue
            out.append(x)
            sizes[d] = len(x)
        return (np.concatenate(out) if out else np.empty(0, U)), sizes


def text_buffers(column: pa.Array, bytes_each: int = 1 << 20):
    """(first row, UTF-8 bytes, ends) of runs of texts of about so many bytes; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + bytes_each, "right")) - 1)
        yield a, data[ends[a] : ends[b]], (ends[a + 1 : b + 1] - ends[a]).astype(np.int64)
        a = b


class Bands:
    """Size bands for similarity num/den: lows, differences d, numbers of blocks K."""

    def __init__(self, num: int, den: int, largest: int = 1 << 40):
        self.num, self.den, self.low, self.d, self.k = num, den, [], [], []
        low = 1
        while low < largest:
            high = max(low + 1, -(-low * den // num))
            most = high - 1 + (high - 1) * den // num  # the smaller set and its largest partner
            d = most * (den - num) // (den + num)
            self.low.append(low)
            self.d.append(d)
            self.k.append(1 if d == 0 else d + 1 + max(1, int(0.16 * d)))
            low = high
        self.low, self.d, self.k = (np.array(x, np.int64) for x in (self.low, self.d, self.k))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, "right") - 1

    def below(self, sizes: np.ndarray) -> np.ndarray:
        """Whether a partner may be in the band below."""
        return -(-sizes * self.num // self.den) < self.low[self.of(sizes)]


def block_keys(hashes: np.ndarray, sizes: np.ndarray, bands: Bands, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, set's number) of all sets' blocks that are to be joined on."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rare = np.ones(len(hashes), bool)
    if len(frequent):
        maybe = np.zeros(1 << 16, bool)
        maybe[(frequent & U(0xFFFF)).astype(np.int64)] = True
        where = np.flatnonzero(maybe[(hashes & U(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(frequent, hashes[where]), len(frequent) - 1)
        rare[where[frequent[at] == hashes[where]]] = False
    own = bands.of(np.maximum(sizes, 1))
    keys, owners = [], []
    for down in (0, 1):
        todo = sizes > 0 if not down else (sizes > 0) & bands.below(np.maximum(sizes, 1)) & (own > 0)
        band = own - down
        for stage in range(STAGES + 1):
            if not todo.any():
                break
            use = todo[owner] & rare if stage <= 1 else todo[owner]
            h, who = hashes[use], owner[use]
            if stage:
                h = mix(h ^ mix(np.full(1, stage, U)))
                order = np.lexsort((h, who)) if stage < STAGES else slice(None)
                h, who = h[order], who[order]
            tag = mix((band[who] * (STAGES + 1) + stage + 1).astype(U))
            if stage == STAGES:
                keys.append(mix(h ^ tag))
                owners.append(who)
                break
            k = (bands.k if stage != 1 else np.maximum(4 * bands.d, 1))[band[who]].astype(U)
            block = ((h >> U(32)) * k) >> U(32)
            if not len(h):
                continue
            new = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (block[1:] != block[:-1]))))
            parity = np.bitwise_xor.reduceat(mix(h + U(stage)), new)
            keys.append(mix(parity ^ mix(tag[new] + block[new])))
            owners.append(who[new])
            filled = np.bincount(who[new], minlength=len(sizes))
            todo = todo & (filled <= bands.d[band])
    if not keys:
        return np.empty(0, U), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def _digests(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """XOR and sum of each set: with its size, what tells sets apart."""
    x, s = np.zeros(len(sizes), U), np.zeros(len(sizes), U)
    full = np.flatnonzero(sizes)
    if len(full):
        at = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        x[full] = np.bitwise_xor.reduceat(mix(hashes), at)
        s[full] = np.add.reduceat(mix(hashes + U(7)), at)
    return x, s


def bit_sketches(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """Each set's parity sketch: a shingle toggles one bit. A set of n has a power of two of bits, 2n
    to 4n, 64 at least; folding one in half (XOR) is the sketch of half as many bits."""
    out: list[bytes | None] = []
    spread, at = mix(hashes + U(13)), 0
    for n in sizes.tolist():
        if not n:
            out.append(None)
            continue
        bits = max(64, 1 << (2 * n - 1).bit_length())
        toggled = np.bincount((spread[at : at + n] & U(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(toggled.astype(np.uint8), bitorder="little").tobytes())
        at += n
    return out


#: Bits of the sketches of one length that a join's condition compares.
FOLD = 512


def folded_sketches(hashes: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Each set's parity sketch of FOLD bits, as 64-bit integers."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = owner * FOLD + (mix(hashes + U(13)) & U(FOLD - 1)).astype(np.int64)
    toggled = (np.bincount(at, minlength=FOLD * len(sizes)) & 1).astype(np.uint8)
    words = np.packbits(toggled, bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * (FOLD // 64), pa.int32()), pa.array(words))


def hamming(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded: at most the sets' symmetric difference."""
    p, q = np.frombuffer(a, U), np.frombuffer(b, U)
    while len(p) > len(q):
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def _near(batches, num: int, den: int):
    """Pairs whose sketches allow that they link."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("sa", "sb", "na", "nb")))
        keep = pa.array([hamming(x, y) <= (m + n) * (den - num) // (den + num) for x, y, m, n in rows], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


DIGESTS = "doc_id long, n long, x long, s long, sketch binary, fold array<long>, frequent boolean"


def digests(batches, share: float):
    """A row for each document; also the batch's frequent shingles (x) with their counts (n)."""
    shingler = encode.worker_wide(Shingler)
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        seen, documents = [], 0
        for a, data, ends in text_buffers(batch.column(1)):
            hashes, sizes = shingler.sets(data, ends)
            x, s = _digests(hashes, sizes)
            n = len(sizes)
            documents += n
            yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + n]), pa.array(sizes), pa.array(x.view(np.int64)), pa.array(s.view(np.int64)), pa.array(bit_sketches(hashes, sizes), pa.binary()), folded_sketches(hashes, sizes), pa.array(np.zeros(n, bool))], ["doc_id", "n", "x", "s", "sketch", "fold", "frequent"])
            common_here = np.sort(hashes)
            edge = np.flatnonzero(np.concatenate(([True], common_here[1:] != common_here[:-1], [True]))) if len(common_here) else np.zeros(1, np.int64)
            times = np.diff(edge)
            often = times >= max(3, int(share * n / 4))
            seen.append((common_here[edge[:-1][often]] if len(times) else common_here, times[often]))
        if seen:
            h, t = np.concatenate([v[0] for v in seen]), np.concatenate([v[1] for v in seen])
            values, which = np.unique(h, return_inverse=True)
            times = np.bincount(which, t, len(values)).astype(np.int64)
            often = times >= max(3, int(share * documents / 2))
            values, times = values[often], times[often]
            encode.release()
            yield pa.RecordBatch.from_arrays([pa.nulls(len(values), pa.int64()), pa.array(times), pa.array(values.view(np.int64)), pa.nulls(len(values), pa.int64()), pa.nulls(len(values), pa.binary()), pa.nulls(len(values), pa.list_(pa.int64())), pa.array(np.ones(len(values), bool))], ["doc_id", "n", "x", "s", "sketch", "fold", "frequent"])


PACKED = "bucket long, keys binary, rows binary, ids binary, members array<long>"
GROUPS = "key long, members array<long>"
#: A key that so many documents of one batch share goes on with the least of them alone.
CROWD = 32


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal keys."""
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return new, np.diff(np.concatenate((new, [len(keys)])))


def packed_keys(batches, bands: Bands, frequent: np.ndarray, homes: np.ndarray):
    """Block keys of each batch, by bucket: six bytes of each key, the row it is of, the rows' ids.

    A crowd (see CROWD) becomes a group at once, and goes to a bucket of its own number.
    """
    n_buckets = len(homes)
    shingler = encode.worker_wide(Shingler)
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        keys, rows = [], []
        for a, data, ends in text_buffers(batch.column(1)):
            hashes, sizes = shingler.sets(data, ends)
            k, who = block_keys(hashes, sizes, bands, frequent)
            keys.append(k)
            rows.append(a + who)
        if not sum(map(len, keys)):
            continue
        keys, rows = np.concatenate(keys), np.concatenate(rows)
        order = np.argsort(keys, kind="stable")
        keys, rows = keys[order], rows[order]
        new, size = _runs(keys)
        out, gone = [], np.zeros(len(keys), bool)
        for i in np.flatnonzero(size >= CROWD).tolist():
            group = np.unique(ids[rows[new[i] : new[i] + size[i]]])
            rows[new[i]] = np.flatnonzero(ids == group[0])[0]
            gone[new[i] + 1 : new[i] + size[i]] = True
            key, home = keys[new[i]].tobytes(), int(homes[((keys[new[i]] >> U(32)) * U(n_buckets)) >> U(32)])
            out.append((-1 - int(keys[new[i]] % U(n_buckets)), key, None, None, group))
            out.append((home, key, None, None, group[:1]))  # tells the key's own bucket
        keys, rows = keys[~gone], rows[~gone]
        bucket = homes[((keys >> U(32)) * U(n_buckets)) >> U(32)]
        short = keys.view(np.uint8).reshape(-1, 8)[:, :6]
        rows = rows.astype(np.uint16 if len(ids) <= 65536 else np.uint32)
        names = zlib.compress(np.diff(ids, prepend=0).tobytes(), 1)
        at, count = _runs(bucket)
        del order, new, size
        out += [(int(bucket[i]), short[i : i + c].tobytes(), rows[i : i + c].tobytes(), names, None) for i, c in zip(at.tolist(), count.tolist())]
        for i in range(0, len(out), 2000):
            part = list(zip(*out[i : i + 2000]))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), *(pa.array(part[k], pa.binary()) for k in (1, 2, 3)), pa.array(part[4], pa.list_(pa.int64()))], ["bucket", "keys", "rows", "ids", "members"])
        del keys, rows, bucket, short, out
        encode.release()


def equal_keys():
    """The groups of a bucket. A group's key is a hash of its members, so the same group found by many
    blocks is one; where a crowd may belong to it, it is the block's key."""

    def run(key, table):
        crowd = pc.is_valid(table.column("members"))
        groups, crowds = table.filter(pc.invert(crowd)), table.filter(crowd)
        crowded = np.frombuffer(b"".join(crowds.column("keys").to_pylist()), U)
        if key[0].as_py() < 0:
            return pa.table([pa.array(crowded.view(np.int64)), pa.array(crowds.column("members").to_pylist(), pa.list_(pa.int64()))], names=["key", "members"])
        found = [pa.table([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64()))], names=["key", "members"])]
        if groups.num_rows:
            keys, docs = [], []
            for k, r, names in zip(*(groups.column(c).to_pylist() for c in ("keys", "rows", "ids"))):
                short = np.zeros((len(k) // 6, 8), np.uint8)
                short[:, :6] = np.frombuffer(k, np.uint8).reshape(-1, 6)
                keys.append(short.view(U).ravel())
                ids = np.cumsum(np.frombuffer(zlib.decompress(names), np.int64))
                docs.append(ids[np.frombuffer(r, np.uint16 if len(r) * 3 == len(k) else np.uint32)])
            keys, docs = np.concatenate(keys), np.concatenate(docs)
            order = np.argsort(keys, kind="stable")
            keys, docs = keys[order], docs[order]
            new, size = _runs(keys)
            wide = np.repeat(size > 1, size)
            keys, docs = keys[wide], docs[wide]
            if len(keys):
                order = np.lexsort((docs, keys))
                keys, docs = keys[order], docs[order]
                new, size = _runs(keys)
                same = np.add.reduceat(mix(docs.view(U) + U(11)), new)
                crowded = np.unique(crowded)
                for k in crowded:
                    same[keys[new] == (k & U((1 << 48) - 1))] = k
                _, first = np.unique(same, return_index=True)
                parts = [docs[new[i] : new[i] + size[i]] for i in first.tolist()]
                found.append(pa.table([pa.array(same[first].view(np.int64)), pa.array(parts, pa.list_(pa.int64()))], names=["key", "members"]))
        encode.release()
        return pa.concat_tables(found)

    return run


def _blobs(batches):
    """doc_id and its sorted set as bytes."""
    shingler = encode.worker_wide(Shingler)
    for batch in batches:
        for a, data, ends in text_buffers(batch.column(1)):
            hashes, sizes = shingler.sets(data, ends)
            at = np.concatenate(([0], np.cumsum(sizes)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(sizes)), pa.array([hashes[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())], ["doc_id", "hashes"])


def _linked(batches, num: int, den: int):
    """Pairs (a, b) whose sets are similar enough, by exact intersection."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist()):
            p, q = np.frombuffer(x, U), np.frombuffer(y, U)
            both = np.sort(np.concatenate((p, q)))
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            keep.append(den * shared >= num * (len(p) + len(q) - shared))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])


def _limited(df: DataFrame, most: int = common.BROADCAST_IDS) -> DataFrame:
    """df (written, narrow) for the small side of a join: broadcast only if it has few rows."""
    return F.broadcast(df) if df.count() <= most else df


def verified(pairs: DataFrame, docs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link; written. Sketches rule out most, the rest is compared by whole sets.

    sketches: doc_id, n, sketch of every document.
    """
    left, right = (sketches.select(F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab")
    near, _ = common.written(pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(lambda x: _near(x, num, den), "a long, b long"), "near")
    ids, _ = common.written(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "candidates")
    sets, path = common.written(docs.join(_limited(ids), "doc_id").select("doc_id", "text").mapInArrow(_blobs, "doc_id long, hashes binary"), "sets", "uncompressed")
    right = sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hb"))
    left = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("ha"))
    rows = near.join(right, "b").join(left, "a").select("a", "b", "ha", "hb")
    out, _ = common.written(rows.mapInArrow(lambda x: _linked(x, num, den), "a long, b long"), "links")
    common.delete(docs.sparkSession, path)
    return out


def jaccard_groups(docs: DataFrame, *, similarity: tuple[int, int] = (4, 5), frequent_share: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id reachable by links.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z in lower case. A text of fewer than 5
    words is one shingle; one without words (or null) has none and links with nothing, not even
    another such text. Ids that are null or repeat: as in `common`. frequent_share: shingles in more
    than this share of documents are left out of the first sketches, never of a comparison.
    """
    with common.arrow_batches(docs.sparkSession, 8):
        return _jaccard_groups(docs, similarity, frequent_share, id_col, text_col)


def _jaccard_groups(docs: DataFrame, similarity: tuple[int, int], frequent_share: float, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    num, den = similarity
    rows = common.keyed(docs, id_col, text_col)
    seen, _ = common.written(rows.mapInArrow(lambda x: digests(x, frequent_share), DIGESTS), "digests")
    documents = seen.where("not frequent").select("doc_id", "n", "x", "s")
    sketches = seen.where("not frequent").select("doc_id", "n", "sketch")
    least = max(50, int(documents.count() * frequent_share))
    # shingles in that many documents: at most (average set) / frequent_share of them
    frequent = seen.where("frequent").groupBy("x").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("x")
    frequent = np.sort(np.array([r[0] for r in frequent.collect()], np.int64).view(U))
    # written, so that the join below is one that can part a class with very many copies
    classes, _ = common.written(documents.where("n > 0").groupBy("n", "x", "s").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "copied")
    member = documents.join(classes, ["n", "x", "s"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    member, _ = common.written(member, "classes")

    bands, n_buckets = Bands(num, den), common.buckets(docs, 6)
    copies, _ = common.written(member.where("doc_id <> rep").select("doc_id"), "copies")
    firsts = rows.join(_limited(copies), "doc_id", "left_anti")
    homes = common.homes(n_buckets)
    packed = firsts.mapInArrow(lambda x: packed_keys(x, bands, frequent, homes), PACKED)
    groups, _ = common.written(common.by_bucket(packed, n_buckets).groupBy("bucket").applyInArrow(equal_keys(), GROUPS), "groups")
    held = groups.select("key", F.explode("members").alias("doc_id")).distinct().join(member, "doc_id").select("key", "rep", "n")
    held, _ = common.written(held, "held")
    # a group's head is the member that most groups have: of copies with changes, the least changed
    degree = held.groupBy("rep").agg(F.count("*").alias("degree"))
    heads = held.join(degree, "rep").groupBy("key").agg(F.min(F.struct((-F.col("degree")).alias("d"), F.col("rep").alias("a")))["a"].alias("head"), F.count("*").alias("members")).where("members > 1").select("key", "head")
    pairs = held.join(heads, "key").where("head <> rep").select(F.least("head", "rep").alias("a"), F.greatest("head", "rep").alias("b")).distinct()
    sized = member.where("doc_id = rep").select(F.col("doc_id").alias("a"), F.col("n").alias("na"))
    pairs = pairs.join(sized, "a").join(sized.select(F.col("a").alias("b"), F.col("na").alias("nb")), "b").where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num).select("a", "b")
    tested, _ = common.written(pairs, "pairs")
    links = verified(tested, rows, sketches, num, den)
    found, _ = common.written(common.components(links, spark), "components")

    # equal blocks across components: compared pair by pair
    now = held.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))
    mixed = now.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c < d").select("key")
    part, _ = common.written(now.join(mixed, "key"), "mixed")
    part = part.join(seen.where("not frequent").select(F.col("doc_id").alias("rep"), "fold"), "rep")
    one, two = (part.select("key", *(F.col(c).alias(c + k) for c in ("rep", "n", "component", "fold"))) for k in "ab")
    apart = reduce(add, (F.bit_count(F.get("folda", F.lit(i)).bitwiseXOR(F.get("foldb", F.lit(i)))) for i in range(FOLD // 64)))
    fits = (apart * (den + num) <= (F.col("na") + F.col("nb")) * (den - num)) & (F.col("repa") < F.col("repb")) & (F.col("componenta") != F.col("componentb")) & (F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    across = one.join(two, "key").where(fits).select(F.col("repa").alias("a"), F.col("repb").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    across, _ = common.written(across, "across")
    if across.limit(1).count():
        more = verified(across, rows, sketches, num, den)
        if more.limit(1).count():
            found = common.components(links.unionByName(more), spark)
    return member.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(common.id_out(), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("component", "rep"), F.lit(common.NULL_ID)).alias("component_id"))


def oracle(docs: str = "documents", name: str = "grouped") -> str:
    """DuckDB: recursive common table expressions that end in `name` (doc_id, n_shingles, component_id)."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
    return f"""jw AS (SELECT doc_id, {words} AS w FROM {docs}),
      js AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM jw),
      jr AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM js WHERE len(s) > 0) GROUP BY s),
      je AS (SELECT rep, n, unnest(s) AS sh FROM jr),
      jl AS (SELECT a.rep AS a, b.rep AS b FROM je a JOIN je b ON a.sh = b.sh AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
      jg AS (SELECT a, b FROM jl UNION SELECT b, a FROM jl),
      jc(node, reach) AS (SELECT a, a FROM jg UNION SELECT jc.node, jg.b FROM jc JOIN jg ON jc.reach = jg.a),
      jm AS (SELECT node, min(reach) AS component FROM jc GROUP BY 1),
      {name} AS (SELECT js.doc_id, CAST(len(js.s) AS BIGINT) AS n_shingles, coalesce(jm.component, jr.rep, js.doc_id) AS component_id FROM js LEFT JOIN jr ON list_sort(js.s) = jr.s LEFT JOIN jm ON jm.node = jr.rep)"""
