"""Embedding near-dedup by an inverted multi-index.

Unit vectors are cut in halves; each half has a codebook of its own, and the product of the two is a
grid of cells. A vector looks into the cells nearest to it, taken in the order of the sum of both
halves' distances (multi-sequence traversal), and compares itself with all vectors there by cosine in
double precision. How many cells are looked into is measured when the index is built: for sampled
vectors and partners at exactly the least cosine, the number of cells at which the target share of
partners is reached. Closer partners are nearer, so their recall is higher.

Equal vectors are one, with a weight. Vectors of a cell are dealt to blocks of at most `block` rows
and so are those that look into it, so a crowded cell becomes many tasks, each bounded; a task
returns counts and a spanning forest of its links, never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Centres of a codebook at most; the driver holds a count for each cell of the grid (its square).
MOST_CENTRES = 1024


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def square_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]


def codebook(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """k centres of the rows of x by Lloyd's iterations from random rows."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = square_distances(x, centres).argmin(1)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


class Index:
    """Codebooks and the number of cells to look into."""

    def __init__(self, sample: np.ndarray, k: int, cosine: float, recall: float, seed: int = 0):
        self.half = sample.shape[1] // 2
        self.books = [codebook(sample[:, : self.half], k, seed=seed), codebook(sample[:, self.half :], k, seed=seed + 1)]
        self.grid = (len(self.books[0]), len(self.books[1]))
        rng = np.random.default_rng(seed + 2)
        x = sample[rng.choice(len(sample), min(2000, len(sample)), replace=False)]
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(1, keepdims=True) * x
        size = np.sqrt((away * away).sum(1, keepdims=True))
        y = cosine * x + np.sqrt(1 - cosine**2) * np.divide(away, size, out=np.zeros_like(away), where=size > 0)
        d = self.distances(x)
        own = self.cells(y)
        at = d[0][np.arange(len(x)), own // self.grid[1]] + d[1][np.arange(len(x)), own % self.grid[1]]
        rank = np.array([np.count_nonzero(d[0][i][:, None] + d[1][i][None, :] < at[i]) for i in range(len(x))])
        self.visits = int(min(self.grid[0] * self.grid[1], np.sort(rank)[min(len(rank) - 1, int(np.ceil(recall * len(rank))))] + 1))

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return square_distances(x[:, : self.half], self.books[0]), square_distances(x[:, self.half :], self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * self.grid[1] + b.argmin(1)

    def traverse(self, x: np.ndarray) -> np.ndarray:
        """The cells each row looks into, nearest first.

        In multi-sequence order the cell at ranks (i, j) of the two halves comes after the i * j cells
        of lower ranks, so only ranks with i * j <= visits are ever reached; their sums are formed at
        once and the least `visits` taken.
        """
        a, b = self.distances(x)
        ra, rb = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        reach = [(i, j) for i in range(self.grid[0]) for j in range(min(self.grid[1], self.visits // (i + 1)))]
        i, j = np.array([r[0] for r in reach]), np.array([r[1] for r in reach])
        sums = np.take_along_axis(a, ra, 1)[:, i] + np.take_along_axis(b, rb, 1)[:, j]
        best = sums.argsort(1, kind="stable")[:, : self.visits]
        return np.take_along_axis(ra, i[best], 1) * self.grid[1] + np.take_along_axis(rb, j[best], 1)


def matrix(column) -> np.ndarray:
    """Rows of a list column without nulls, all of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _roots(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id that each of n nodes reaches by edges (a, b)."""
    root = ids.copy()
    while True:
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        if (root == before).all():
            return root


def near_duplicates(vectors: DataFrame, *, cosine: float = 0.95, recall: float = 0.999, sample: int = 20_000, block: int = 4000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept.

    The codebooks are fitted on at most `sample` vectors, the first by a hash of their values; every
    vector is indexed. Vectors that are null or zero, have null or non-finite components, or another
    length than most link with nothing. A null id is one id; of rows that repeat an id the one with
    the least vector counts.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(common.NULL_ID)).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    if rows.groupBy("vec_id").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    sound = F.coalesce(F.forall("v", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows, _ = common.written(rows.select("vec_id", F.when(sound, F.col("v")).alias("v")), "vectors")
    usual = rows.where("v is not null").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if usual is None or usual["n"] < 2:
        return _result(alone)
    whole = rows.where((F.col("v").isNotNull()) & (F.size("v") == usual["n"]))
    classes, _ = common.written(whole.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "classes")
    member, _ = common.written(whole.join(classes, "v").select("vec_id", "rep", "weight"), "members")
    total = classes.count()
    got = classes.select("v").orderBy(F.xxhash64("v")).limit(sample).toArrow()
    index = Index(unit(matrix(got.column("v"))), int(min(MOST_CENTRES, max(4, (total / 16) ** 0.5))), cosine, recall)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("weight"), batch.column("v"), pa.array(index.cells(x), pa.int64())], ["rep", "weight", "v", "cell"])

    placed, _ = common.written(classes.select("rep", "weight", "v").mapInArrow(place, "rep long, weight long, v array<double>, cell long"), "cells")
    # at most MOST_CENTRES ** 2 cells: consecutive ones share a block, a crowded one has several
    first = np.zeros(index.grid[0] * index.grid[1] + 1, np.int64)
    parts = np.ones(len(first) - 1, np.int64)
    now = held = 0
    counts = dict(placed.groupBy("cell").count().collect())
    for c in range(len(parts)):
        n = counts.get(c, 0)
        if held and (held + n > block or c % index.grid[1] == 0):
            now, held = now + 1, 0
        first[c] = now
        if n > block:
            parts[c] = -(-n // block)
            now, held = now + parts[c], 0
        else:
            held += n

    def look(batches):
        occupied = np.zeros(len(parts), bool)
        occupied[list(counts)] = True
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                keys, who, cells = [], [], []
                for r, c in enumerate(index.traverse(unit(matrix(part.column("v"))))):
                    c = np.sort(c[occupied[c]])
                    for key in np.unique(first[c]):
                        mine = c[first[c] == key]
                        for p in range(int(parts[mine[0]])):
                            keys.append(int(key) + p)
                            who.append(r)
                            cells.append(mine.astype(np.int32))
                at = pa.array(who, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), part.column("rep").take(at), part.column("v").take(at), pa.array(cells, pa.list_(pa.int32()))], ["block", "rep", "v", "cells"])

    looking, _ = common.written(classes.select("rep", "v").mapInArrow(look, "block long, rep long, v array<double>, cells array<int>"), "looking")
    crowd = looking.groupBy("block").count().withColumn("shares", F.ceil(F.col("count") / block)).select("block", "shares")
    starts = spark.createDataFrame([(c, int(first[c]), int(parts[c])) for c in counts], "cell long, start long, parts long")
    held_in = placed.join(F.broadcast(starts), "cell")  # a row for each cell in use
    within = F.pmod(F.xxhash64("rep"), F.col("parts"))
    held_in = held_in.withColumn("block", F.col("start") + within).join(crowd, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), "rep", "weight", "v", F.array(F.col("cell").cast("int")).alias("cells"), F.lit(True).alias("own"))
    come = looking.join(crowd, "block").select("block", F.pmod(F.xxhash64("rep"), "shares").alias("share"), "rep", F.lit(0).cast("long").alias("weight"), "v", "cells", F.lit(False).alias("own"))

    def compare(key, table):
        own = np.array(table.column("own").to_pylist(), bool)
        x = unit(matrix(table.column("v")))
        rep = table.column("rep").to_numpy()
        weight = table.column("weight").to_numpy()
        cells = table.column("cells").to_pylist()
        inside: dict[int, list[int]] = {}
        for r in np.flatnonzero(own):
            inside.setdefault(cells[r][0], []).append(int(r))
        outside: dict[int, list[int]] = {}
        for r in np.flatnonzero(~own):
            for c in cells[r]:
                if c in inside:
                    outside.setdefault(c, []).append(int(r))
        links, a, b = np.zeros(len(rep), np.int64), [], []
        for c, come_in in outside.items():
            m = np.array(inside[c])
            for at in range(0, len(come_in), 1000):
                v = np.array(come_in[at : at + 1000])
                hit = (x[v] @ x[m].T >= cosine) & (rep[v][:, None] != rep[m][None, :])
                i, j = np.nonzero(hit)
                links[v] += hit @ weight[m]
                a.append(v[i])
                b.append(m[j])
        a, b = (np.concatenate(k) if k else np.empty(0, np.int64) for k in (a, b))
        root = _roots(len(rep), a, b, rep)
        told = (links > 0) | (root != rep)
        return pa.table([pa.array(rep[told]), pa.array(links[told]), pa.array(root[told])], names=["rep", "n", "root"])

    found, _ = common.written(held_in.unionByName(come).groupBy("block", "share").applyInArrow(compare, "rep long, n long, root long"), "found")
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    groups = common.components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")), spark).withColumnRenamed("node", "rep")
    linked = member.join(links, "rep", "left").join(groups, "rep", "left").select("vec_id", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return _result(linked.unionByName(alone.join(member.select("vec_id"), "vec_id", "left_anti")))


def _result(df: DataFrame) -> DataFrame:
    return df.select(common.id_out("vec_id"), "n_links", common.id_out("component_id"), (F.col("vec_id") == F.col("component_id")).alias("kept"))
