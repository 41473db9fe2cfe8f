"""Full-text ranking, set similarity, tiers and nearest neighbours, for a whole set of queries at once.

Term statistics are always those of the whole corpus, whatever candidates a query is limited to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as C

#: Ranking parameters, score floor, similarity floor, pool and least cell.
K1, B, EPSILON = 1.5, 0.75, 0.25
MIN_SCORE, SIMILARITY_FLOOR, POOL, MIN_CELL = 0.5, 0.17, 20, 30
#: Rows of a side that is broadcast after it was counted.
BROADCAST_ROWS = 1_000_000


def record_tokens() -> Column:
    """A record's structured fields as tokens: each element once, in order."""
    kinds = F.transform(F.array_sort(F.array_distinct(C.elements_or_none(F.col("elements")))), lambda x: F.concat(F.lit("elem_"), x))
    text = lambda name, value: F.array(F.concat(F.lit(name + "_"), value))
    return F.concat(kinds, text("task", F.coalesce("task_type", F.lit("unknown"))), text("scale", C.scale_bucket(C.atoms(F.col("n_atoms"), F.col("n_sites_index")))), text("charge", F.coalesce(F.col("charge").cast("string"), F.lit("None"))), text("mult", F.coalesce(F.col("multiplicity").cast("string"), F.lit("None"))), text("solvent", F.coalesce(F.nullif("solvent", F.lit("")), F.lit("none"))))


def text_tokens(text: Column) -> Column:
    """Runs of letters in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")


def build_index(docs: DataFrame, tokens: str) -> tuple[DataFrame, DataFrame]:
    """Postings (term, doc_id, tf, dl) and terms (term, idf); docs has doc_id and an array of tokens.

    idf = ln(N - df + 1/2) - ln(df + 1/2); a negative one becomes EPSILON times the mean over terms.
    """
    words = docs.select("doc_id", F.size(tokens).alias("dl"), F.explode(tokens).alias("term"))
    postings = words.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    total = docs.agg(F.count("*").alias("n_docs"))
    raw = postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    terms = raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    return postings, terms


def bm25(docs: DataFrame, queries: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(query_id, doc_id, score) of all pairs that share a term; queries has query_id and tokens. Query
    terms are counted (a repeated one scores twice). For the best documents of each query take bm25_top,
    which makes no row for each pair."""
    asked = queries.select("query_id", F.explode(tokens).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    postings, terms = build_index(docs, tokens)
    average = docs.agg(F.avg(F.size(tokens)).alias("avgdl"))
    terms = asked.join(terms, "term")
    few = F.broadcast(terms) if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else terms
    hits = postings.join(few, "term").crossJoin(F.broadcast(average))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def _sums(asked: list[tuple], part):
    """A function of Arrow batches (id, list of words) and `pick`: for some documents at a time, the sums
    over the words that each shares with each query of weight * part(count, size), as a matrix.

    pick(query ids, ids, sizes, sums, whether any word is shared) returns the (query, id, value) kept.
    """
    import numpy as np
    import pyarrow as pa

    qids = np.array(sorted({a[0] for a in asked}), np.int64)
    place = {t: i for i, t in enumerate(sorted({a[1] for a in asked}))}
    word = np.array([place[a[1]] for a in asked], np.int64)
    order = np.argsort(word, kind="stable")
    asker = np.searchsorted(qids, np.array([a[0] for a in asked], np.int64))[order]
    weight = np.array([a[2] for a in asked], float)[order]
    first = np.searchsorted(word[order], np.arange(len(place) + 1))
    step = max(1, 4_000_000 // max(1, len(qids)))

    def run(batches, pick):
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                ids, lists = batch.column(0).slice(a, step).to_numpy(zero_copy_only=False), batch.column(1).slice(a, step)
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().dictionary_encode()
                known = np.array([place.get(t, -1) for t in flat.dictionary.to_pylist()], np.int64)
                at = known[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.int64)
                doc = np.repeat(np.arange(len(ids)), sizes)[at >= 0]
                pair, count = np.unique(doc * max(1, len(place)) + at[at >= 0], return_counts=True)
                doc, at = pair // max(1, len(place)), pair % max(1, len(place))
                value = part(count, sizes[doc])
                many = first[at + 1] - first[at]
                rows = np.repeat(np.arange(len(at)), many)
                which = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many) + first[at[rows]]
                cell = asker[which] * len(ids) + doc[rows]
                total = np.bincount(cell, weight[which] * value[rows], len(qids) * len(ids)).reshape(len(qids), len(ids))
                met = np.bincount(cell, minlength=total.size).reshape(total.shape) > 0
                q, d, v = pick(qids, ids, sizes, total, met)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(v, pa.float64())], ["query_id", "doc_id", "score"])

    return run


#: Rows of (query, term, weight) that are sent to every task, some 100 bytes each.
SENT_ROWS = 500_000


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, tokens: str = "tokens") -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best documents of each query that share a term with it,
    by the score to 9 places, ties by id. doc_id and query_id are integers.

    Document frequencies are partial counts over each document's distinct terms; documents themselves
    are never shuffled. The queries' weights (counted, few) go to every task, which scores its documents
    in batches as sums over (document, term) and hands on k rows a query and batch. With more weights
    than that the join of `bm25` does the same.
    """
    words = F.array_distinct(tokens)
    n, avgdl = docs.agg(F.count("*"), F.avg(F.size(tokens))).first()
    asked = queries.select("query_id", F.explode(tokens).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    frequency = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = frequency.select("term", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw"))
    weights = raw.join(F.broadcast(asked) if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else asked, "term").crossJoin(F.broadcast(mean)).select("query_id", "term", (F.col("times") * idf).alias("w"))
    got = weights.limit(SENT_ROWS + 1).collect()
    if len(got) > SENT_ROWS:
        w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
        return bm25(docs, queries, tokens).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")
    import numpy as np

    sums = _sums([(r["query_id"], r["term"], r["w"]) for r in got], lambda tf, size: tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / avgdl)))

    def best_of(qids, ids, sizes, total, met):
        rounded = np.where(met, np.round(total, 9), -np.inf)
        if rounded.shape[1] > k:  # all that reach the k-th best, ties included
            rounded[rounded < np.partition(rounded, -k, axis=1)[:, [-k]]] = -np.inf
        q, d = np.nonzero(np.isfinite(rounded))
        order = np.lexsort((ids[d], -rounded[q, d], q))
        q, d = q[order], d[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return qids[q[keep]], ids[d[keep]], total[q[keep], d[keep]]

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens")).where("doc_id is not null")
    best = rows.mapInArrow(lambda batches: sums(batches, best_of), "query_id long, doc_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_then_floor(scored: DataFrame, k: int, floor: float = MIN_SCORE, candidate: Column | None = None) -> DataFrame:
    """The k best of each query, and of those the ones that reach the floor; ties by id."""
    rows = scored if candidate is None else scored.where(candidate)
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).where(F.col("score") >= floor)


def floor_then_top(scored: DataFrame, k: int, floor: float = MIN_SCORE, pool: int = POOL) -> DataFrame:
    """What reaches the floor, and of that the first max(pool, k)."""
    return top_then_floor(scored.where(F.col("score") >= floor), max(pool, k), floor)


def widened(queries: DataFrame, docs: DataFrame, cell: str, wide: str, least: int = MIN_CELL) -> DataFrame:
    """(query_id, doc_id) of documents in a query's cell; in its wider group too if the cell is small."""
    size = docs.groupBy(cell).agg(F.count("*").alias("__n"))
    q = queries.join(size, cell, "left").withColumn("__few", F.coalesce("__n", F.lit(0)) < least).select("query_id", F.col(cell).alias("__cell"), F.col(wide).alias("__wide"), "__few")
    q = F.broadcast(q) if q.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else q
    same = docs.join(q, F.col(cell).eqNullSafe(F.col("__cell"))).select("query_id", "doc_id")
    more = docs.join(q.where("__few"), F.col(wide).eqNullSafe(F.col("__wide"))).select("query_id", "doc_id")
    return same.unionByName(more).distinct()


def tanimoto(a: str, b: str) -> Column:
    """Shared members by all members of two sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def similar_sets(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """(query_id, doc_id, similarity) at least floor, of (query_id, members) against (doc_id, members).

    Ids are integers. Where all queries' members are few enough to be sent to every task, documents stay
    where they are and shared members are counted there; only similar pairs leave. Otherwise sets are
    joined: a set of n members needs one of its n - ceil(floor * n) + 1 rarest ones in any similar set,
    so only these are joined on (prefix filter), and the pairs found are compared whole.
    """
    sent = left.select(F.col("query_id").cast("long"), F.explode(F.array_distinct("members")).alias("m")).where("query_id is not null and m is not null").limit(SENT_ROWS + 1).collect()
    if len(sent) <= SENT_ROWS:
        import numpy as np

        n = {}
        for r in sent:
            n[r["query_id"]] = n.get(r["query_id"], 0) + 1
        sums = _sums([(r["query_id"], r["m"], 1.0) for r in sent], lambda count, size: np.ones(len(count)))

        def similar(qids, ids, sizes, total, met):
            own = np.array([n[q] for q in qids.tolist()], float)
            value = total / np.maximum(own[:, None] + sizes[None, :] - total, 1)
            q, d = np.nonzero(met & (value >= floor))
            return qids[q], ids[d], value[q, d]

        rows = right.select(F.col("doc_id").cast("long"), F.array_distinct("members").alias("members")).where("doc_id is not null and members is not null")
        return rows.mapInArrow(lambda batches: sums(batches, similar), "query_id long, doc_id long, score double").withColumnRenamed("score", "similarity")
    l = left.select("query_id", F.array_distinct("members").alias("a")).where(F.size("a") > 0)
    r = right.select("doc_id", F.array_distinct("members").alias("b")).where(F.size("b") > 0)
    rare = r.select(F.explode("b").alias("m")).groupBy("m").agg(F.count("*").alias("df"))
    wanted = l.select("query_id", F.size("a").alias("n"), F.explode("a").alias("m")).join(rare, "m")
    # members that no document has are the rarest, so they come off the prefix first
    had = wanted.groupBy("query_id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "m"))).alias("found"))
    keep = F.col("n") - F.ceil(F.lit(floor) * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("found"))
    prefix = had.select("query_id", F.explode(F.transform(F.slice("found", 1, F.greatest(keep, F.lit(0)).cast("int")), lambda x: x["m"])).alias("m"))
    prefix = F.broadcast(prefix) if prefix.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else prefix
    met = r.select("doc_id", F.explode("b").alias("m")).join(prefix, "m").select("query_id", "doc_id").distinct()
    pairs = met.join(r, "doc_id").join(F.broadcast(l) if l.limit(20_001).count() <= 20_000 else l, "query_id")
    return pairs.select("query_id", "doc_id", tanimoto("a", "b").alias("similarity")).where(F.col("similarity") >= floor)


def tiers(pool: DataFrame, floor: float = SIMILARITY_FLOOR) -> DataFrame:
    """A pool (query_id, doc_id, rank, similarity) in tiers: similar first by similarity, then those
    without a structure, then those below the floor, each by rank."""
    tier = F.when(F.col("similarity").isNull(), 2).when(F.col("similarity") >= floor, 1).otherwise(3)
    w = Window.partitionBy("query_id").orderBy("tier", F.when(F.col("tier") == 1, -F.round("similarity", 9)), "rank")
    return pool.withColumn("tier", tier).withColumn("place", F.row_number().over(w))


def nearest(queries: DataFrame, points: DataFrame, k: int, block: int = 2000, group: str | None = None) -> DataFrame:
    """(query_id, point_id, rank, distance) of the k nearest points by squared distance, ties by id.

    A point with a query's own id is left out; with `group` (a column of both) so are points of the
    query's group. Queries (a stated set) are dealt to blocks of some `block` rows; every block meets
    every batch of points as a product of matrices, and only k rows a query leave a batch. Distances
    are rounded to 9 places, so that ties don't depend on the order of adding. Rows with null vectors
    or null elements are left out; vectors must have one length.
    """
    import numpy as np
    import pyarrow as pa

    sound = lambda df, v: df.where(F.coalesce(F.forall(v, lambda x: x.isNotNull()), F.lit(False)))
    g = F.col(group).cast("string") if group else F.lit(None).cast("string")
    q = sound(queries.select(F.col("query_id").cast("long"), F.col("q").cast("array<double>"), g.alias("g")).where("query_id is not null"), "q")
    p = sound(points.select(F.col("point_id").cast("long"), F.col("p").cast("array<double>"), g.alias("g")).where("point_id is not null"), "p")
    blocks = max(1, -(-q.count() // block))
    q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    # a few shares of the points, so that a block of queries is many tasks
    shares = max(1, min(1000, p.count() // 50_000))
    left = q.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    right = p.withColumn("share", F.pmod(F.xxhash64("point_id"), F.lit(shares))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def compare(key, one, two):
        at = lambda t, c: t.column(c).to_numpy()
        rows = lambda t, c: np.array(t.column(c).to_pylist(), float).reshape(t.num_rows, -1)
        x, ids, own = rows(one, "q"), at(one, "query_id"), np.array(one.column("g").to_pylist(), object)
        best_d, best_i = np.full((len(x), k), np.inf), np.full((len(x), k), np.iinfo(np.int64).max)
        for a in range(0, two.num_rows if len(x) else 0, 4000):
            part = two.slice(a, 4000)
            y, pid, theirs = rows(part, "p"), at(part, "point_id"), np.array(part.column("g").to_pylist(), object)
            rough = (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None, :]
            out = pid[None, :] == ids[:, None]
            if group:
                out |= theirs[None, :] == own[:, None]
            rough[out] = np.inf
            # all that may be among the k best, then their distances without cancellation
            limit = np.partition(rough, min(k, rough.shape[1]) - 1, axis=1)[:, min(k, rough.shape[1]) - 1]
            i, j = np.nonzero(rough <= (limit + 1e-6 * (1 + np.abs(limit)))[:, None])
            keep = ~out[i, j]
            i, j = i[keep], j[keep]
            d = np.round(((x[i] - y[j]) ** 2).sum(1), 9)
            for r in np.unique(i):
                mine = i == r
                alld, alli = np.concatenate((best_d[r], d[mine])), np.concatenate((best_i[r], pid[j[mine]]))
                order = np.lexsort((alli, alld))[:k]
                best_d[r], best_i[r] = alld[order], alli[order]
        i, j = np.nonzero(np.isfinite(best_d))
        return pa.table([pa.array(ids[i], pa.int64()), pa.array(best_i[i, j], pa.int64()), pa.array(best_d[i, j], pa.float64())], names=["query_id", "point_id", "distance"])

    found = left.groupBy("block", "share").cogroup(right.groupBy("block", "share")).applyInArrow(compare, "query_id long, point_id long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "point_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "point_id", "rank", "distance")
