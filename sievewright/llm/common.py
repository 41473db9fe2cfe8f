"""What the training-data operators share: document keys, the shared scratch folder, components.

Rules that hold for every operator here unless its docstring says otherwise
--------------------------------------------------------------------------
* Only the named columns are read; further columns, whatever their names, are ignored.
* A null text counts as the empty text.
* A null id is one id like any other; it sorts first and comes back as null.
* Rows that repeat an id are one document: the one with the smallest non-null text.
* Empty tables give empty results with the same schema.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside the operators; it sorts before all others.
NULL_ID = -(2**63)

_left: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, whose Python need not have it, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    file = Path(folder) / f"{package.name}.zip"
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(file))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is set a session of one process gets a folder of its
    own (tests); a cluster's is refused, as its machines share no folder that could be guessed."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="sievewright-")  # one process: what it sees is shared
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is left there goes when the driver ends."""
    path = f"{scratch_root(spark)}/sievewright-{name}-{uuid.uuid4().hex}"
    if not _left:
        atexit.register(clear_scratch)
    _left.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear_scratch() -> None:
    while _left:
        spark, path = _left.pop()
        try:
            delete(spark, path)
        except Exception:  # the session may have ended before  # noqa: BLE001
            return


def written(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """df as a table written to the shared folder, and its path. It cuts lineage and outlives executors."""
    ship(df.sparkSession)
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, mb: int):
    """What runs inside hands Python at most so many MB (or one row) at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, f"{mb << 20}b")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def input_mb(df: DataFrame) -> float:
    """The optimizer's estimate of a table's size; only partition counts follow from it. Where it has
    none (it then says some exabytes), 2 KB a row."""
    size = float(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) / 1e6
    return size if size < 1e12 else df.count() * 2e-3


def buckets(df: DataFrame, mb_each: float, least: int = 12) -> int:
    """How many buckets keep each near mb_each of input."""
    return int(max(least, input_mb(df) / mb_each))


#: Partitions of a shuffle by bucket. More buckets than that share partitions: a task takes several,
#: one after another, so the size of what is in memory at once stays that of a bucket.
MOST_PARTITIONS = 100_000


def by_bucket(df: DataFrame, n_buckets: int) -> DataFrame:
    """df dealt by its column bucket, whose values are homes(n_buckets)."""
    return df.repartition(min(n_buckets, MOST_PARTITIONS), "bucket")


def homes(n_buckets: int) -> np.ndarray:
    """A number for each bucket. Spark deals rows by a hash of the number, which puts several buckets
    into some partitions and none into others; these are numbers that go to partitions of their own
    (Murmur3 of a long, seed 42), the same share of them to each where there are more buckets."""
    parts = min(n_buckets, MOST_PARTITIONS)
    rounds = -(-n_buckets // parts)
    out, have, start = np.zeros((rounds, parts), np.int64), np.zeros(parts, np.int64), 0
    u = np.uint32

    def turned(x, r):
        return (x << u(r)) | (x >> u(32 - r))

    def mixed(h, k):
        k = turned(k * u(0xCC9E2D51), 15) * u(0x1B873593)
        return turned(h ^ k, 13) * u(5) + u(0xE6546B64)

    while have.min() < rounds:
        number = np.arange(start, start + 4 * parts + 64, dtype=np.int64)
        start += len(number)
        h = mixed(mixed(np.full(len(number), 42, u), (number & 0xFFFFFFFF).astype(u)), (number >> 32).astype(u)) ^ u(8)
        h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
        h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
        where = (h ^ (h >> u(16))).view(np.int32).astype(np.int64) % parts
        for n, w in zip(number.tolist(), where.tolist()):
            if have[w] < rounds:
                out[have[w], w] = n
                have[w] += 1
    return out.ravel()[:n_buckets]


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, changed where df has such columns already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame, names: list[str] | None = None) -> list[Column]:
    """Columns by their literal names, dots included."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in (df.columns if names is None else names)]


#: Up to so many ids (8 bytes each) are broadcast.
BROADCAST_IDS = 2_000_000


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is not among ids (one column, NULL_ID or null for null), with all their columns."""
    (name,) = unused(docs, "__gone")
    gone, _ = written(ids.select(F.coalesce(F.col(ids.columns[0]).cast("long"), F.lit(NULL_ID)).alias(name)).distinct(), "gone")
    right = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(right, F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)) == F.col(name), "left_anti")


def one_row_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row for each id: the one whose text counts (see above), of such rows the one with
    the least values as JSON. Rows that share an id are reduced before they are shuffled."""
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id")
    if not docs.select(ident).groupBy("id").count().where("count > 1").limit(1).count():
        return docs
    row = F.struct(*columns_of(docs))
    order = F.struct(F.col(text_col).isNull(), F.col(text_col).cast("string"), F.to_json(row))
    best = docs.select(ident, row.alias("row"), order.alias("order")).groupBy("id").agg(F.min_by("row", "order").alias("row"))
    return best.select("row.*").toDF(*docs.columns)


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (never null, see NULL_ID) and text (may be null), one row for each id.

    Whether ids repeat is found by a count over the id column alone; only then are texts reduced.
    """
    ship(df.sparkSession)
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"))
    return rows


def id_out(col: str = "doc_id"):
    """The id as it came in."""
    return F.nullif(F.col(col), F.lit(NULL_ID)).alias(col)


def components(edges: DataFrame, spark: SparkSession, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges (a, b): component is the smallest node reachable.

    Alternates large-star and small-star steps: each node links its larger neighbours, then its
    smaller ones, to the least node it sees. Each round is written to the shared folder, so lineage
    stays short and a lost executor costs a re-read. The number of edges never grows by more than
    the number of nodes, whatever the degrees.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now, path = written(now, "edges")
    for _ in range(rounds):
        # done when each node has one smaller neighbour, which has none
        roles = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        roles = roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not roles.where("up > 1 or up = 1 and down = 1").limit(1).count():
            break
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct().select(F.col("a").alias("u"), F.col("b").alias("v"))
        after, new = written(after, "edges")
        delete(spark, path)
        now, path = after, new
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    members = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots.join(members.select("node"), "node", "left_anti"))
