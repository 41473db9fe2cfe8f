"""Round trips through text formats, read back strictly or leniently."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..determinism import uniform_sql
from ..registry import query, table
from ..sources import records as S


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="sievewright-")  # one process: what it sees is shared
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/sievewright-{name}-{uuid.uuid4().hex}"

    def clear():
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may have ended
            return

    atexit.register(clear)
    return path


@query("SELECT event_id, user_id, value FROM events WHERE event_id % 10 <> 3")
def q_scan_lenient(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines, a tenth of them malformed, which are dropped."""
    line = F.to_json(F.struct("event_id", "user_id", "value"))
    path = scratch(spark, "lines")
    table(spark, sf, "events").select(F.when(F.col("event_id") % 10 == 3, F.lit('{"event_id": ')).otherwise(line).alias("value")).write.text(path)
    return S.read_lenient(spark, [path, path + "-none"], "event_id long, user_id long, value double")


@query("SELECT p_partkey, p_name, p_size FROM part")
def q_sink_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "csv")
    S.write_csv(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), path)
    return spark.read.schema("p_partkey long, p_name string, p_size int").option("header", True).csv(path)


@query("SELECT 's' || l_partkey AS name, 'set' || l_linenumber AS setting, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END AS energy FROM lineitem WHERE l_linenumber <> 3")
def q_scan_energy_dump(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of three fields; ERROR is null and lines with another number of fields go."""
    name, setting = F.concat(F.lit("s"), F.col("l_partkey").cast("string")), F.concat(F.lit("set"), F.col("l_linenumber").cast("string"))
    told = F.when(F.col("l_linenumber") == 2, "ERROR").otherwise(F.col("l_quantity").cast("string"))
    line = F.when(F.col("l_linenumber") == 3, F.concat(name, F.lit("|"), setting)).otherwise(F.concat(name, F.lit(" | "), setting, F.lit("|"), told))
    path = scratch(spark, "dump")
    table(spark, sf, "lineitem").select(line.alias("value")).write.text(path)
    return S.energy_lines(spark.read.text(path))


@query("SELECT conv_id, json_extract_string(j, '$.n') AS n FROM (SELECT conv_id, '{\"n\": ' || length(text) || '}' AS j FROM (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1))")
def q_scan_targets(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON in the first assistant turn of chat records."""
    c = table(spark, sf, "conversations")
    content = F.when(F.col("role") == "assistant", F.concat(F.lit('{"n": "'), F.length("text").cast("string"), F.lit('"}'))).otherwise(F.lit("not json"))
    chats = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", content.alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    return chats.select("conv_id", S.chat_targets(F.col("messages"), "n string")["n"].alias("n")).where("n is not null")


@query("SELECT p_partkey, 2 AS n_atoms, 'H' AS last_symbol, round(CAST(p_size AS DOUBLE), 3) AS x FROM part")
def q_scan_xyz(spark: SparkSession, sf: str) -> DataFrame:
    """Atoms of XYZ texts, with a header and without; of trajectories the last frame."""
    tail = F.concat(F.lit("O 0.0 0.0 0.0\nH "), F.format_string("%.3f", F.col("p_size") * F.lit(1.0)), F.lit(" 0.0 1.0"))
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("# note\n"), tail)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("2\ncomment\n"), tail)).otherwise(S.last_frame(F.concat(F.lit("1\nfirst\nC 9 9 9\n2\nsecond\n"), tail, F.lit("\n"))))
    a = S.atoms_of(text)
    return table(spark, sf, "part").select("p_partkey", a.alias("a")).select("p_partkey", F.size("a").alias("n_atoms"), F.element_at("a", -1)["symbol"].alias("last_symbol"), F.round(F.element_at("a", -1)["x"], 3).alias("x"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q_stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The stream's windowed sums (beyond the reference), run over the table as a batch."""
    from ..streaming.events import windowed

    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed(e, "6 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT p_partkey FROM part ORDER BY " + uniform_sql(21, "p_partkey") + ", p_partkey LIMIT 25)")
def q_scan_csv_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sample of a CSV file's rows: the feature is its size."""
    path = scratch(spark, "csv")
    S.write_csv(table(spark, sf, "part").select("p_partkey", "p_name"), path)
    return S.csv_sample(spark, path, "p_partkey long, p_name string", "p_partkey", 25, 21)


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 2 THEN NULL WHEN n_nationkey % 3 = 0 THEN 'own ' || n_nationkey ELSE 'last ' || n_nationkey END AS text FROM nation")
def q_scan_text_file(spark: SparkSession, sf: str) -> DataFrame:
    """A job's own text file, else the last one of its folder by name."""
    n = table(spark, sf, "nation").select("n_nationkey")
    k = F.col("n_nationkey").cast("string")
    file = lambda name, text: F.struct(F.concat(F.lit("job"), k).alias("folder"), name.alias("stem"), F.concat(F.lit(text), k).alias("text"))
    a, b, own = file(F.lit("a"), "first "), file(F.lit("b"), "last "), file(F.concat(F.lit("label"), k), "own ")
    held = F.when(F.col("n_nationkey") % 3 == 0, F.array(a, own, b)).when(F.col("n_nationkey") % 3 == 1, F.array(a, b))
    files = n.select(F.inline(held))
    jobs = n.select("n_nationkey", F.concat(F.lit("job"), k).alias("folder"), F.concat(F.lit("label"), k).alias("label"))
    return S.text_of(jobs, files).select("n_nationkey", "text")
