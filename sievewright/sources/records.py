"""Reading and writing records: JSON lines strict or lenient, CSV, delimited and whole text, indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a method record.
METHOD_RECORD = (
    "entry_id STRING, upload_id STRING, source_code STRING, program_version STRING, formula STRING, smiles STRING, n_atoms INT, n_sites_index INT, elements ARRAY<STRING>, charge INT, multiplicity INT, has_tm BOOLEAN, is_open_shell BOOLEAN, system_type STRING, task_type STRING, method_family STRING, functional STRING, basis STRING, ri_approx STRING, aux_basis STRING, grid_level INT, final_grid_level INT, dispersion STRING, abc_correction BOOLEAN, scf_convergence STRING, relativistic STRING, solvent_model STRING, solvent STRING, nroots INT, casscf_nel INT, casscf_norb INT, cbs_scheme STRING, specialist_cell STRING, parse_warnings ARRAY<STRING>, unknown_tokens ARRAY<STRING>"
)


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that are there, asked of the store they are in."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = [(p, jvm.org.apache.hadoop.fs.Path(p)) for p in paths]
    return [p for p, path in where if path.getFileSystem(conf).globStatus(path)]


def read_strict(spark: SparkSession, paths: list[str], schema: str = METHOD_RECORD) -> DataFrame:
    """JSON lines; a missing file or a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def read_lenient(spark: SparkSession, paths: list[str], schema: str = METHOD_RECORD) -> DataFrame:
    """JSON lines; missing files, malformed and blank lines are skipped. No file: no rows."""
    found = existing(spark, paths)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(found)


def pool(spark: SparkSession, paths: list[str], cap: int | None = 50, excluded=("LDA",), excluded_basis=("GEN", "GENECP", "CHKBAS", "CHECKPOINT"), shared_upload: str = "tmQM", buckets: int = 50, seed: int = 0) -> DataFrame:
    """Records of several files, filtered and then capped by upload. An upload id that all records of a
    source share is replaced by buckets of the entry id first, or the cap would swallow the source."""
    from ..determinism import sha1_bucket
    from ..operators.sampling import cap as capped

    rows = read_strict(spark, paths)
    bucket = F.concat(F.lit(f"{shared_upload}_batch_"), F.lpad(sha1_bucket(F.coalesce("entry_id", F.lit("")), buckets).cast("string"), 2, "0"))
    rows = rows.withColumn("upload_id", F.when(F.col("upload_id") == shared_upload, bucket).otherwise(F.col("upload_id")))
    rows = rows.where(F.coalesce(~F.col("functional").isin(*excluded), F.lit(True)) if excluded else F.lit(True))
    rows = rows.where(~F.upper(F.trim(F.coalesce("basis", F.lit("")))).isin(*excluded_basis) if excluded_basis else F.lit(True))
    return rows if cap is None else capped(rows, ["upload_id"], "entry_id", cap, seed)


def chat_targets(messages: Column, schema: str) -> Column:
    """The JSON in the first assistant turn of a chat record; null if there is none or it is malformed."""
    said = F.filter(messages, lambda m: m["role"] == "assistant")
    return F.from_json(F.try_element_at(said, F.lit(1))["content"], schema, {"mode": "PERMISSIVE"})


def entry_ids(df: DataFrame) -> DataFrame:
    return df.select(F.col("metadata.entry_id").alias("entry_id"))


def energy_lines(text: DataFrame) -> DataFrame:
    """name, setting, energy of lines with three fields parted by |; ERROR is null, other lines go."""
    part = F.split("value", r"\|")
    rows = text.where(F.size(part) == 3).select(*(F.trim(part[i]).alias(n) for i, n in enumerate(("name", "setting", "told"))))
    return rows.select("name", "setting", F.col("told").try_cast("double").alias("energy"))


def whole_texts(spark: SparkSession, folder: str, pattern: str = "*.out", most_bytes: int | None = None) -> DataFrame:
    """path, stem, length, text of each file below a folder; bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    if most_bytes is not None:
        files = files.where(F.col("length") <= most_bytes)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "length", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def batch(manifest: DataFrame, files: DataFrame, inner: bool = False) -> DataFrame:
    """A manifest (stem, ...) with the files it names; without one the status is missing, or (inner) the row goes."""
    rows = manifest.join(files.select("stem", "text"), "stem", "inner" if inner else "left")
    return rows if inner else rows.withColumn("status", F.when(F.col("text").isNull(), "missing").otherwise("found"))


def newest(spark: SparkSession, pattern: str) -> str | None:
    """The last path of a pattern by name; names carry their time."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return max((str(f.getPath().toString()) for f in found or []), default=None)


def atoms_of(xyz: Column) -> Column:
    """(symbol, x, y, z) of an XYZ text with or without its two header lines; comments are dropped."""
    lines = F.split(xyz, "\n")
    headed = F.rlike(F.trim(lines[0]), F.lit(r"^\d+$"))
    body = F.when(headed, F.slice(lines, 3, 1_000_000)).otherwise(F.filter(lines, lambda x: ~F.rlike(F.trim(x), F.lit("^(#|!|//)"))))
    pattern = r"^\s*([A-Za-z]+)\s+(\S+)\s+(\S+)\s+(\S+)"
    rows = F.filter(body, lambda x: F.rlike(x, F.lit(pattern)))
    return F.transform(rows, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("symbol"), *(F.regexp_extract(x, pattern, i).try_cast("double").alias(n) for i, n in ((2, "x"), (3, "y"), (4, "z")))))


def last_frame(text: Column) -> Column:
    """The last frame of a trajectory: from the last line that is a count alone and has that many lines after it."""
    lines = F.split(F.rtrim(text), "\n")
    starts = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.rlike(F.trim(F.element_at(lines, i)), F.lit(r"^\d+$")) & (i + 1 + F.trim(F.element_at(lines, i)).try_cast("int") <= F.size(lines)))
    at = F.try_element_at(starts, F.lit(-1))
    return F.when(at.isNotNull(), F.array_join(F.slice(lines, at, F.trim(F.element_at(lines, at)).try_cast("int") + 2), "\n"))


def write_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_index(postings: DataFrame, terms: DataFrame, path: str) -> None:
    """Postings laid out by term, so a query reads the files of its terms' range only."""
    postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.parquet(f"{path}/postings")
    terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms")


def report(df: DataFrame, title: str, most_rows: int = 1000) -> str:
    """A small result as Markdown; larger ones are refused."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", r"\|") for c in cells) + " |"
    return "\n".join([f"# {title}", "", line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in rows)]) + "\n"


def csv_sample(spark: SparkSession, path: str, schema: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of a CSV file with a header, those with the least draws of their key; all if there are fewer."""
    from ..operators.sampling import reservoir

    return reservoir(spark.read.schema(schema).option("header", True).csv(path), key, n, seed)


def text_of(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """jobs (folder, label, ...) with the text of the file in the folder that has the label as its stem,
    else of the last one by stem; null if the folder has none. files: folder, stem, text."""
    last = files.groupBy("folder").agg(F.max_by("text", "stem").alias("__last"))
    own = files.select("folder", F.col("stem").alias("label"), F.col("text").alias("__own"))
    rows = jobs.join(own, ["folder", "label"], "left").join(last, "folder", "left")
    return rows.select(*(F.col(c) for c in jobs.columns), F.coalesce("__own", "__last").alias("text"))


def write_report(spark: SparkSession, df: DataFrame, folder: str, title: str, most_rows: int = 1000) -> None:
    """A small result as JSON lines and as Markdown in a folder of the store."""
    text = report(df, title, most_rows)
    df.coalesce(1).write.mode("overwrite").json(f"{folder}/json")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/markdown")


def write_coverage(coverage: DataFrame, path: str) -> None:
    """A coverage record (one row) as one line of JSON."""
    coverage.coalesce(1).write.mode("overwrite").json(path)
