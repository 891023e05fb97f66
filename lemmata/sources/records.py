"""Readers and writers of the corpus: JSON lines, JSON arrays, CSV, reports, design folders, checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lemmata.functions import text as X
from lemmata.operators import carry, curate

CHAT = "messages array<struct<role:string,content:string>>"
INSTRUCTION = "instruction string, input string, output string"
RESULT = "experiment_id string, task_id string, model_name string, response string, ref_solution string, design_rtl string, output_tb string, user_prompt string, cot_response string"
SCORE = "task_id string, syntax double, functionality double, func_relaxed double, jg_output_tail string"


def read_records(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A JSON array, or else JSON lines; told apart by the first character that is not white space."""
    first = spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.trim("value"), 1, 1).alias("c")).head()
    return spark.read.schema(schema).json(path, multiLine=bool(first and first["c"] == "["))


def _placed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines with their file, its split and their place in it, and of each split what stands before it in its file."""
    raw = spark.read.option("lineSep", "\n").text(path)
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    rows = raw.select("value", *meta, F.monotonically_increasing_id().alias("at"))
    splits = rows.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    ahead = splits.select("file", "split", "first", "n", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "bytes")])
    files = splits.groupBy("file").agg(F.sum("n").alias("_n"))  # one row a file
    files = files.select("file", F.coalesce(F.sum("_n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("files_before"))
    return rows, ahead.join(files, "file")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, idx, value) of texts: the line's number in its file and over all files in the order of their names, from 0.

    Numbers come from a count of each split's lines, so files are read in splits and nothing is sorted. Lines end with a line
    feed; a carriage return before it is dropped.
    """
    rows, ahead = _placed(spark, path)
    line = F.col("at") - F.col("first") + F.col("n_before")
    return rows.join(ahead, ["file", "split"]).select("file", line.alias("line"), (line + F.col("files_before")).alias("idx"), F.regexp_replace("value", r"\r$", "").alias("value"))


def line_index(spark: SparkSession, path: str) -> DataFrame:
    """(idx, file, line, offset, n_bytes): where each line of texts begins. Written sorted by idx (`write_index`), a lookup reads one row group."""
    rows, ahead = _placed(spark, path)
    here = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sized = rows.select("file", "split", "at", F.octet_length("value").cast("long").alias("n_bytes"))
    sized = sized.withColumn("_inside", F.coalesce(F.sum(F.col("n_bytes") + 1).over(here), F.lit(0)))
    line = F.col("at") - F.col("first") + F.col("n_before")
    return sized.join(ahead, ["file", "split"]).select((line + F.col("files_before")).alias("idx"), "file", line.alias("line"), (F.col("bytes_before") + F.col("_inside")).alias("offset"), "n_bytes")


def write_index(index: DataFrame, path: str) -> None:
    index.repartitionByRange("idx").sortWithinPartitions("idx").write.mode("overwrite").parquet(path)


def read_record(spark: SparkSession, index: DataFrame, idx: int) -> str:
    """One line by its number: a lookup in the index, then one range of one file."""
    at = lookup(index, "idx", idx).first()
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(at["file"]))
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        stream.seek(at["offset"])
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, at["n_bytes"])).decode().removesuffix("\r")
    finally:
        stream.close()


def slice_rows(rows: DataFrame, start: int = 0, limit: int | None = None, order: str = "idx") -> DataFrame:
    """The rows numbered start to start + limit (exclusive; no limit: to the end), by a filter on their number."""
    some = rows.where(F.col(order) >= start)
    return some if limit is None else some.where(F.col(order) < start + limit)


def read_indexed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with the number of their physical line; blank and broken lines are left out, numbers stay."""
    lines = read_lines(spark, path).where(F.trim("value") != "")
    return lines.select("idx", F.from_json("value", schema).alias("r")).where("r is not null").select("idx", "r.*")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_positional(spark: SparkSession, path: str, fields: int) -> tuple[DataFrame, DataFrame]:
    """Rows with all of the first `fields` columns, and the rejects with their reason."""
    names = [f"c{i}" for i in range(fields)]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).option("multiLine", True).option("escape", '"').csv(path)
    short = F.col(names[-1]).isNull()
    return rows.where(~short), rows.where(short).withColumn("reason", F.lit(f"fewer than {fields} fields"))


def read_keyed(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Records by key, the last of equal keys; a path that is not there reads as no records."""
    try:
        lines = read_indexed(spark, path, schema)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return curate.last_wins(lines, key, "idx").drop("idx")


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    found = rows.where(F.col(key) == value)
    if found.isEmpty():
        raise KeyError(f"no record with {key} = {value!r}")
    return found


def read_designs(spark: SparkSession, glob: str, only: str | None = None) -> DataFrame:
    """(design, file, method, text): files of design folders; a name filter prunes before files are opened."""
    files = spark.read.text(glob, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    named = files.select(F.element_at(F.split("path", "/"), -2).alias("design"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("value").alias("text"))
    named = named.where(F.contains("design", F.lit(only))) if only else named
    return named.withColumn("method", F.regexp_extract("file", r"_([A-Za-z0-9-]+(?:-[A-Za-z0-9.]+)*)\.\w+$", 1))


def design_table(files: DataFrame) -> DataFrame:
    """A row for each design with its code, assertions and script."""
    role = F.when(F.endswith("file", F.lit("_assertion.sv")), "assertions").when(F.endswith("file", F.lit(".tcl")), "script").when(F.col("file") == F.concat("design", F.lit(".sv")), "code")
    return files.withColumn("role", role).where("role is not null").groupBy("design").pivot("role", ["code", "assertions", "script"]).agg(F.first("text"))


def read_reports(spark: SparkSession, glob: str) -> DataFrame:
    """Rows of proof reports: path, module, number, result, engine, bound, seconds."""
    lines = spark.read.text(glob).withColumn("path", F.col("_metadata.file_path"))
    return lines.select("path", X.report_row("value").alias("r")).where("r is not null").select("path", "r.*")


def statements(lines: DataFrame, part: tuple[str, ...] = ()) -> DataFrame:
    """Statements of batch files (`part`, idx, value): comments skipped, lines joined up to the one that ends in `;`; (`part`, statement, words)."""
    live = lines.where((F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit("#")))
    grouped = carry.count_before(live, part, "idx", F.endswith(F.rtrim("value"), F.lit(";")), "statement")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.trim("value").alias("v")))), lambda x: x["v"]), " ")
    text = F.regexp_replace(joined, r";\s*$", "")
    return grouped.groupBy(*part, "statement").agg(F.filter(F.split(text, r"\s+"), lambda x: x != "").alias("words"))


def errors(lines: DataFrame, part: tuple[str, ...] = ()) -> DataFrame:
    """(`part`, idx, message, file, line): each error line of logs with the first place named at or after it in its log."""
    named = F.regexp_extract("value", r'"([^"]+)",\s*(\d+)', 1)
    row = F.regexp_extract("value", r'"([^"]+)",\s*(\d+)', 2)
    place = F.when(named != "", F.struct(named.alias("file"), row.cast("int").alias("line")))
    seen = carry.next_value(lines, part, "idx", place, "_place")
    return seen.where(F.col("value").rlike("^Error")).select(*part, "idx", F.col("value").alias("message"), "_place.file", "_place.line")


def comment_out(source: DataFrame, bad: DataFrame) -> DataFrame:
    """Source lines (file, line, value) with those named in `bad` commented out."""
    hit = bad.select("file", "line").distinct().withColumn("_bad", F.lit(True))
    return source.join(hit, ["file", "line"], "left").withColumn("value", F.when(F.col("_bad"), F.concat(F.lit("// "), "value")).otherwise(F.col("value"))).drop("_bad")


# sinks


def write_jsonl(rows: DataFrame, path: str, order: str | None = None) -> None:
    """JSON lines; with an order, range-partitioned by it, so the files in name order are sorted."""
    out = rows if order is None else rows.repartitionByRange(order).sortWithinPartitions(order)
    out.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_checkpoint(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("ignoreNullFields", False).json(path)


def manifest(sample: DataFrame, source: str, seed: int, pool: int) -> DataFrame:
    """The sample's document, one row: source, seed, sample_size, eligible_pool_size, records. For samples, which are bounded."""
    records = F.array_sort(F.collect_list(F.struct("index", "sva")))
    return sample.agg(records.alias("records")).select(F.to_json(F.struct(F.lit(source).alias("source"), F.lit(seed).alias("seed"), F.size("records").alias("sample_size"), F.lit(pool).alias("eligible_pool_size"), "records")).alias("value"))


def write_modules(texts: DataFrame, column: str, path: str) -> None:
    """A folder for each module named in the texts, with its source."""
    each = texts.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?s)(\bmodule\b.*?\bendmodule\b)"), F.lit(1))).alias("value"))
    each.withColumn("module", X.module_name("value")).where("module is not null").write.mode("overwrite").partitionBy("module").text(path)


def missing(index: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """Count and first example of the names of an index that no file has."""
    gone = index.join(files.select(name).distinct(), name, "left_anti")
    return gone.agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("example"))


def design_files(rows: DataFrame, order: str, line: str) -> DataFrame:
    """(method, file, text): the file of each design and method, named after both, its lines in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n")
    return rows.groupBy("method", "design").agg(text.alias("text")).select("method", F.concat("design", F.lit("_"), "method", F.lit(".sv")).alias("file"), "text")
