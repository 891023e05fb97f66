"""Registered queries over lines: physical numbers, slices, next matches, statements, in files that Spark has written from the tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.operators import carry
from lemmata.queries import query
from lemmata.session import shared_folder, table
from lemmata.sources import records


def _written(spark: SparkSession, sf: str) -> str:
    """A folder of text files with a line for each document, in ascending order of doc_id."""
    path = f"{shared_folder(spark)}/lines-{uuid4().hex}"
    lines = table(spark, sf, "documents").select("doc_id", F.concat_ws("\t", "doc_id", F.md5(F.coalesce("text", F.lit("")))).alias("value"))
    lines.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)
    return path


_LINE_SQL = "l AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, concat_ws(chr(9), doc_id, md5(coalesce(text, ''))) AS value FROM documents)"


@query(f"WITH {_LINE_SQL} SELECT idx, value FROM l")
def physical_lines(spark: SparkSession, sf: str) -> DataFrame:
    return records.read_lines(spark, _written(spark, sf)).select("idx", "value")


@query(f"WITH {_LINE_SQL} SELECT idx, value FROM l WHERE idx >= 25 AND idx < 25 + 100")
def line_slice(spark: SparkSession, sf: str) -> DataFrame:
    return records.slice_rows(records.read_lines(spark, _written(spark, sf)), 25, 100).select("idx", "value")


@query(f"WITH {_LINE_SQL} SELECT idx, CAST(octet_length(encode(value)) AS BIGINT) AS n_bytes, CAST(sum(octet_length(encode(value)) + 1) OVER (ORDER BY idx) - octet_length(encode(value)) - 1 AS BIGINT) AS before FROM l")
def line_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets within files, put together by the sizes of the files before."""
    index = records.line_index(spark, _written(spark, sf))
    sizes = index.groupBy("file").agg(F.sum(F.col("n_bytes") + 1).alias("size"))
    pairs = sizes.alias("f").join(sizes.select(F.col("file").alias("_other"), F.col("size").alias("_size")), F.col("_other") < F.col("f.file"), "left")
    ahead = pairs.groupBy("file").agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("ahead"))
    return index.join(ahead, "file").select("idx", "n_bytes", (F.col("offset") + F.col("ahead")).alias("before"))


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, doc_id, source, n_chars FROM documents")
def indexed_records(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_folder(spark)}/records-{uuid4().hex}"
    records.write_jsonl(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), path, order="doc_id")
    return records.read_indexed(spark, path, "doc_id long, source string, n_chars long")


_LOG = """CASE event_type WHEN 'error' THEN 'Error-[E] at ' || event_id WHEN 'purchase' THEN '"f' || user_id || '.sv", ' || event_id || ': near' ELSE 'note' END"""


@query(f"""WITH l AS (SELECT user_id, event_id, event_type, {_LOG} AS value,
 first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS place FROM events)
SELECT user_id, event_id AS idx, value AS message, CASE WHEN place IS NOT NULL THEN 'f' || user_id || '.sv' END AS file, CAST(place AS INTEGER) AS line FROM l WHERE event_type = 'error'""")
def error_places(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "events").selectExpr("user_id", "event_id as idx", f"{_LOG} as value")
    return records.errors(lines, ("user_id",))


_BATCH = "CASE event_type WHEN 'signup' THEN '# ' || event_id WHEN 'view' THEN 'end ' || event_id || ' ;' ELSE event_type || '  ' || event_id END"


@query(f"""WITH l AS (SELECT user_id, event_id, event_type, {_BATCH} AS value FROM events WHERE event_type <> 'signup'),
s AS (SELECT *, coalesce(sum(CAST(event_type = 'view' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS statement FROM l)
SELECT user_id, CAST(statement AS BIGINT) AS statement, trim(replace(replace(string_agg(value, ' ' ORDER BY event_id), ' ;', ''), '  ', ' ')) AS words FROM s GROUP BY user_id, statement""")
def statement_words(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "events").selectExpr("user_id", "event_id as idx", f"{_BATCH} as value")
    return records.statements(lines, ("user_id",)).select("user_id", "statement", F.array_join("words", " ").alias("words"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_value,
 coalesce(sum(CAST(event_type = 'error' AS INTEGER)) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS errors_before FROM events""")
def carried_events(spark: SparkSession, sf: str) -> DataFrame:
    """One order over the whole table, without a window over it."""
    rows = table(spark, sf, "events").select("event_id", "event_type", "value")
    last = carry.last_value(rows, (), "event_id", F.when(F.col("event_type") == "purchase", F.col("value")), "last_value")
    return carry.count_before(last, (), "event_id", F.col("event_type") == "error", "errors_before").select("event_id", "last_value", "errors_before")
