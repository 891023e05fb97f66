"""Registered queries on page blocks and windows of context that until now only tests held."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.operators import blocks
from lemmata.queries import query
from lemmata.session import table

_BOX = "CAST(l_suppkey % 3 * 50 AS DOUBLE) AS x0, CAST(l_linenumber * 16 + l_partkey % 3 * 4 AS DOUBLE) AS y0, CAST(l_suppkey % 3 * 50 + 60 + l_partkey % 40 AS DOUBLE) AS x1, CAST(l_linenumber * 16 + l_partkey % 3 * 4 + 8 AS DOUBLE) AS y1"


@query(f"""WITH RECURSIVE b AS (SELECT l_orderkey AS page, 'c' || l_partkey AS content, {_BOX} FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y0, x0, x1, y1, content) AS n FROM b),
m AS (SELECT page, n, 0 AS block, x0, y0, x1, y1, content FROM o WHERE n = 1
 UNION ALL SELECT page, n, block + CAST(NOT near AS INTEGER), CASE WHEN near THEN least(x0, bx0) ELSE bx0 END, CASE WHEN near THEN least(y0, by0) ELSE by0 END, CASE WHEN near THEN greatest(x1, bx1) ELSE bx1 END, CASE WHEN near THEN greatest(y1, by1) ELSE by1 END,
  CASE WHEN near THEN content || chr(10) || bc ELSE bc END FROM (SELECT m.page, o.n, m.block, m.x0, m.y0, m.x1, m.y1, m.content, o.x0 AS bx0, o.y0 AS by0, o.x1 AS bx1, o.y1 AS by1, o.content AS bc,
   o.y0 - m.y1 <= 10 AND greatest(0, least(m.x1, o.x1) - greatest(m.x0, o.x0)) >= least(m.x1 - m.x0, o.x1 - o.x0) * 0.3 AS near FROM m JOIN o ON m.page = o.page AND o.n = m.n + 1))
SELECT page, CAST(block AS INTEGER) AS block, arg_max(x0, n) AS x0, arg_max(y0, n) AS y0, arg_max(x1, n) AS x1, arg_max(y1, n) AS y1, md5(arg_max(content, n)) AS content FROM m GROUP BY page, block""")
def close_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of a page in reading order, merged where one is close below another and overlaps it."""
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey as page", "'c' || l_partkey as content", *_BOX.split(", "))
    merged = blocks.merge_close(rows.select("page", F.array("x0", "y0", "x1", "y1").alias("bbox"), "content"), ["page"])
    return merged.select("page", F.col("block").cast("int").alias("block"), *[F.col("bbox")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))], F.md5("content").alias("content"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Set |```verilog|assign y =|```| ' || p_name WHEN 1 THEN '```verilog|module m; ' || p_name || ' endmodule|```' ELSE p_name END AS shown FROM part""")
def inline_fences(spark: SparkSession, sf: str) -> DataFrame:
    line = F.expr("CASE p_size % 3 WHEN 0 THEN 'Set assign y = ' || p_name WHEN 1 THEN 'module m; ' || p_name || ' endmodule' ELSE p_name END")
    return table(spark, sf, "part").select("p_partkey", F.array_join(blocks.fenced_lines(line), "|").alias("shown"))


@query(r"""WITH t AS (SELECT doc_id, text, length(text) // 2 AS a, length(text) // 2 + 5 AS z, greatest(0, length(text) // 2 - 200) AS near, least(length(text), length(text) // 2 + 205) AS far FROM documents WHERE length(text) > 20),
w AS (SELECT doc_id, text, near - length(regexp_extract(reverse(left(text, near)), '^[^.!?\n]*')) AS b, far + length(regexp_extract(substr(text, far + 1), '^[^.!?\n]*')) AS e FROM t)
SELECT doc_id, md5(regexp_replace(substr(text, b + 1, e - b), '^\s+|\s+$', '', 'g')) AS digest FROM w""")
def sentence_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Two hundred characters on either side of a span, grown to sentence ends."""
    rows = table(spark, sf, "documents").where(F.length("text") > 20).withColumn("a", F.floor(F.length("text") / 2).cast("int"))
    return rows.select("doc_id", F.md5(blocks.sentence_window("text", "a", F.col("a") + 5, 200)).alias("digest"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 4 = 3 THEN 'text' ELSE 'code' END AS kind, CASE WHEN l_partkey % 4 = 2 THEN 'code' WHEN l_partkey % 4 = 3 THEN 'text' ELSE 'code' END AS exempted,
 CASE WHEN l_partkey % 4 = 3 THEN 'a b c' || l_suppkey ELSE 'a b' || chr(10) || 'c' || l_suppkey END AS content FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey % 4 <> 2)
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'text', 'code', 'a b ut' || l_suppkey FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey % 4 = 2)""")
def block_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of blocks by font with and without an exempt text, and their texts without number lines."""
    span = lambda text, font: F.struct(text.alias("text"), F.lit(font).alias("font"))
    line = lambda *spans: F.struct(F.array(*spans).alias("spans"))
    last = lambda mark, font: line(span(F.concat(F.lit(mark), F.col("l_suppkey").cast("string")), font))
    first, number = line(span(F.lit(" a"), "Courier"), span(F.lit(" b "), "DejaVuSansMono")), line(span(F.lit(" 12 "), "Times"))
    made = F.when(F.col("l_partkey") % 4 == 3, F.array(first, number, last("c", "Times"))).when(F.col("l_partkey") % 4 == 2, F.array(first, number, last("ut", "Times"))).otherwise(F.array(first, number, last("c", "Menlo")))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct().withColumn("lines", made)
    kind = blocks.block_type("lines")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", kind.alias("kind"), blocks.block_type("lines", "ut").alias("exempted"), blocks.block_text(blocks.without_numbers("lines"), kind).alias("content"))
