"""Registered queries on steps of generation: expansion before retrieval, operations and operators, hybrid contexts, flags, explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.functions import text as X
from lemmata.operators import retrieval
from lemmata.plans import generate
from lemmata.queries import query
from lemmata.queries_more import _DIM
from lemmata.queries_retrieval import _DOT, _stores, _vectors
from lemmata.session import cut, table

_EXPANDED = "'stub:' || md5(chr(10) || 'Restate with signal names and timing, then write one assertion: ' || coalesce(text, ''))"


@query(f"""WITH x AS (SELECT item_id, {_EXPANDED} AS expanded FROM benchmark), {_vectors('q', 'x', 'item_id', 'expanded', ', expanded')}, {_vectors('d', 'documents', 'doc_id', 'text', ', text')},
r AS (SELECT item_id, expanded, coalesce(d.text, '') AS content, row_number() OVER (PARTITION BY item_id ORDER BY {_DOT} DESC, doc_id) AS rank FROM q, d)
SELECT item_id, expanded, CAST(rank AS INTEGER) AS rank, md5(content) AS content FROM r WHERE rank <= 3""")
def expanded_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """Items are rewritten, and what they are rewritten to is searched for."""
    asked, store = _stores(spark, sf)
    found = generate.expand_then_retrieve(asked, store, "item_id", generate.Stub(), 3, _DIM)
    return found.select("item_id", "expanded", "rank", F.md5("content").alias("content"))


@query("""WITH a AS (SELECT doc_id, 'stub:' || md5('Name the operations of: ' || coalesce(text, '')) AS operations FROM documents), o AS (SELECT DISTINCT lower(substr(md5(text), 1, 2)) AS op FROM benchmark),
m AS (SELECT doc_id, string_agg(op, ',' ORDER BY op) AS operators FROM a JOIN o ON contains(operations, op) GROUP BY doc_id)
SELECT a.doc_id AS doc_id, operations, coalesce(operators, '') AS operators, 'stub:' || md5('Write one assertion with: ' || operations) AS answer FROM a LEFT JOIN m ON a.doc_id = m.doc_id""")
def operations_and_operators(spark: SparkSession, sf: str) -> DataFrame:
    """Operations of each text, the operators (two signs of each item's digest) in them, and the answer."""
    ops = table(spark, sf, "benchmark").select(F.substring(F.md5("text"), 1, 2).alias("op")).distinct()
    done = generate.operations_then_operators(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", ops, generate.Stub())
    return done.select("doc_id", "operations", F.array_join("operators", ",").alias("operators"), "answer")


@query(f"""WITH {_vectors('q', 'benchmark', 'item_id', 'text', ', text')}, {_vectors('d', 'documents', 'doc_id', 'text', ', text')}, w AS (SELECT DISTINCT n_name AS op FROM nation UNION SELECT DISTINCT r_name FROM region UNION SELECT substr(text, 1, 5) FROM benchmark),
near AS (SELECT item_id, coalesce(d.text, '') AS content, row_number() OVER (PARTITION BY item_id ORDER BY {_DOT} DESC, doc_id) AS rank FROM q, d),
k AS (SELECT item_id, op FROM benchmark JOIN w ON contains(text, op)),
c AS (SELECT item_id, 0 AS part, lpad('' || row_number() OVER (PARTITION BY item_id ORDER BY op), 12, '0') AS rank, op AS content FROM k UNION ALL SELECT item_id, 1, lpad('' || rank, 12, '0'), content FROM near WHERE rank <= 2)
SELECT item_id, count(*) AS n, md5(string_agg(content, chr(10) || chr(10) ORDER BY part, rank)) AS context FROM c GROUP BY item_id""")
def hybrid_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Of each item the words that it holds, then its nearest documents."""
    asked, store = _stores(spark, sf)
    words = table(spark, sf, "nation").select(F.col("n_name").alias("op")).union(table(spark, sf, "region").select("r_name")).union(asked.select(F.substring("text", 1, 5))).distinct()
    held = retrieval.contains_join(asked, "text", words, "op", keep=["item_id"])
    listed = held.groupBy("item_id").agg(F.array_sort(F.collect_set("op")).alias("ops")).select("item_id", F.posexplode("ops").alias("pos", "content"))
    first = listed.select("item_id", (F.col("pos") + 1).alias("rank"), "content")
    both = generate.hybrid(first, cut(generate.retrieve(asked, store, "item_id", 2, _DIM)).select("item_id", "rank", "content"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n\n")
    return both.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.md5(joined).alias("context"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN turn % 2 = 0 ELSE length(text) // 4 >= 100 AND NOT contains(text, 'the') END AS truncated FROM conversations""")
def finish_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Where a finish reason is given it decides, else tokens (a quarter of the characters) and the closing mark."""
    finish = F.when(F.col("turn") % 3 == 0, F.when(F.col("turn") % 2 == 0, "length").otherwise("stop"))
    rows = table(spark, sf, "conversations").withColumn("n", F.floor(F.length("text") / 4)).withColumn("finish", finish)
    return rows.select("conv_id", "turn", X.truncated("text", "n", 100, "the", "finish").alias("truncated"))


_DICTIONARY = """'{"Assertion 1": {"Assertion Explaination": "' || s_name || ' rises", "Signals": ["a"]}, "Assertion 2": {' || CASE WHEN s_suppkey % 2 = 0 THEN '"Assertion Explaination": "then falls"' ELSE '"Signals": []' END || '}}'"""


@query("""SELECT s_suppkey, 'Assertion 1' AS name, s_name || ' rises' AS said FROM supplier UNION ALL SELECT s_suppkey, 'Assertion 2', 'then falls' FROM supplier WHERE s_suppkey % 2 = 0""")
def dictionary_explanations(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").selectExpr("s_suppkey", f"{_DICTIONARY} as d")
    return rows.select("s_suppkey", F.explode(X.explanations_of("d")).alias("name", "said"))
