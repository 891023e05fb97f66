"""Registered queries that hold many operators of the tables against many texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.operators import curate, retrieval
from lemmata.queries import query
from lemmata.session import table

_WORDS_SQL = "w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS op FROM benchmark)"


@query(f"""WITH {_WORDS_SQL}, o AS (SELECT op FROM w WHERE length(op) >= 4)
SELECT op, count(*) AS occurrences, count(*) AS containing, arg_min(doc_id, (length(text), doc_id)) AS shortest FROM documents JOIN o ON contains(text, op) GROUP BY op""")
def keyword_join(spark: SparkSession, sf: str) -> DataFrame:
    words = F.explode(F.regexp_extract_all("text", F.lit("([a-z]+)"), F.lit(1)))
    ops = table(spark, sf, "benchmark").select(words.alias("op")).distinct().where("length(op) >= 4")
    docs = table(spark, sf, "documents").select("doc_id", "text", F.lpad(F.length("text").cast("string"), 12, "0").alias("size"))
    hits = retrieval.contains_join(docs, "text", ops, "op", keep=["doc_id", "size"])
    best = hits.groupBy("op").agg(F.min(F.struct("size", "doc_id"))["doc_id"].alias("shortest"))
    return curate.census(hits.withColumn("pos", F.lit(0)), "op", "doc_id", "pos", "size").drop("example").join(best, "op")


@query(r"""WITH w AS (SELECT item_id, regexp_extract_all(text, '[a-z]+') AS w FROM benchmark), r AS (SELECT item_id, w[1] || '\s+' || w[2][1:3] || '[a-z]*' AS rule FROM w WHERE len(w) > 1)
SELECT item_id, rule, count(*) AS n, min(doc_id) AS first FROM documents JOIN r ON regexp_matches(text, rule) GROUP BY item_id, rule""")
def rule_join(spark: SparkSession, sf: str) -> DataFrame:
    w = F.regexp_extract_all("text", F.lit("([a-z]+)"), F.lit(1))
    rules = table(spark, sf, "benchmark").select("item_id", w.alias("w")).where("size(w) > 1")
    rules = rules.select("item_id", F.concat(F.col("w")[0], F.lit(r"\s+"), F.substring(F.col("w")[1], 1, 3), F.lit("[a-z]*")).alias("rule"))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    hits = retrieval.regex_join(docs, "text", rules, "rule", keep=["doc_id"])
    return hits.groupBy("item_id", "rule").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
