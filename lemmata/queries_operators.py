"""Registered queries on the operator table: lookups of the labels of the tables' assertions, explanations from templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.plans import operators, sva
from lemmata.queries import _FILL, _MEANINGS, _SHAPES_SQL, _assertions, query

#: operators, with the numbers of their labels left open, and their templates
_TABLE = (
    ("|->", None, "whenever {a}, {b} in the same cycle"), ("|=>", None, "whenever {a}, {b} in the next cycle"), ("##N", "{n} cycles later {a}", "{a}, then {n} cycles later {b}"),
    ("##[M:N]", "{m} to {n} cycles later {a}", "{a}, then {m} to {n} cycles later {b}"), ("!==", None, "{a} is not identical to {b}"), ("&&", None, "{a} and {b}"), ("!", "{a} is false", None), ("$rose", "{a} rises", None),
    ("$past", "the previous {a}", "{a} of {b} cycles before"), ("s_eventually", "eventually {a}", None), ("and", None, "both {a} and {b}"), ("until", None, "{a} until {b}"), ("not", "it is not the case that {a}", None),
)


def _table(spark: SparkSession) -> DataFrame:
    rows = [(op, i, unary, binary) for i, (op, unary, binary) in enumerate(_TABLE)]
    return spark.createDataFrame(rows, "op string, rank int, template_unary string, template_binary string")


def _nodes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    texts = _assertions(spark, sf).select("sva").distinct().withColumn("key", F.xxhash64("sva"))
    return texts, sva.nodes(texts, "key", "sva", ("node_id", "parent_id", "child_pos", "type", "label")).where("status = 'ok'")


@query(f"""WITH {_SHAPES_SQL}, o AS (SELECT DISTINCT sva, node_id, label FROM nd WHERE type = 'operator')
SELECT label, CASE WHEN label LIKE '##[%' THEN '##[M:N]' WHEN label LIKE '##%' THEN '##N' ELSE label END AS op, CASE WHEN label LIKE '##[%' THEN label[4] END AS m, CASE WHEN label LIKE '##[%' THEN label[6] WHEN label LIKE '##%' THEN label[3:] END AS n, count(*) AS uses FROM o GROUP BY label""")
def operator_lookup(spark: SparkSession, sf: str) -> DataFrame:
    labels = _nodes(spark, sf)[1].where("type = 'operator'")
    found = operators.lookup(labels, "label", _table(spark)).select("label", "op", "m", "n")
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("uses")).join(found, "label").select("label", "op", "m", "n", "uses")


@query(f"""WITH {_SHAPES_SQL}, {_MEANINGS}, sd AS (SELECT sva, any_value(shape) AS shape, any_value(r) AS r, any_value(p) AS p, any_value(q) AS q FROM sh GROUP BY sva)
SELECT sva, {_FILL("replace(explanation, 'of P', 'of ' || p)")} AS explanation FROM sd JOIN m ON sd.shape = m.shape""")
def table_explanations(spark: SparkSession, sf: str) -> DataFrame:
    texts, nodes = _nodes(spark, sf)
    said = operators.explanations(nodes, _table(spark)).where("parent_id is null")
    return texts.join(said, "key").select("sva", F.col("piece").alias("explanation"))
