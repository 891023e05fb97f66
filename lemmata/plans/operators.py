"""Operators looked up in a table, and explanations composed from its templates bottom-up.

The table comes from a file (`load`) or is a frame: op, template_unary, template_binary and any further columns. A name with the
places M or N (`##N`, `always[M:N]`) stands for every label with numbers there; from it the expression is made that such labels match.
Labels are looked up once each: by name, else by the expression of least rank.

Defined cases: a label that nothing matches has no operator, and its explanation is a call in words; a null label matches
nothing; templates have the places {a}, {b} (operands) and {m}, {n} (numbers).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.functions import text as X
from lemmata.operators import retrieval
from lemmata.session import cut

#: fields of a table's entries that are read, where they are there
FIELDS = ("type", "natural_langage_explanation", "example_usgae", "template_unary", "template_binary")


def load(spark: SparkSession, path: str) -> DataFrame:
    """(op, rank, ...) of a JSON file: a map from operators to their fields, in the order of the file."""
    entry = ", ".join(f"{f}: string" for f in FIELDS)
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, struct<{entry}>>").alias("m"))
    return whole.select(F.posexplode(F.map_entries("m")).alias("rank", "e")).select("e.key", "rank", "e.value.*").withColumnRenamed("key", "op")


def expression(op: Column) -> Column:
    """The regular expression of a name's labels; null where the name has no place for a number."""
    quoted = F.regexp_replace(op, r"([\[\]*+$.|?(){}\\^])", r"\\$1")
    ranged = F.regexp_replace(quoted, r"M:N(?=\\\])", r"(\\d+):(\\\$|\\d+)")
    single = F.regexp_replace(ranged, r"(?<=##|\\\[|\\\*|=|>)N(?=\\\]|$)", r"(\\d+)")
    return F.when(single != quoted, F.concat(F.lit("^"), single, F.lit("$")))


def lookup(labels: DataFrame, label: str, table: DataFrame) -> DataFrame:
    """Each distinct label with its operator's row (op and what else the table holds) and its numbers m and n."""
    asked = labels.select(F.col(label).alias("_label")).where("_label is not null").distinct()
    rank = F.col("rank") if "rank" in table.columns else F.lit(0)
    named = table.withColumn("_rank", rank)
    exact = asked.join(named.select("op"), F.col("_label") == F.col("op")).select("_label", "op").distinct()
    rules = named.select("op", "_rank", expression(F.col("op")).alias("_rule")).where("_rule is not null")
    rest = asked.join(exact.select("_label"), "_label", "left_anti")
    by_rule = retrieval.regex_join(rest, "_label", rules, "_rule").groupBy("_label").agg(F.min(F.struct("_rank", "op"))["op"].alias("op"))
    found = exact.withColumn("_n", F.array().cast("array<string>")).unionByName(by_rule.withColumn("_n", F.regexp_extract_all("_label", F.lit(r"(\d+|\$)"), F.lit(1))))
    first = lambda i: F.get("_n", F.lit(i))
    numbers = [F.when(F.size("_n") > 1, first(0)).alias("m"), F.when(F.size("_n") > 1, first(1)).otherwise(first(0)).alias("n")]
    return found.join(table, "op").select(F.col("_label").alias(label), "op", *numbers, *[c for c in table.columns if c not in ("op", label, "m", "n")])


def explanations(nodes: DataFrame, table: DataFrame) -> DataFrame:
    """(key, node_id, parent_id, piece) of trees (key, node_id, parent_id, child_pos, type, label): a signal says its label, an
    operator its template with the pieces of its operands.

    Bottom-up, a round for each level, each written before the next; a node is said when all its operands are.
    """
    known = lookup(nodes.where("type = 'operator'"), "label", table).select("label", "m", "n", "template_unary", "template_binary")
    many = nodes.where("parent_id is not null").groupBy("key", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("_many"))
    waiting = cut(nodes.where("type = 'operator'").join(many, ["key", "node_id"], "left").join(known, "label", "left").withColumn("_many", F.coalesce("_many", F.lit(0))))
    said = cut(nodes.where("type <> 'operator'").select("key", "node_id", "parent_id", "child_pos", F.col("label").alias("piece")))
    rounds, arrived = [said], said
    while not waiting.isEmpty():
        # pieces of nodes that still wait; those of the said ones are used up
        kids = arrived.groupBy("key", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("_got"), F.transform(F.array_sort(F.collect_list(F.struct("child_pos", "piece"))), lambda x: x["piece"]).alias("_kids"))
        held = cut(waiting.join(kids, ["key", "node_id"], "left").withColumn("_ready", (F.col("_many") == 0) | F.coalesce(F.col("_got") == F.col("_many"), F.lit(False))))
        ready = held.where("_ready")
        template = F.when(F.col("_many") == 1, F.col("template_unary")).when(F.col("_many") == 2, F.col("template_binary"))
        operand = lambda i: F.coalesce(F.get("_kids", F.lit(i)), F.lit(""))
        told = X.render(template, m=F.coalesce("m", F.lit("")), n=F.coalesce("n", F.lit("")), a=operand(0), b=operand(1))
        words = F.concat(F.col("label"), F.lit(" of "), F.array_join(F.coalesce("_kids", F.array().cast("array<string>")), ", "))
        fresh = cut(ready.select("key", "node_id", "parent_id", "child_pos", F.coalesce(told, words).alias("piece")))
        if fresh.isEmpty():
            raise ValueError("some operators wait for operands that are not there")
        rounds.append(fresh)
        left = held.where("not _ready").drop("_got", "_kids", "_ready")
        arrived = cut(arrived.unionByName(fresh).join(left.select("key", F.col("node_id").alias("parent_id")), ["key", "parent_id"], "left_semi"))
        waiting = left
    return reduce(DataFrame.unionByName, rounds).drop("child_pos")
