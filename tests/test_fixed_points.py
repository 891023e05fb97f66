"""Fixed points end at no change, however deep, and say so when they can't."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lemmata.functions import text as X
from lemmata.plans import generate
from lemmata.sources import records


def test_a_deep_tree_is_walked_whole(spark):
    n = 100
    rows = [("k", i, None if i == 0 else i - 1, f"c{i}") for i in range(n)] + [("k", 500, 77, "leaf"), ("k", 900, 901, "lost"), ("k", 901, 900, "lost"), ("other", 0, None, "x")]
    found = spark.createDataFrame(rows, "key string, node_id int, parent_id int, code string").coalesce(1)
    pieces = spark.createDataFrame([("k", "root")], "key string, piece string")
    got = {(r["key"], r["node_id"]): r["piece"] for r in generate.walk_down(found, pieces, lambda p, c: F.md5(F.concat(p, c))).collect()}
    want, piece = {("k", 0): "root"}, "root"
    for i in range(1, n):
        piece = hashlib.md5(f"{piece}c{i}".encode()).hexdigest()
        want["k", i] = piece
    want["k", 500] = hashlib.md5((want["k", 77] + "leaf").encode()).hexdigest()
    assert got == want


def test_twenty_errors_are_cleaned(spark):
    source = spark.createDataFrame([("f", i, "bad" if i % 2 else "fine") for i in range(40)], "file string, line int, value string").coalesce(1)
    report = lambda now: now.where("value = 'bad'").groupBy("file").agg(F.min("line").alias("line"))
    got = {r["line"]: r["value"] for r in generate.fix_until_clean(source, report, records.comment_out).collect()}
    assert got == {i: "// bad" if i % 2 else "fine" for i in range(40)}


def test_errors_that_stay_are_told(spark):
    source = spark.createDataFrame([("f", 1, "x")], "file string, line int, value string")
    with pytest.raises(RuntimeError, match="1 lines are still reported"):
        generate.fix_until_clean(source, lambda now: now.select(F.lit("g").alias("file"), F.lit(9).alias("line")), records.comment_out)


def test_feedback_reaches_the_correction_and_nothing_is_asked_twice(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "ccc"), (4, None)], "id int, x string")
    asked = []

    def correct(bad, column):
        asked.append(sorted((r["id"], r["feedback"]) for r in bad.collect()))
        return bad.withColumn(column, F.concat(F.coalesce(column, F.lit("")), F.lit("!"))).drop("feedback")

    got = generate.verify_loop(rows, "x", lambda c: F.length(c) >= 3, correct, 2, lambda c: F.concat(F.lit("too short: "), F.coalesce(c, F.lit("none"))))
    assert sorted(map(tuple, got.collect())) == [(1, "a!!", True, 3), (2, "bb!", True, 2), (3, "ccc", True, 1), (4, "!!", False, 3)]
    assert asked == [[(1, "too short: a"), (2, "too short: bb"), (4, "too short: none")], [(1, "too short: a!"), (4, "too short: !")]]


@pytest.mark.parametrize(
    ("text", "code", "asks"),
    [("input a;", True, True), ("always @(x)", True, True), ("show me a circuit", False, True), ("reg", True, True), ("registers", True, True), ("always ##2", False, False), ("Verilog", False, True), ("what is this?", False, False), ("", False, False)],
)
def test_simple_detectors(spark, text, code, asks):
    assert tuple(spark.createDataFrame([(text,)], "t string").select(X.simple_code("t"), X.asks_for_code("t")).first()) == (code, asks)


@pytest.mark.parametrize(
    ("text", "code"),
    [("assert property (x) $error(", True), ("the module is good", False), ("wire w", True), ("if the bit is set", True), ("this is prose. Yes", False), ("|-> @(posedge clk) in the end", True), ("a |-> b", False)],
)
def test_code_or_prose(spark, text, code):
    assert spark.createDataFrame([(text,)], "t string").select(X.is_code("t")).first()[0] is code


@pytest.mark.parametrize(
    ("text", "want"),
    [('The expression "a" means that it rises.', "it rises"), ('"a"  is  true\nwhen b falls', "b falls"), ('"a" evaluates to true if and only if b.', "b"), ('"a" evaluate to true when b', "b"), ("a plain one.", "a plain one"), ('"a" has b', '"a" has b')],
)
def test_plain_operand(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.plain_operand("t")).first()[0] == want


def test_parameters(spark):
    bench = "parameter W = 4; localparam [3:0] K=1; parameter int N; parameter real\tR; myparameter X; parameterize Y; parameter integer_like = 2"
    assert spark.createDataFrame([(bench,)], "t string").select(X.parameters("t")).first()[0] == ["W", "K", "N", "R", "integer_like"]
