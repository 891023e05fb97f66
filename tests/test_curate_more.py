"""Samples that must fill, shares, least values, golden counts and scores by them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lemmata.operators import curate


def test_samples_that_must_fill(spark):
    rows = spark.range(20)
    assert curate.sample_exact(rows, 20, "id").count() == 20
    assert curate.sample_exact(rows, 5, "id", 3).collect() == curate.sample_n(rows, 5, "id", 3).collect()
    with pytest.raises(ValueError, match="the pool holds 20 rows, 21 are asked for"):
        curate.sample_exact(rows, 21, "id")


def test_shares_and_least(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.choice(["x", "y", "z", "w", None]), 1) for _ in range(60)] + [("c", None, 4)]
    df = spark.createDataFrame(rows, "g string, v string, n int")
    got = {x["g"]: (x["n"], round(x["share"], 9)) for x in curate.shares(df, "g", "n").collect()}
    assert got == {g: (n := sum(x[2] for x in rows if x[0] == g), round(n / 64, 9)) for g in ("a", "b", None, "c")}
    for k in (1, 2, 9):
        assert {x["g"]: x["least"] for x in curate.least(df, "g", "v", k).collect()} == {g: sorted({x[1] for x in rows if x[0] == g and x[1]})[:k] for g in ("a", "b", None, "c")}


@pytest.mark.parametrize(
    ("entries", "want"), [({"Assertion 1": {}, "Assertion 2": 1, "files": []}, 2), ({"Assertion 1": {"Assertion 9": 1}, "a": 1, "b": 2}, 1), ({}, 0), (None, 0)]
)
def test_golden_counts(spark, entries, want):
    text = None if entries is None else json.dumps(entries)
    assert spark.createDataFrame([(text,)], "t string").select(curate.golden_counts("t")).first()[0] == want


def test_design_scores(spark):
    r = random.Random(5)
    rows = [(m, i, r.choice(["proven", "cex"])) for m in ("p", "q", "none") for i in r.sample(range(500), 41)]
    golden = {"p": 7, "q": 10}
    got = {x["m"]: tuple(x)[1:] for x in curate.design_scores(spark.createDataFrame(rows, "m string, i long, result string"), spark.createDataFrame(list(golden.items()), "m string, golden long"), "m", "i").collect()}
    for m in ("p", "q", "none"):
        g = golden.get(m, 0)
        after = [x[2] for x in sorted((x for x in rows if x[0] == m), key=lambda x: x[1])][g:]
        assert got[m] == (g, len(after) // 2, after[::2].count("proven"), after[1::2].count("proven"))


def test_parser_report_helpers_take_ties(spark):
    df = spark.range(5).select(F.lit("s").alias("g"), F.lit("same").alias("v"))
    assert curate.least(df, "g", "v", 2).first()["least"] == ["same"]
