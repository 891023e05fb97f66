"""Ties, repeated ids and rows, long values and clashing names in the searches of vectors and the URL filter."""

import numpy as np
from pyspark.sql import functions as F

from lemmata.llm import ann, urls


def test_nearest_with_ties_and_repeated_ids(spark):
    rng = np.random.default_rng(2)
    x = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((60, 8)))]
    x += [(100 + i, x[0][1]) for i in range(12)]  # twelve at the distance 0 of query 0
    x += [(7, x[20][1]), (7, x[21][1])]  # rows of one id are candidates each
    df = spark.createDataFrame(x, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("v", F.lit(1)).withColumn("query_id", F.lit(None).cast("int"))
    got = ann.nearest(df.repartition(3), "vec_id = 0 or vec_id = 20", k=10).collect()
    first = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 0)
    assert first == [(k + 1, 100 + k, 0.0) for k in range(10)]
    assert min((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 20) == (1, 7, 0.0)
    assert all(r["vec_id"] != r["query_id"] for r in got)


def test_urls_repeated_long_and_with_other_columns(spark):
    long = "http://a.example.net/en/" + "x" * 300_000
    data = [(1, "http://A.Example.net/en/p?q"), (1, "http://A.Example.net/en/p?q"), (2, long), (None, "http://b.org/fr/x"), (3, None), (4, ""), (5, "no scheme"), (6, "http://z.com/" + "é" * 50_000)] + [(100 + i, f"http://s{i}.net/a{i}") for i in range(30)]
    df = spark.createDataFrame(data, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("gram", F.lit("g")).withColumn("verdict", F.lit(None).cast("string"))
    got = urls.judge(df).collect()
    assert len(got) == len(data)
    same = [r for r in got if r["page_id"] == 1]
    assert same[0] == same[1] and (same[0]["host"], same[0]["path"], same[0]["rule"], same[0]["verdict"]) == ("a.example.net", "/en/p", "example.net/en/", "allow")
    by = {r["page_id"]: r for r in got}
    assert by[2]["verdict"] == "allow" and len(by[2]["path"]) == 300_004
    assert by[None]["rule"] == "org/fr/" and by[100]["verdict"] == "block" and by[6]["verdict"] in ("allow", "block")
    assert all((by[i]["host"], by[i]["path"], by[i]["rule"]) == ("", "", None) for i in (3, 4, 5))
