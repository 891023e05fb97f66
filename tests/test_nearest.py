"""Exact nearest rows against brute force, and what clusters save."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lemmata.operators import nearest as N
from lemmata.operators import retrieval


def frames(spark, x, q):
    rows = spark.createDataFrame([(i, v) for i, v in x], "id long, vec array<float>").repartition(3)
    return rows, spark.createDataFrame([(i, v) for i, v in q], "qid long, qvec array<float>")


def brute(x, q, k, measure):
    out = {}
    for i, v in q:
        each = []
        for j, w in x:
            a, b = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
            s = 0.0
            for m in range(len(a)):
                s += -a[m] * b[m] if measure == "dot" else (a[m] - b[m]) ** 2
            each.append((s, j))
        out[i] = [j for _, j in sorted(each)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append(r["id"])
    return out


@pytest.mark.parametrize("measure", ["dot", "l2"])
def test_against_brute_force(spark, monkeypatch, measure):
    monkeypatch.setattr(N, "ROWS", 40)  # many pieces and blocks
    rng = np.random.default_rng(3)
    x = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 8)))]
    x += [(1000 + i, x[5][1]) for i in range(120)]  # a third are one vector
    q = x[:60] + [(5000, [0.0] * 8), (5001, (np.ones(8) * 50).tolist())]
    rows, asked = frames(spark, x, q)
    got = found(N.topk(asked, N.build(rows), 7, measure))
    assert got == brute(x, q, 7, measure)


@pytest.mark.parametrize("measure", ["dot", "l2"])
def test_clusters_are_passed_over(spark, measure):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 16)) * 5
    x = [(i, (centres[i % 30] + rng.standard_normal(16) * 0.05).tolist()) for i in range(3000)]
    rows, asked = frames(spark, x, x[:40])
    index = N.build(rows)
    assert found(N.topk(asked, index, 4, measure)) == brute(x, x[:40], 4, measure)
    assert N.looked_at(asked, index, 4, measure) < 0.2


def test_stored_index(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((200, 4)))]
    rows, asked = frames(spark, x, x[:9])
    index = N.build(rows)
    index.rows.write.partitionBy("cluster").parquet(str(tmp_path / "index"))
    again = N.stored(spark.read.parquet(str(tmp_path / "index")), index.centres)
    assert found(N.topk(asked, again, 3)) == found(N.topk(asked, index, 3)) == brute(x, x[:9], 3, "dot")


def test_defined_cases(spark):
    x = [(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0]), (5, [0.0, 1.0]), (5, [0.5, 0.5]), (6, [None, 1.0]), (7, [])]
    rows, asked = frames(spark, x, [(1, [1.0, 0.2]), (2, None), (3, [1.0, 2.0, 3.0])])
    got = found(retrieval.topk(asked, rows, 10))
    assert got == {1: [1, 5, 5]}
    assert retrieval.topk(asked, rows.where("id = 2"), 3).isEmpty()
    assert retrieval.topk(asked.where("qid = 2"), rows, 3).isEmpty()
    same = spark.range(300).select(F.col("id"), F.array(F.lit(1.0), F.lit(2.0)).alias("vec"))
    assert found(retrieval.topk(asked.where("qid = 1"), same, 3, "l2")) == {1: [0, 1, 2]}
