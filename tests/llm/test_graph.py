"""The shared graph steps against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lemmata.llm import _graph, jaccard


def roots(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("held", [1_000_000, 700])
def test_components_of_chains_stars_and_repeats(spark, monkeypatch, held):
    monkeypatch.setattr(_graph, "HELD", held)
    r = random.Random(7)
    edges = [(i, i + 1) for i in range(-50, 900)] + [(5000, 5000 + i) for i in range(1, 3000)] + [(9000 + i, 9999) for i in range(200)]
    edges += [(r.randrange(20_000, 30_000), r.randrange(20_000, 30_000)) for _ in range(6000)] + [(1 << 62, -(1 << 62))] * 3
    r.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(16)
    got = _graph.components(df).collect()
    want = roots([(a, b) for a, b in edges if a != b])
    assert len(got) == len(want) and {x["node"]: x["root"] for x in got} == want
    assert _graph.components(df.limit(0)).count() == 0


def test_shared_stars_connect_the_holders_of_a_key(spark):
    rows = [(i, [i % 7, 100 + i, -5] if i % 3 else [100 + i]) for i in range(500)]
    df = spark.createDataFrame(rows, "node long, keys array<long>").repartition(9)
    got = roots([(x["a"], x["b"]) for x in _graph.shared(df, "node", "keys", stars=True).collect()])
    assert set(got) == {i for i in range(500) if i % 3} and set(got.values()) == {1}
    pairs = {(x["key"], x["node"]) for x in _graph.shared(df, "node", "keys").collect()}
    assert pairs == {(k, i) for i, ks in rows for k in ks if k < 100}


def test_spread_join_looks_up_a_hot_key(spark):
    left = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("long").alias("k"))
    right = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = {x["id"]: x["v"] for x in _graph.spread_join(left, right, "k", "id", "left").collect()}
    assert got == {i: 14 if i % 3 == 0 else 2 * i if i < 3000 else None for i in range(4000)}


def test_common_counts_like_sets():
    r = random.Random(3)
    sets = [np.unique(np.array([r.randrange(40) for _ in range(30)] + [r.randrange(5000) for _ in range(r.randrange(60))], np.uint64)) for _ in range(150)]
    left, right = sets[:70], sets[70:]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]
    assert _graph.common(left, right).astype(int).tolist() == want


def test_thousands_of_near_copies_in_several_blocks(spark, monkeypatch):
    r = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(2500):
        t = list(base)
        for _ in range(r.choice([0, 1, 1, 2])):
            t[r.randrange(60)] = f"x{r.randrange(400)}"
        texts.append(" ".join(t))
    monkeypatch.setattr(_graph, "BLOCK_ROWS", 700)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in jaccard.jaccard_join(df).collect()}
    words = [t.split() for t in texts]
    number = {}
    sets = [{number.setdefault(tuple(w[j : j + 5]), len(number)) for j in range(len(w) - 4)} for w in words]
    held = np.zeros((len(texts), len(number)), np.float32)
    for i, s in enumerate(sets):
        held[i, list(s)] = 1
    both, size = held @ held.T, held.sum(1)
    near = 100 * both >= 80 * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(near, False)
    want = roots([(i, j) for i, j in zip(*np.nonzero(near), strict=True)])
    assert all(got[i]["n_links"] == near[i].sum() and got[i]["component_id"] == want.get(i, i) for i in range(len(texts)))
