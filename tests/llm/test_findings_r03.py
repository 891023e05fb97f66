"""One small test for each settled finding of FINDINGS_r03.md on the training-data operators."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lemmata.llm import _graph, lines, tokenize


def test_a_wide_group_is_dealt_once(spark, monkeypatch):
    monkeypatch.setattr(_graph, "BLOCK_ROWS", 100)
    members = spark.range(3000).select(F.col("id").alias("node"), (F.col("id") % 2).alias("root"), (10 + F.col("id") % 90).alias("items"), F.lit(1).alias("copies"))
    dealt = _graph.in_blocks(members.unionByName(members.limit(50).withColumn("root", F.lit(7).cast("long"))), 80)
    assert dealt.count() == 3050  # and not once for every block of its group
    most = {(r["root"], r["wide"]): r["n"] for r in dealt.groupBy("root", "wide", "own").count().groupBy("root", "wide").agg(F.max("count").alias("n")).collect()}
    assert set(most) == {(0, True), (1, True), (7, False)} and most[0, True] < 200 and most[7, False] == 50


def test_links_across_the_stored_blocks_of_a_wide_group(spark, monkeypatch):
    monkeypatch.setattr(_graph, "BLOCK_ROWS", 40)
    r = random.Random(2)
    sets = []
    for i in range(300):  # sizes that differ by more than the threshold, in one group
        base = range(1000 * (i % 3), 1000 * (i % 3) + r.choice([20, 22, 25, 30, 36, 60]))
        sets.append(np.array(sorted(x for x in base if r.random() > 0.04), np.uint64))
    rows = spark.createDataFrame([(i, 5, len(s), 1 + i % 2, " ".join(str(x) for x in s)) for i, s in enumerate(sets)], "node long, root long, items long, copies int, text string")

    def make(column):
        return [np.array([int(x) for x in t.split()], np.uint64) for t in column.to_pylist()]

    got = _graph.verify(_graph.in_blocks(rows, 80), make, 80, None)
    links = {x["node"]: x["n"] for x in got.groupBy("node").agg(F.sum("links").alias("n")).collect()}
    want = {}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            if i != j and 100 * both >= 80 * (len(a) + len(b) - both):
                want[i] = want.get(i, 0) + 1 + j % 2
    assert links == want and len(want) > 200


def test_near_copies_of_a_line_in_many_blocks(spark, monkeypatch):
    r = random.Random(4)
    line = "the quick brown fox jumps over the lazy dog and runs away from all the others at dawn"
    texts = []
    for i in range(400):
        at = r.randrange(len(line))
        texts.append(line[:at] + chr(97 + r.randrange(26)) + line[at + 1 :] + f"\nalone{i * 7919}")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {(x["doc_id"], tuple(x["removed"])) for x in lines.dedup(df).collect()}
    monkeypatch.setattr(_graph, "BLOCK_ROWS", 30)
    assert {(x["doc_id"], tuple(x["removed"])) for x in lines.dedup(df).collect()} == whole
    assert sum(len(x) for _, x in whole) > 350


def test_what_a_worker_keeps_of_its_parts_is_small():
    t = tokenize.WordTokenizer(tokenize.vocabulary_path())
    texts = [" ".join(f"{i:x}" for i in range(a, a + 50_000)) for a in range(0, 600_000, 50_000)]
    for _, ids, first in t.documents(pa.array(texts)):
        assert len(ids) == first[-1]
    assert len(t.known) > 300_000
    assert sum(x.nbytes for x in (t.known, t.places, *(p.data for p in (t.ids, t.spans, t.begin, t.length)))) < 60e6
