"""Exact deduplication against brute force, defined cases included."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lemmata.llm import exact
from tests.llm.conftest import LONG


def brute(rows, normal=lambda t: t):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[normal(text or "")].append((doc_id is not None, doc_id or 0, i, doc_id))
    out = Counter()
    for text, members in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        top = max(members, key=lambda m: m[:2])
        for m in members:
            out[m[3], top[3], len(members), sha] += 1
    return out


def report(df):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in df.collect())


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    texts = ["hot"] * 500 + [f"text {r.randrange(700)}" for _ in range(900)] + [None, "", "", LONG, LONG, "é😀", "É😀"]
    r.shuffle(texts)
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    return rows + [rows[7], rows[7], (7, "another text under an id")]


def test_classes_against_brute_force(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5).withColumn("sha", F.lit(1)).withColumn("bitmap", F.lit("x"))
    got = exact.classes(docs).cache()
    assert report(got) == brute(corpus)
    kept = got.where("kept").groupBy("text_sha256").count()
    assert kept.where("count > 1").isEmpty() and kept.count() == len({t or "" for _, t in corpus})
    assert got.where("kept and not (doc_id <=> keep_id)").isEmpty()


def test_many_parts_and_a_full_filter(spark, corpus, monkeypatch):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    monkeypatch.setattr(exact, "SLOTS", 64)
    monkeypatch.setattr(exact, "PART", 7)  # many bitmaps of 64 slots, in parts of 7
    assert report(exact.classes(docs)) == brute(corpus)
    monkeypatch.setattr(exact, "PARTS", 1)  # a filter with every bit taken
    assert report(exact.classes(docs)) == brute(corpus)


def test_normalised_texts(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    assert report(exact.classes(docs, normalise=F.lower)) == brute(corpus, str.lower)


def test_filter_lets_unique_rows_pass(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.when(F.col("id") < 50, F.lit(0)).otherwise(F.col("id"))).alias("text"))
    hashes = docs.select("doc_id", exact._digest(F.col("text"), None).alias("sha"))
    hashes = hashes.select("*", *exact._slots(F.col("sha"), exact._bitmaps(20_000, 1)))
    tested = exact._tested(hashes, exact._again(hashes)).cache()
    assert tested.where("doc_id < 50 and not maybe").isEmpty()  # none is missed
    assert tested.where("doc_id >= 50 and maybe").count() < 20_000 * 0.03
    assert "Python" not in exact.classes(docs)._jdf.queryExecution().toString()


def test_keep_last_keeps_whole_rows(spark, corpus):
    rows = [(i, t, n, {"a": n}) for n, (i, t) in enumerate(corpus)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, _row map<string,int>").repartition(3)
    kept = exact.keep_last(docs)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"] or "") for r in kept.collect())
    want = Counter((keep, next(t or "" for i, t in corpus if hashlib.sha256((t or "").encode()).hexdigest() == sha)) for _, keep, _, sha in {(0, k, 0, s) for _, k, _, s in brute(corpus)})
    assert got == want


def test_empty_table_and_edges(spark, edge_docs, empty_docs):
    assert exact.classes(empty_docs).isEmpty() and exact.keep_last(empty_docs).isEmpty()
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert report(exact.classes(edge_docs)) == brute(rows)
    assert exact.keep_last(edge_docs).count() == len({t or "" for _, t in rows})
