"""Dataflow steps and helpers that no registered query covers, on small tables."""

import hashlib

from pyspark.sql import functions as F

from lemmata.functions import text as X
from lemmata.operators import curate, retrieval
from lemmata.plans import generate, sva


def stub(x):
    return "stub:" + hashlib.md5(x.encode()).hexdigest()


def test_retrieval_chain_by_vectors(spark):
    store = spark.createDataFrame([(1, "clock and reset"), (2, "bus grant request"), (3, "grant grant bus"), (4, None)], "id long, content string")
    asked = spark.createDataFrame([(10, "Grant the BUS", "code"), (11, "reset clock", "text")], "q long, text string, store string")
    got = {(r["q"], r["rank"]): r["content"] for r in generate.retrieve(asked, store, "q", 2, 64).collect()}
    assert got[10, 1] in ("grant grant bus", "bus grant request") and got[11, 1] == "clock and reset" and len(got) == 4
    routed = generate.routed(asked, {"code": store.where("id < 3"), "text": store.where("id >= 3")}, "q", 1).collect()
    assert sorted((r["q"], r["store"], r["content"]) for r in routed) == [(10, "code", "bus grant request"), (11, "text", "grant grant bus")]
    prompts = generate.stuff(asked.select(F.col("q").cast("string").alias("q")), generate.retrieve(asked, store, "q", 1, 64).withColumn("q", F.col("q").cast("string")), "q", "{context}|{query}")
    done = {r["q"]: r["a"] for r in generate.complete(prompts, "prompt", "a", generate.Stub()).collect()}
    assert done["11"] == stub("clock and reset|11")


def test_variants_and_recheck(spark):
    rows = spark.createDataFrame([("x",), ("y",)], "q string")
    hits = spark.createDataFrame([("x", 1, "c1"), ("x", 2, "c2")], "q string, rank long, content string")
    words = spark.createDataFrame([("x", 1, "k")], "q string, rank long, content string")
    got = {r["q"]: r for r in generate.generate(rows, "q", hits, words, generate.Variant(keywords=True, recheck=1), generate.Stub()).collect()}
    assert got["x"]["prompt"] == "k\n\nc1\n\nc2\nWrite one assertion for: x" and got["x"]["answer"] == stub("Correct: " + stub(got["x"]["prompt"]))
    none = {r["q"]: r["prompt"] for r in generate.generate(rows, "q", hits, words, generate.Variant(context="none", style="steps"), generate.Stub()).collect()}
    assert none["x"] == "\nName the operations of: x\nThen write one assertion."
    assert spark.range(1).select(generate.clauses(F.lit("a rises, then b falls and c; d"))).first()[0] == ["a rises", "b falls", "c", "d"]


def test_store_is_built_once(spark, tmp_path):
    calls = []
    build = lambda: (calls.append(1), spark.range(5))[1]
    path = str(tmp_path / "store")
    assert [retrieval.load_or_build(spark, path, build).count() for _ in range(2)] == [5, 5] and calls == [1]


def test_numbered_takes_any_number(spark):
    keys = [None, -5, 0, 10**15, 3, 3, -(10**12)] + list(range(100, 400, 7))
    got = curate.numbered(spark.createDataFrame([(k,) for k in keys], "k long"), "k").collect()
    want = sorted(keys, key=lambda k: (k is not None, k or 0))
    assert [r["k"] for r in sorted(got, key=lambda r: r["n"])] == want and sorted(r["n"] for r in got) == list(range(1, len(keys) + 1))
    assert curate.numbered(spark.createDataFrame([], "k long"), "k").count() == 0


def test_bodies_and_turns_of_odd_shape(spark):
    body = lambda t: spark.range(1).select(X.property_body(F.lit(t))).first()[0]
    assert body("l: assert property (@(negedge clk) disable iff (r) a |-> b) ;") == "a |-> b"
    assert body("sel : a ? b") == "sel : a ? b" and body("assert (a && b);") == "a && b"
    turn = lambda t: spark.range(1).select(X.think_turn(F.lit(t), "sv").alias("x")).select("x.*").first()
    assert tuple(turn(" \n\t```sv\na\n```"))[:2] == (False, "empty_reasoning")
    assert turn("why\n\n```sv\na\n``` \n")["text"] == "<think>\nwhy\n</think>\n\n```sv\na\n```"


def test_completer_names_operators_without_a_template():
    root = sva.parse("odd_op(a, b) |-> c")
    assert sva.explain(root, lambda label, kids: f"{label}<{'+'.join(kids)}>") == "whenever odd_op<a+b>, c in the same cycle"
    assert sva.derivation(root).splitlines()[-1] == "Meaning: whenever odd_op of a, b, c in the same cycle"
