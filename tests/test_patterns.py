"""Many operators against many texts, against a nested loop."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lemmata.operators import patterns as P
from lemmata.operators import retrieval


def pairs(df, op="op"):
    return Counter((r["t"], r[op]) for r in df.collect())


@pytest.mark.parametrize("block", [8 << 20, 2_000])
def test_contained_against_a_nested_loop(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)  # one block, or many
    monkeypatch.setattr(P, "HANDED", 500)
    r = random.Random(6)
    words = ["".join(r.choice("ab#é😀") for _ in range(r.choice([1, 2, 3, 5]))) for _ in range(120)]
    texts = ["".join(r.choice("abc#é😀 ") for _ in range(r.choice([0, 3, 40, 300]))) for _ in range(80)] + [None, "", "x" * 100_000 + "ab#"]
    ops = [*set(words), words[0], "", None, "\x00"]
    left = spark.createDataFrame([(t, 1) for t in texts], "t string, _op int").repartition(3)
    right = spark.createDataFrame([(o, i) for i, o in enumerate(ops)], "op string, n int")
    got = Counter((x["t"], x["op"], x["n"], x["_op"]) for x in P.contained(left, "t", right, "op", keep=["t", "_op"]).collect())
    assert got == Counter((t, o, i, 1) for t in texts if t is not None for i, o in enumerate(ops) if o is not None and o in t)


def test_matched_against_a_nested_loop(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 300)
    rules = [r"\$[a-z]+", r"##\d", r"\|[-=]>", r"s_[a-z]+", r"ab?c", r"(foo|bar)x", r"a{2,3}b", r"^req_\w+$", r"x+y", r"[]a]z", r"\bgo\b", "", r"(?i)ABC", r"lit\.eral", r"(abc)?d", r"\Qa.b\E", r"é+"]
    texts = ["a $rose(b)", "a ##2 b", "p |=> q", "s_eventually x", "ac abc", "barx", "aab", "req_1", "xxy", "]z", "go on", "ABC", "lit.eral", "d", "a.b", "éé", "", None, "nothing"]
    left, right = spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(x,) for x in rules], "op string")
    got = pairs(P.matched(left, "t", right, "op"))
    want = pairs(left.join(right, F.regexp_like("t", F.col("op"))))
    assert got == want and len(got) > 20


@pytest.mark.parametrize(
    ("pattern", "want"),
    [(r"\$rose\(", "$rose("), (r"ab?c", "a"), (r"abc*", "ab"), (r"abc+d", "abc"), (r"foo|foobar", None), (r"(foo)bar", "bar"), (r"x[abc]yz", "yz"), (r"(?i)abc", None), (r"\d+", None), (r"a{3}bc", "bc"), (r"(?:a|b)c", None), (r"\x41bc", None), (r"end$", "end")],
)
def test_required_literal(pattern, want):
    assert P.literal(pattern) == want


def test_literal_is_in_every_match():
    r = random.Random(1)
    for _ in range(3000):
        p = "".join(r.choice(["a", "b", "ab", "c?", "b*", "a+", ".", "[ab]", "(ab)", "(a)?", r"\.", "^", "$", "a{2}", r"\w"]) for _ in range(r.randrange(1, 6)))
        need = P.literal(p)
        for _ in range(10):
            t = "".join(r.choice("abc.") for _ in range(8))
            if need and re.search(p, t):
                assert need in t, (p, need, t)


def test_census_counts_documents_once(spark):
    left = spark.createDataFrame([(1, "a##1 b"), (2, "c"), (3, None)], "id int, t string")
    ops = spark.createDataFrame([("##",), ("b",), ("z",), (None,)], "op string")
    assert sorted((r["t"], r["op"]) for r in retrieval.contains_join(left, "t", ops, "op").collect()) == [("a##1 b", "##"), ("a##1 b", "b")]
    assert retrieval.contains_join(left, "t", ops.limit(0), "op").isEmpty()
