"""Intervals of ends against explicit match sets, and linear rows on a long trace."""

import random

import pytest

from lemmata.operators import ends as I
from lemmata.operators import temporal as E


@pytest.fixture(scope="module")
def words():
    r = random.Random(4)
    made = {t: [(r.random() < 0.5, r.random() < 0.4, r.random() < 0.8) for _ in range(r.choice([1, 3, 8, 12]))] for t in range(30)}
    made[30], made[31] = [(True, True, True)] * 7, [(False, False, False)] * 7
    return made


@pytest.fixture(scope="module")
def df(spark, words):
    rows = [(t, i, a or None, b, g) for t, w in words.items() for i, (a, b, g) in enumerate(w)]
    return spark.createDataFrame(rows, "trace_id long, tick long, a boolean, b boolean, g boolean").cache()


def brute(words, test):
    return {(t, i, e) for t, w in words.items() for i in range(len(w)) for e in range(i, len(w)) if test(w, i, e)}


def n_b(w, i, e):
    return sum(x[1] for x in w[i : e + 1])


goto2 = lambda w, i, e: w[e][1] and n_b(w, i, e) >= 2
cases = {
    "goto": (lambda t: I.goto(t, "b", 2, 3), lambda w, i, e: w[e][1] and 2 <= n_b(w, i, e) <= 3),
    "open goto": (lambda t: I.goto(t, "b", 2), goto2),
    "nonconsecutive": (lambda t: I.nonconsecutive(t, "b", 1, 2), lambda w, i, e: 1 <= n_b(w, i, e) <= 2),
    "open nonconsecutive": (lambda t: I.nonconsecutive(t, "b", 2), lambda w, i, e: n_b(w, i, e) >= 2),
    "repeat": (lambda t: I.repeat(t, "a", 2, 3), lambda w, i, e: 2 <= e - i + 1 <= 3 and all(x[0] for x in w[i : e + 1])),
    "open repeat": (lambda t: I.repeat(t, "a", 1), lambda w, i, e: all(x[0] for x in w[i : e + 1])),
    "delay": (lambda t: I.delay(I.tick(t, "a"), "b", 1, 3), lambda w, i, e: w[i][0] and w[e][1] and 1 <= e - i <= 3),
    "open delay": (lambda t: I.delay(I.tick(t, "a"), "b", 2, None), lambda w, i, e: w[i][0] and w[e][1] and e - i >= 2),
    "goto, then": (lambda t: I.delay(I.goto(t, "b", 2), "a", 1, None), lambda w, i, e: w[e][0] and any(goto2(w, i, x) for x in range(i, e))),
    "nonconsecutive, then": (lambda t: I.delay(I.nonconsecutive(t, "b", 1, 1), "a", 1, 2), lambda w, i, e: w[e][0] and any(n_b(w, i, x) == 1 for x in (e - 1, e - 2) if x >= i)),
    "intersect": (lambda t: I.intersect(I.goto(t, "b", 1), I.repeat(t, "a", 2)), lambda w, i, e: e > i and w[e][1] and all(x[0] for x in w[i : e + 1])),
    "first": (lambda t: I.first_match(I.goto(t, "b", 2)), lambda w, i, e: w[e][1] and n_b(w, i, e) == 2),
    "throughout": (lambda t: I.throughout("g", I.goto(t, "b", 1)), lambda w, i, e: w[e][1] and all(x[2] for x in w[i : e + 1])),
    "within": (lambda t: I.within(I.delay(I.tick(t, "a"), "b", 1, 1), I.goto(t, "b", 2)), lambda w, i, e: goto2(w, i, e) and any(w[x][0] and w[x + 1][1] for x in range(i, e))),
}


@pytest.mark.parametrize("name", cases)
def test_against_explicit_pairs(df, words, name):
    make, test = cases[name]
    s = make(df)
    want = brute(words, test)
    assert {(r["trace_id"], r["start"], r["end"]) for r in I.explicit(s).collect()} == want
    found = I.counts(s, "a").collect()
    assert len(found) == len({x[:2] for x in want})  # a row for each start
    for r in found:
        own = [e for t, i, e in want if (t, i) == (r["trace_id"], r["start"])]
        assert (r["first"], r["last"], r["n"], r["n_true"]) == (min(own), max(own), len(own), sum(words[r["trace_id"]][e][0] for e in own))


@pytest.mark.parametrize(("shift", "followed"), [(0, False), (1, False), (0, True), (1, True)])
def test_implications(df, shift, followed):
    s = I.goto(df, "b", 1, 2)
    filled = df.fillna(False)
    got = I.suffix(s, "a", "p", shift, followed).select("trace_id", "tick", "p").collect()
    want = E.suffix(filled, E.goto(df, "b", 1, 2), "a", "p", shift, followed).select("trace_id", "tick", "p").collect()
    assert sorted(got) == sorted(want)


def test_rows_stay_linear(spark):
    n = 20_000
    t = spark.range(n).selectExpr("1L as trace_id", "id as tick", "id % 3 = 0 as b", "true as a").cache()
    for s in (I.goto(t, "b", 1), I.nonconsecutive(t, "b", 2), I.delay(I.tick(t, "a"), "b", 1, None)):
        assert n - 8 <= s.rows.count() <= n
    per = I.counts(I.goto(t, "b", 1)).agg({"n": "sum"}).first()[0]
    assert per == sum(-(-(n - i) // 3) if i % 3 == 0 else len(range(i + 3 - i % 3, n, 3)) for i in range(n))


def test_refusals(df):
    with pytest.raises(ValueError, match="automaton"):
        I.goto(df, "b", 0)
    with pytest.raises(ValueError, match="gate"):
        I.delay(I.goto(df, "b", 1, 2), "a", 1, 2)
