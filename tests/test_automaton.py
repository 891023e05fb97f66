"""Outcomes of attempts against the sequences' meaning, word by word."""

import random
from itertools import product

import pytest

from lemmata.operators import automaton as A

LETTERS = list(product([False, True], repeat=2))


def holds(sample, letter):
    return {"a": letter[0], "b": letter[1], "a and not b": letter[0] and not letter[1]}[sample]


def ends(s, w, i):
    """Ends (exclusive) of the matches of s in w from i, after its definition."""
    k, p = s.kind, s.parts
    if k in ("tick", "unless", "true"):
        ok = i < len(w) and (k == "true" or holds(p[0], w[i]) == (k == "tick"))
        return {i + 1} if ok else set()
    if k == "delay":
        high = len(w) + 1 if s.high is None else s.high
        out = set()
        for e in ends(p[0], w, i):
            for d in range(s.low, high + 1):
                if d == 0:
                    out |= {f for f in ends(p[1], w, e - 1) if f > e - 1} if e > i else set()
                elif e + d - 1 <= len(w):
                    out |= ends(p[1], w, e + d - 1)
        return out
    if k == "repeat":
        out, at = set(), {i}
        for n in range((len(w) + 1 if s.high is None else s.high) + 1):
            if n >= s.low:
                out |= at
            at = {f for e in at for f in ends(p[0], w, e)}
        return out
    if k == "or":
        return ends(p[0], w, i) | ends(p[1], w, i)
    if k == "intersect":
        return ends(p[0], w, i) & ends(p[1], w, i)
    if k == "throughout":
        return {e for e in ends(p[1], w, i) if all(holds(p[0], x) for x in w[i:e])}
    found = ends(p[0], w, i)
    return {min(found)} if found else set()


def meaning(s, w, i, resets=()):
    """The outcome at i by trying every continuation of up to three ticks."""
    stop = next((t for t in range(i, len(w)) if t in resets), None)
    seen = w[: len(w) if stop is None else stop]
    if ends(s, seen, i) and stop != i:
        return A.MATCH
    live = any(e > len(seen) for n in range(1, 4) for more in product(LETTERS, repeat=n) for e in ends(s, [*seen, *more], i))
    if stop is not None:
        return A.DISABLED if live else A.FAIL
    return A.LIVE if live else A.FAIL


a, b = A.tick("a"), A.tick("b")
SEQUENCES = {
    "delay": A.delay(a, b, 1, 3),
    "open delay": A.delay(a, A.repeat(b, 2, 2), 1, None),
    "fusion": A.delay(A.delay(a, b), A.delay(b, a), 0),
    "fusion or later": A.delay(a, b, 0, 2),
    "empty": A.repeat(a, 0),
    "empty, then": A.delay(A.repeat(b, 0, 2), a),
    "delay before empty": A.delay(a, A.repeat(b, 0, 1), 2, 2),
    "goto": A.goto("b", 2, 3),
    "open goto": A.delay(A.goto("b", 2), a),
    "nonconsecutive": A.delay(A.nonconsecutive("b", 1, 2), a),
    "or": A.either(A.delay(a, a), A.delay(b, b, 2)),
    "and": A.both(A.delay(a, b), A.delay(a, a, 2)),
    "intersect": A.intersect(A.delay(a, b, 1, 3), A.goto("b", 1, 2)),
    "throughout": A.throughout("a", A.goto("b", 2, 2)),
    "within": A.within(A.delay(b, b), A.repeat(a, 3, 4)),
    "first": A.delay(A.first_match(A.delay(a, b, 1, 2)), a),
    "expression": A.delay(A.tick("a and not b"), b, 2, 2),
    "never": A.intersect(a, A.delay(a, b)),
}


@pytest.fixture(scope="module")
def traces(spark):
    r = random.Random(9)
    words = {t: [r.choice(LETTERS) for _ in range(r.choice([1, 2, 5, 9]))] for t in range(24)}
    words[24], words[25] = [(True, True)] * 6, [(False, False)] * 6
    resets = {t: {r.randrange(len(w))} if t % 3 == 0 else set() for t, w in words.items()}
    rows = [(t, i, x[0] or None, x[1], i in resets[t], "kept") for t, w in words.items() for i, x in enumerate(w)]
    return words, resets, spark.createDataFrame(rows, "trace_id long, tick long, a boolean, b boolean, r boolean, _row string").cache()


@pytest.mark.parametrize("name", SEQUENCES)
@pytest.mark.parametrize("block", [2, 4096])
def test_outcomes(traces, monkeypatch, name, block):
    words, resets, df = traces
    monkeypatch.setattr(A, "BLOCK", block)
    s = SEQUENCES[name]
    got = A.outcome(df, s, "how", "r" if block == 2 else None)
    assert got.columns == [*df.columns, "how"]
    found = {(r["trace_id"], r["tick"]): r["how"] for r in got.collect()}
    want = {(t, i): meaning(s, w, i, resets[t] if block == 2 else ()) for t, w in words.items() for i in range(len(w))}
    assert found == want


def test_weak_and_strong(traces):
    words, _, df = traces
    s = SEQUENCES["delay"]
    got = A.weak(A.strong(df, s, "s"), s, "w").collect()
    assert all(r["w"] or not r["s"] for r in got)
    assert {(r["s"], r["w"]) for r in got} == {(True, True), (False, True), (False, False)}
    assert all(r["w"] == (meaning(s, words[r["trace_id"]], r["tick"]) in (A.MATCH, A.LIVE)) for r in got)


def test_one_long_trace_is_read_in_blocks(spark):
    n = 30_000
    df = spark.range(n).selectExpr("'t' as trace_id", "id as tick", "id % 1000 = 0 as a", f"id = {n - 1} as b")
    got = A.outcome(df, A.delay(a, b, 1, None), "how").groupBy("how").count().collect()
    assert {r["how"]: r["count"] for r in got} == {A.MATCH: n // 1000, A.FAIL: n - n // 1000}


def test_limits_and_empty(spark, traces):
    with pytest.raises(ValueError, match="states"):
        A.automaton(A.repeat(a, 70, 70))
    with pytest.raises(ValueError, match="samples"):
        A.automaton(A.either(A.either(A.either(A.either(*[A.tick(f"x{i}") for i in (0, 1)]), A.either(*[A.tick(f"x{i}") for i in (2, 3)])), A.either(*[A.tick(f"x{i}") for i in (4, 5)])), A.either(A.either(A.tick("x6"), A.tick("x7")), A.tick("x8"))))
    assert A.outcome(traces[2].limit(0), SEQUENCES["delay"], "how").isEmpty()
