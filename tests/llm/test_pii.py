"""Personal data against brute force: base spans, overlaps and the graph of the bootstrap."""

import hashlib
import math
import random
import re
import time

from lemmata.llm import pii

KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def valid(kind, x):
    n = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        return 12 <= len(n) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(n))) % 10 == 0
    return kind != "phone" or 9 <= len(n) <= 15


def base(text):
    found = [(m.start(), k, m.end()) for k, (name, p) in enumerate(KINDS) for m in re.finditer(p, text or "") if valid(name, m[0])]
    return [f"{KINDS[k][0]}:{a}:{b}" for a, k, b in sorted(found)]


def made(r):
    card = lambda: next(f"{a}{c}" for a in [str(r.randrange(10**14, 10**15))] for c in "0123456789" if valid("card", f"{a}{c}"))
    parts = [
        lambda: f"{r.choice('ab+._')}x{r.randrange(99)}@{r.choice(['mail', 'a-b', 'é'])}.{r.choice(['co', 'example.net', '', '.x'])}",
        lambda: ".".join(str(r.choice([0, 7, 255, 256, 10, "007"])) for _ in range(r.choice([3, 4, 5]))),
        lambda: re.sub("(.{4})", r"\1" + r.choice([" ", "-", ""]), card()),
        lambda: f"+{r.randrange(1, 99)} ({r.randrange(999)}) {r.randrange(10**7)}",
        lambda: r.choice(["word", "𝔘né", "12", "@", "+", "x1:", "\x01", "\n", "id=AB-77-XY"]),
    ]
    return "".join(r.choice(parts)() + r.choice([" ", " ", "", ",", "\t", "\n"]) for _ in range(r.choice([0, 3, 20, 700])))


def test_base_spans_against_brute_force(spark):
    r = random.Random(9)
    texts = [None, "", *(made(r) for _ in range(250))]
    got = pii.report(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    assert len(got) == len(texts)
    for x in got:
        want = base(texts[x["doc_id"]])
        assert x["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [x[f"n_{k}"] for k, _ in KINDS] == [sum(w.startswith(k + ":") for w in want) for k, _ in KINDS]
        assert [s for s in x["spans"].split(",") if s and not s.startswith("other:")] == want


def test_apart_and_outermost_against_brute_force(spark):
    r = random.Random(6)
    rows = [(d, 0, a, a + r.randrange(1, 8), r.random() < 0.3) for d in range(30) for a in [r.randrange(60) for _ in range(12)]]
    df = spark.createDataFrame(rows, "doc_id long, h long, start int, end int, seed boolean")
    want = sorted(x[:4] for x in rows if not x[4] and not any(y[4] and y[0] == x[0] and y[2] < x[3] and y[3] > x[2] for y in rows))
    assert sorted(tuple(x)[:4] for x in pii.apart(df).collect()) == want
    nested = sorted({(d, 0, a, b) for d in range(20) for lo in (0, 100) for a, b in [(lo, lo + 50), (lo + 5, lo + 20), (lo + 5, lo + 9), (lo + 30, lo + 50)] if r.random() < 0.6})
    want = [x for x in nested if not any(y != x and y[0] == x[0] and y[2] <= x[2] and y[3] >= x[3] for y in nested)]
    assert sorted(map(tuple, pii.outermost(spark.createDataFrame(nested, "doc_id long, h long, start int, end int")).collect())) == want


def test_bootstrap_against_brute_force(spark):
    r = random.Random(8)
    edges = {}
    for p in range(25):
        for c in r.sample(range(80), 9):
            edges[f"p{p}", f"c{c}"] = c < 55 or (p < 8 and c < 70)
    seeds = {c for (_, c), s in edges.items() if s}
    rows = [(p, c, c in seeds) for p, c in edges]
    score = dict.fromkeys(seeds, 1.0)
    for _ in range(pii.ROUNDS):
        sure = {}
        for p in {p for p, _ in edges}:
            own = [c for q, c in edges if q == p]
            rate = sum(score.get(c, 0) for c in own) / (len(own) + 1)
            if rate >= pii.BAR and sum(c in score for c in own) >= pii.SUPPORT:
                sure[p] = rate
        score = dict.fromkeys(seeds, 1.0)
        for c in {c for _, c in edges} - seeds:
            held = [sure[p] for p, d in edges if d == c and p in sure]
            if held:
                score[c] = 1 - math.prod(1 - x for x in held)
    want = {c: s for c, s in score.items() if c not in seeds and s >= pii.BAR}
    got = {x["core"]: x["score"] for x in pii.bootstrap(spark.createDataFrame(rows, "pattern string, core string, seed boolean")).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 for c in want)


def test_long_text_of_tokens_is_walked_in_linear_time(spark):
    text = " ".join(f"id{i:07d} u{i}@m.co 10.0.{i % 300}.7" for i in range(16_000))
    began = time.perf_counter()
    got = pii.report(pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()[0]
    assert got["n_email"] == 16_000 and got["base_sha256"] == hashlib.sha256(",".join(base(text)).encode()).hexdigest()
    assert time.perf_counter() - began < 60
