"""Decontamination against brute force, with one block and with many."""

import random
import re
import time

import pyarrow as pa
import pytest

from lemmata.llm import decontam
from lemmata.llm._bytes import ALNUM, LOWER, words


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text, items, window=10):
    """(n_words, hits, items, longest, its place)."""
    d = cut(text)
    hit, found, best = set(), set(), (0, 0)
    for item, other in items:
        x = cut(other)
        k = min(window, len(x))
        for q in range(len(x) - k + 1 if k else 0):
            for p in range(len(d) - k + 1):
                if d[p : p + k] == x[q : q + k]:
                    n = k
                    while p + n < len(d) and q + n < len(x) and d[p + n] == x[q + n]:
                        n += 1
                    hit.update(range(p, p + k))
                    found.add(item)
                    best = max(best, (n, -p))
    runs = []
    for i in sorted(hit):
        if runs and runs[-1] == i:
            runs[-1] = i + 1
        else:
            runs += [i, i + 1]
    return len(d), runs, sorted(x for x in found if x is not None), best[0], -best[1] if best[0] else -1


@pytest.mark.parametrize("block", [decontam.BLOCK, 60])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK", block)
    r = random.Random(4)
    vocabulary = ["a", "b", "É", "x9"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, say(r.choice([3, 10, 14, 25]))) for i in range(8)] + [(8, "a " * 30), (None, say(12)), (9, None), (10, "--"), (3, say(11))]
    docs = [(i % 25, say(r.choice([0, 2, 9, 40, 80]))) for i in range(40)]
    docs += [(i, "b a " + items[i % 8][1] + " x9, " + items[(i + 3) % 8][1]) for i in range(10)] + [(77, "a " * 60), (77, None), (None, items[0][1])]
    docs += [docs[45], docs[45]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [(x["doc_id"], x["n_words"], tuple(x["hits"]), tuple(sorted(x["items"])), x["longest"], x["longest_at"]) for x in decontam.matches(df, bench).collect()]
    want = [(i, n, tuple(h), tuple(f), m, p) for i, t in docs for n, h, f, m, p in [brute(t, items)]]
    key = lambda x: str(x)
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = sorted(str(x["doc_id"]) for x in decontam.decontaminate(df, bench).collect())
    assert kept == sorted(str(x[0]) for x in want if not x[2])


def test_repeated_words_are_not_expanded():
    items = decontam.prepare([1, 2], ["same " * 310, "same " * 200], 10)
    began = time.perf_counter()
    for w in words(pa.array(["same " * 80_000, "other same " * 100], pa.large_string()), ALNUM, LOWER, decontam.SHARD):
        hits, found, longest, place = decontam.scan(w, items)
    assert hits == [[0, 80_000], []] and found == [[1, 2], []] and longest == [310, 0] and place == [0, -1]
    assert time.perf_counter() - began < 20
