"""The prefix trie against a brute-force dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lemmata.llm import trie
from tests.llm.conftest import LONG

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def sig(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def conversations(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            out[conv].append((turn is not None, turn or 0, sig(role, text), role, text))
    return {c: [t[3:] for t in sorted(v)] for c, v in out.items()}


def regrown(convs, every=5, heads=9):
    out = {}
    for c, own in convs.items():
        base = c - (abs(c) % every) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % heads
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved = Counter(), Counter()
    for node, who in members.items():
        own = (len(who) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += own
    out = Counter()
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(convs[c]) == len(node)))
        out[min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def found(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_rebuilt_conversations_against_brute_force(spark):
    r = random.Random(5)
    rows = []
    for c in r.sample(range(-40, 260), 220):
        for t in range(r.choice([1, 2, 5, 8, 12])):
            rows.append((c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(["a", "b", "é😀", None, "", "long text"])))
    rows += [rows[0], rows[0], (None, 1, "user", "nobody's"), (10, 3, "user", LONG)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumn("pos", F.lit("x")).withColumn("sig", F.lit(1)).withColumn("node", F.lit(0))
    assert found(trie.trie(*trie.regrown(df))) == brute(regrown(conversations(rows)))
    assert found(trie.trie(*trie.as_they_are(df))) == brute(conversations(rows))


def test_long_conversations_and_shared_beginnings(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 7)  # prefixes over many blocks
    monkeypatch.setattr(trie, "CHUNK", 4)  # and ends over many chunks
    rows = [(c, t, "u", f"{t // (40 + 10 * (c % 3))}") for c in range(0, 60, 5) for t in range(100 + c % 7)]
    rows += [(1000 + c, t, "u", "same") for c in range(50) for t in range(3)]  # one conversation, many times
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert found(trie.trie(*trie.as_they_are(df))) == brute(conversations(rows))


def test_rounds_are_logarithmic(spark, monkeypatch):
    n = 300
    nodes = spark.range(1, n + 1).select(
        F.col("id").cast("string").alias("node"), F.when(F.col("id") > 1, (F.col("id") - 1).cast("string")).otherwise(trie.ROOT).alias("parent"), F.col("id").alias("depth"), (F.col("id") == n).cast("long").alias("leaves"), F.col("id").alias("saved")
    )
    rounds, join = [], trie._graph.spread_join
    monkeypatch.setattr(trie._graph, "spread_join", lambda *a, **k: rounds.append(1) or join(*a, **k))
    got = {int(r["node"]): (r["leaves"], r["saved"]) for r in trie.rolled_up(nodes).collect()}
    assert got == {i: (1, sum(range(i, n + 1))) for i in range(1, n + 1)}
    assert len(rounds) == 9


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")]])
def test_no_conversations(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert trie.trie(*trie.regrown(df)).isEmpty()


def test_turnless(spark):
    rows = [(c, None, None, None) for c in (1, 2, 3, 6, 7)]  # bases 0 and 5 are absent
    got = trie.trie(*trie.regrown(spark.createDataFrame(rows, SCHEMA)))
    assert found(got) == brute(regrown(conversations(rows)))
    assert {r["depth"] for r in got.collect()} == {0} or got.where("depth = 0").count() == 1
