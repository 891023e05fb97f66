"""The pipeline on a small corpus with every defined case, stage by stage against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from lemmata.llm import mixing, toxicity
from tests.llm.test_decontam import brute as hits
from tests.llm.test_operators import brute_components, whole

COLUMNS = "doc_id long, text string, source string, score double, uses int, node string, _id long, block string"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    texts = [say(r.choice([4, 12, 40, 70])) for _ in range(160)]
    for _ in range(60):
        t = list(r.choice(texts))
        if r.random() < 0.6:
            t[r.randrange(len(t))] = "changed"
        texts.append(t)
    items = [(i, " ".join(say(14))) for i in range(6)] + [(6, None)]
    docs, labels = [], []
    for i, t in enumerate(texts):
        bad = r.random() < 0.2
        if bad:
            t = [*t[:2], "grumble", *t[2:]]
        elif i % 17 == 0:
            t = [*t, *items[i % 6][1].split()]
        docs.append((i, " ".join(t), r.choice(["big", "big", "big", "small", None])))
        labels.append((i, 1, int(bad)))
    docs += [(900, None, "big"), (901, "", None), (902, " \n ", "small"), (903, "long " * 30_000, "big"), (None, "no id at all here", "big"), docs[3], docs[3], (5, "another text under an id", "small")]
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, s, 0.5, 7, "n", 1, "b") for i, t, s in docs]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def key(df):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())


def test_each_stage_against_brute_force(spark, corpus):
    folder, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(P.STAGES)

    scored = Counter((r["doc_id"], r["score"] < 0.3) for r in toxicity.score(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect())
    first = stage["toxicity"](spark, docs, folder)
    assert first.columns == docs.columns
    kept = key(first)
    by_id = Counter()
    for (i, _, _), n in kept.items():
        by_id[i] += n
    assert by_id == Counter({i: n for (i, ok), n in scored.items() if ok})
    toxic = [k for k in key(docs) if k[1] and "grumble" in k[1]]
    clean = [k for k in key(docs) if k not in toxic]
    assert sum(k in kept for k in toxic) <= 0.1 * len(toxic) and sum(k in kept for k in clean) >= 0.9 * len(clean)

    second = stage["n-gram Jaccard join"](spark, first, folder)
    flat = [(k, n) for k, n in kept.items() for _ in range(n)]
    brute = brute_components([(i, k[1] or "") for i, (k, _) in enumerate(flat)])
    want, led = Counter(), set()
    for i, (k, _) in sorted(enumerate(flat), key=lambda x: (x[1][0][0] is None, x[1][0][0] or 0)):
        if brute[i][0] and k[0] is not None:
            if brute[i][1] in led:
                continue
            led.add(brute[i][1])
        want[k] += 1
    assert second.columns == docs.columns and key(second) == want

    third = stage["benchmark decontamination"](spark, second, folder)
    clean = Counter({k: n for k, n in want.items() if not hits(k[1], items)[1]})
    assert third.columns == docs.columns and key(third) == clean and sum(clean.values()) < sum(want.values())

    fourth = stage["mixing sources"](spark, third, folder)
    uses = Counter()
    for r in mixing.mix(third, entropy=P.ENTROPY, repeats=P.REPEATS, fill=True).collect():
        uses[r["doc_id"], r["source"], r["n_tokens"]] += r["uses"]
    mixed = key(fourth)
    assert fourth.columns == docs.columns and set(mixed) == set(clean)
    got = Counter()
    for (i, t, s), n in mixed.items():
        got[i, s, len((t or "").encode().split())] += n
    assert got == uses

    last = stage["token-ID output"](spark, fourth, folder).collect()
    want = sorted(((i is not None, i or 0, zlib.crc32(np.array(whole([t])[0].ids + [2], "<u4").tobytes())) for (i, t, _), n in mixed.items() for _ in range(n)))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids_crc32"]) for r in last) == want
    start = 0
    for r in sorted(last, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]


def test_run_and_empty_tables(spark, corpus, tmp_path):
    folder, _ = corpus
    assert P.run(spark, folder).count() > 100
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
