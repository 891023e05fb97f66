"""Near copies whose rows have no doc_id, or share one."""

import random
import time
from collections import Counter

from lemmata.llm import jaccard
from tests.llm.test_operators import brute_components


def near_copies(n, seed, words=120):
    r = random.Random(seed)
    base = [f"w{r.randrange(10_000)}" for _ in range(words)]
    out = []
    for i in range(n):
        t = list(base)
        t[i % words] = f"changed{i}"
        out.append(" ".join(t))
    return out


def test_null_and_repeated_ids_against_brute_force(spark):
    r = random.Random(2)
    texts = near_copies(120, 1) + near_copies(80, 2) + [" ".join(f"x{r.randrange(500)}" for _ in range(40)) for _ in range(120)]
    texts += texts[:30]
    ids = [None if i % 3 == 0 else 7 if i % 3 == 1 else 1000 + i for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)
    got = Counter((x["doc_id"], x["component_id"], x["n_links"]) for x in jaccard.jaccard_join(df).collect())
    rows = [(i, t) for i, t in enumerate(texts)]  # the brute force names rows by place
    found, least = brute_components(rows), {}
    for i, (_, c, _) in found.items():
        if ids[i] is not None:
            least[c] = min(least.get(c, ids[i]), ids[i])
    assert got == Counter((ids[i], least.get(c), n) for i, (_, c, n) in found.items())


def test_null_ids_take_no_longer(spark):
    texts = near_copies(1200, 3)
    took = {}
    for kind in ("warm", "own", "none"):
        df = spark.createDataFrame([(None if kind == "none" else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
        began = time.time()
        got = {(x["component_id"], x["n_links"]) for x in jaccard.jaccard_join(df).collect()}
        took[kind] = time.time() - began
        assert len({c for c, _ in got}) == 1 and len(got) >= 1
    assert took["none"] < 3 * took["own"] + 5
