
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from lemmata.llm import ann, jaccard, mixing, pii, toxicity, urls


def rows(df):
    return [r.asDict() for r in df.collect()]


def others(spark, texts):
    """The texts of the spans of kind `other`, by document."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["all"] if s["kind"] == 4] for r in rows(pii.find(df))}


def test_pii_every_base_kind_seeds_the_bootstrap(spark):
    def card(i):
        body = f"41111111111{i:04d}"
        sums = [sum(d * 2 // 10 + d * 2 % 10 if k % 2 else d for k, d in enumerate(map(int, reversed(body + c)))) for c in "0123456789"]
        whole = body + str([s % 10 for s in sums].index(0))
        return " ".join(whole[k : k + 4] for k in range(0, 16, 4))

    texts = [f"please dial +1 (743) 555-{3000 + i} today" for i in range(20)] + [f"then charge {card(i)} today" for i in range(20)]
    texts += [f"from host 10.0.{i % 5}.{i % 7} today" for i in range(20)] + [f"then write {chr(97 + i)}nn@mail.example today" for i in range(20)]
    unseen = ["please dial 0049 171 5550, today", "then charge REF-77-QX today", "from host srv-a-17 today", "then write jane@localhost today"]
    got = others(spark, texts + unseen)
    assert [got[80 + i] for i in range(4)] == [["0049 171 5550"], ["REF-77-QX"], ["srv-a-17"], ["jane@localhost"]]
    assert not any(got[i] for i in range(80))


def test_pii_promoted_entities_support_a_pattern(spark):
    texts = [f"from host 10.0.{i}.7 today" for i in range(100)]
    texts += [f"from host srv-x-{i:02d} today" for i in range(12)] + [f"from node srv-x-{i:02d} today" for i in range(12)]
    assert others(spark, [*texts, "from node box-y-77 today"])[124] == ["box-y-77"]


def test_urls_count_exactly_however_many_grams(spark):
    r = random.Random(2)
    slug = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    data = [(i, f"http://{'a.org/fr' if i % 2 else 'a.net'}/{slug()}") for i in range(6000)] + [(9000 + i, f"http://b.com/{slug()}") for i in range(20)]
    df = spark.createDataFrame(data, "page_id long, url string")
    held = {x["page_id"] for x in rows(df.where(F.pmod(F.xxhash64("url"), F.lit(urls.FOLDS)) == 0))}
    n = [Counter(), Counter()]
    for i, u in data[:6000]:
        if i not in held:
            for k in range(urls.ORDER + 1):
                for at in range(k, len(u)):
                    n[i % 2][u[at - k : at], "context"] += 1
                    n[i % 2][u[at - k : at + 1]] += 1

    def likelihood(u, c):
        total = 0.0
        for at in range(len(u)):
            p = 1 / 256
            for k in range(min(at, urls.ORDER) + 1):
                p = (n[c][u[at - k : at + 1]] + urls.WEIGHT * p) / (n[c][u[at - k : at], "context"] + urls.WEIGHT)
            total += math.log(p)
        return total / len(u)

    got = {x["page_id"]: x["score"] for x in rows(urls.judge(df))}
    assert len(got) == 6020
    assert all(abs(got[i] - (likelihood(u, 1) - likelihood(u, 0))) < 1e-9 for i, u in data[:40] + data[6000:])


def test_ann_small_shards_use_the_forest(spark, monkeypatch):
    def run(n):
        v = np.random.default_rng(n).standard_normal((n, 16)).astype(np.float32)
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
        return v, rows(ann.nearest(df, "vec_id % 20 = 0", k=10))

    for n in (8, 12, 500):
        v, got = run(n)
        assert all(sum(r["query_id"] == q for r in got) == min(10, n - 1) for q in range(0, n, 20))
    near = {q: set(np.argsort(((v - v[q]) ** 2).sum(1), kind="stable")[1:11]) for q in range(0, 500, 20)}
    assert sum(r["vec_id"] in near[r["query_id"]] for r in got) / len(got) >= 0.9

    built = ann.Forest.__init__
    monkeypatch.setattr(ann.Forest, "__init__", lambda self, *a, **k: (built(self, *a, **k), made.append(len(self.vectors)))[0])
    made, held = [], type("Held", (), {"value": (np.arange(3), v[:3])})
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(500)), pa.array(v.tolist(), pa.list_(pa.float32()))], ["vec_id", "v"])
    assert sum(b.num_rows for b in ann._search(iter([batch]), held, 16, 10, ann.EFFORT)) == 30 and made == [500]


def test_filled_mixture_searches_the_target_entropy(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "big" if i % 3 else "small") for i in range(3000)], "doc_id long, text string, source string")
    lo, hi = 0.0, 1.0
    for _ in range(60):
        e = (lo + hi) / 2
        p = (2 / 3) ** e / ((2 / 3) ** e + (1 / 3) ** e)
        lo, hi = (e, hi) if -p * math.log(p) - (1 - p) * math.log(1 - p) >= 0.95 * math.log(2) else (lo, e)
    small = 1000 * 2 ** (1 - lo)
    assert 1000 < small < 1240
    got = rows(mixing.mix(docs, entropy=0.95, repeats=4.0, fill=True))
    assert min(r["uses"] for r in got) == 1 and sum(r["uses"] for r in got if r["source"] == "big") == 2000
    assert abs(sum(r["uses"] for r in got if r["source"] == "small") - small) <= 1
    assert abs(corpus_pipeline.mix_sources(spark, docs, "").count() - 2000 - small) <= 1


def test_chain_is_fitted_on_segments_of_all_rows(monkeypatch):
    r = random.Random(4)
    toxic = np.array([i % 4 == 0 for i in range(600)]).astype(int)
    plain = lambda: " ".join(f"w{r.randrange(300)}" for _ in range(40))
    texts = [plain() + (" grumble" if i < 300 else " snarling") * int(toxic[i]) for i in range(600)]
    seen, fitted = [], toxicity._fit_chain
    monkeypatch.setattr(toxicity, "TRAIN_SEGMENTS", 30)
    monkeypatch.setattr(toxicity, "_fit_chain", lambda slots, y, *a: (seen.append((slots, y)), fitted(slots, y, *a))[1])
    toxicity.fit(pa.array(texts), toxic)
    slots, y = seen[0]
    assert 30 < len(y) <= 60 and (y.sum(1) > 0).sum() == 30
    assert len({tuple(x) for x in slots[y == 1].tolist()}) == 2


def test_keep_first_tells_rows_of_one_id_apart(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    docs = [(1, a), (5, a), (5, b), (5, b), (5, ""), (6, b), (7, c), (7, c + " end"), (7, b.replace("b", "d")), (8, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"][:1]) for r in rows(jaccard.keep_first(df)))
    assert got == [(1, "a"), (5, ""), (5, "b"), (7, "c"), (7, "d"), (8, "")]
