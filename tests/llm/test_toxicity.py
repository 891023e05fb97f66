"""The chain's marginals and gradients against enumeration, and cut chains against whole ones."""

import itertools
import random

import numpy as np
import pyarrow as pa

from lemmata.llm import toxicity
from lemmata.llm._bytes import ALNUM, LOWER, words


def enumerated(u, moves):
    """Marginals of state 1, sums of pair marginals and the log of all weights, over every path."""
    n = len(u)
    total, one, both = 0.0, np.zeros(n), np.zeros((2, 2))
    for path in itertools.product((0, 1), repeat=n):
        x = np.exp(sum(u[i] * s for i, s in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
        total += x
        one += x * np.array(path)
        for a, b in itertools.pairwise(path):
            both[a, b] += x
    return one / total, both / total, np.log(total)


def test_marginals_and_pairs_against_enumeration():
    r = np.random.default_rng(1)
    lengths = np.array([9, 7, 7, 3, 1])
    u, moves = r.normal(0, 2, (5, 9)), r.normal(0, 1, (2, 2))
    got, pairs = toxicity.chain(u, lengths, moves, pairs=True)
    want = [enumerated(u[i, :n], moves) for i, n in enumerate(lengths)]
    for i, n in enumerate(lengths):
        assert np.allclose(got[i, :n], want[i][0])
    assert np.allclose(pairs, sum(w[1] for w in want))
    step = 1e-6  # the pairs are the gradient of the log of all weights
    for a, b in itertools.product((0, 1), repeat=2):
        more = moves.copy()
        more[a, b] += step
        rise = sum(enumerated(u[i, :n], more)[2] - want[i][2] for i, n in enumerate(lengths)) / step
        assert abs(rise - pairs[a, b]) < 1e-4


def test_cut_chains_give_the_marginals_of_whole_ones(monkeypatch):
    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(n)) for n in (1, 0, 17, 50, 64, 65, 900)]
    g = np.random.default_rng(2)
    model = toxicity.Model(g.normal(0, 0.6, toxicity.SLOTS).astype(np.float32), -0.3, g.normal(0, 1.5, (2, 2)), np.zeros(4), True)
    (w,) = words(pa.array(texts), ALNUM, LOWER)
    whole = []
    for size in (10**6, 16, 1):
        monkeypatch.setattr(toxicity, "SEGMENT", size)
        whole.append(toxicity.marginals(w, model))
    assert len(whole[0]) == len(w.start) and np.allclose(whole[0], whole[1]) and np.allclose(whole[0], whole[2])


def test_rows_of_one_id_are_learnt_from_by_hash(spark):
    docs = [(i, f"fine text number {i}") for i in range(60)] + [(i, f"other text {i} grumble") for i in range(60)]
    labels = [(i, i % 2) for i in range(60)] + [(4, 1), (5, None), (None, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    runs = []
    for order in (docs, docs[::-1]):
        df = spark.createDataFrame([*order, order[0]], "doc_id long, text string").repartition(7)
        runs.append(sorted((x["doc_id"], x["score"]) for x in toxicity.score(df, lab).collect()))
    assert [x for x in runs[0] if x[0] not in (0, 59)] == [x for x in runs[1] if x[0] not in (0, 59)]
