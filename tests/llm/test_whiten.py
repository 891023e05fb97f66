"""Whitening against dense eigenvectors, exact integers and the defined cases."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lemmata.llm import whiten


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def brute(vectors, k):
    """x of every row, exact sums over distinct ones, dense eigenpairs."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, d = len(fit), len(fit[0])
    s = [sum(r[j] for r in fit) for j in range(d)]
    centred = np.array([[float(Fraction(n * r[j] - s[j], n)) for j in range(d)] for r in fit])
    e, y = np.linalg.eigh(centred.T @ centred / n)
    e, y = e[::-1][:k], y[:, ::-1][:, :k]
    dev = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    rows = np.array([[float(Fraction(n * r[j] - s[j], n)) for j in range(d)] for r in x])
    return n, dev, rows @ y / np.sqrt(e), e / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize(("d", "count"), [(5, 60), (64, 300), (150, 400)])
def test_against_dense_eigenvectors(spark, d, count):
    rng = np.random.default_rng(d)
    v = (rng.standard_normal((count, d)) * np.linspace(1.5, 0.5, d)).astype(np.float32)
    v[7] = v[8]  # a repeated vector counts once
    got = whiten.whiten(frame(spark, [(i, x.tolist()) for i, x in enumerate(v)]).repartition(3), k=16).toPandas()
    k = min(16, d)
    n, dev, white, explained = brute(v, k)
    assert n == count - 1 and set(got["n"]) == {n} and len(got) == count * k
    found = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    found *= np.sign((found * white).sum(0))
    assert np.abs(found - white).max() < 1e-6
    assert got.groupby("vec_id")["deviation"].first().tolist() == dev
    assert np.allclose(got.groupby("component")["explained"].first(), explained, rtol=1e-8)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9


def test_iteration_certifies_flat_and_wide_spectra():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((600, 600)))[0]
    for values in (np.linspace(1.0, 0.9, 600), 10.0 ** -np.linspace(0, 9, 600), np.r_[np.ones(20), np.zeros(580)]):
        v = (q * values) @ q.T
        asked = []
        e, y, error, passes = whiten.leading_pairs(lambda b: asked.append(b.shape[1]) or v @ b, 600, 16)  # noqa: B023
        assert np.allclose(e, np.sort(values)[::-1][:16], rtol=1e-9)
        assert np.linalg.norm(v @ y - y * e, axis=0).max() <= 1e-12 and error <= whiten.EXACT
        assert np.allclose(y.T @ y, np.eye(16), atol=1e-10)
        assert max(asked) <= 32 and len(asked) == passes  # thin blocks only


def test_defined_cases(spark):
    rng = np.random.default_rng(5)
    good = rng.standard_normal((30, 4)).tolist()
    rows = list(enumerate(good)) + [(3, good[3]), (None, good[4])]
    odd = [(90, None), (91, []), (92, [None, 1.0, 2.0, 3.0]), (93, [float("nan"), 1.0, 2.0, 3.0]), (94, [float("inf"), 1.0, 2.0, 3.0]), (95, [1.0, 2.0])]
    df = frame(spark, rows + odd, "double").withColumn("x", F.lit("x")).withColumn("component", F.lit(1))
    got = whiten.whiten(df, k=16).toPandas()
    assert len(got) == 32 * 4 and set(got["component"]) == {1, 2, 3, 4} and set(got["n"]) == {30}
    assert got["vec_id"].isna().sum() == 4 and not set(got["vec_id"].dropna()) & {90, 91, 92, 93, 94, 95}
    assert len(set(got.loc[got["vec_id"] == 3, "whitened"])) == 4  # repeated rows alike


def test_few_distinct_vectors_and_none(spark):
    same = whiten.whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(5)]))
    assert same.isEmpty() and "whitened" in same.columns
    assert whiten.whiten(frame(spark, [(1, None)])).isEmpty()
    line = whiten.whiten(frame(spark, [(i, [float(i), float(2 * i), 0.0]) for i in range(6)])).toPandas()
    assert set(line["component"]) == {1} and abs(line["explained"][0] - 1) < 1e-12


def test_huge_entries(spark):
    got = whiten.whiten(frame(spark, [(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [0.0, 2.0])], "double")).toPandas()
    assert got["deviation"].isna().any() and np.isfinite(got["whitened"]).all()
