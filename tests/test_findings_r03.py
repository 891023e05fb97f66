"""One small test for each settled finding of FINDINGS_r03.md on the reference's operators."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lemmata import queries, queries_more  # noqa: F401
from lemmata.operators import nearest as N


def test_lines_whose_shown_numbers_meet(spark, tmp_path):
    # 2 * 1000 + 1001 == 3 * 1000 + 1: one is bad, the other fine
    rows = [(1, 2, 1001, 4), (1, 3, 1, 4), (1, 5, 7, 6), (2, 5, 2000, 8), (2, 7, 0, 8)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey int, l_partkey int").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted((r["file"], r["line"], r["value"]) for r in queries.QUERIES["comment_fixpoint"](spark, str(tmp_path)).collect())
    assert got == [(1, 3001, "// bad"), (1, 3001, "fine"), (1, 5007, "// bad"), (2, 7000, "// bad"), (2, 7000, "fine")]


def _peak(f) -> float:
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_the_fit_of_centres_holds_no_matrix_of_all_pairs():
    x = np.random.default_rng(1).standard_normal((60_000, 16))
    assert _peak(lambda: N._centres(x, 500)) < 120  # rows x centres are 240 MB


def test_the_sample_is_bounded_by_the_centres(spark):
    rows = spark.range(20_000).selectExpr("id", "array(cast(id % 101 as double), cast(id % 7 as double)) as vec")
    assert len(N._sample(rows, 20_000, 640, 2)) <= 640
    same = spark.range(5000).selectExpr("cast(1 as long) as id", "array(1.0d, 2.0d) as vec")
    assert len(N._sample(same, 5000, 10, 2)) == 10


@pytest.mark.parametrize("measure", ["dot", "l2"])
def test_visits_and_copies_are_held_in_parts(measure):
    rng = np.random.default_rng(2)
    c = rng.standard_normal((600, 64))
    q = pa.RecordBatch.from_arrays([pa.array(np.arange(2000)), pa.array(list(rng.standard_normal((2000, 64)))), pa.nulls(2000, pa.float64())], ["qid", "qvec", "worst"])
    size = np.full(600, 100)
    facts = (c, np.full(600, 9.0), size, N._bins(size))
    rows = []
    assert _peak(lambda: rows.extend((b.num_rows, b.nbytes) for b in N._rest([q], facts, 4, measure))) < 250
    # every query visits every cluster but its nearest; its vector travels once to a bin of 40 clusters
    assert sum(n for n, _ in rows) == 2000 * 15 and max(n for _, n in rows) < 64 << 20
    x = np.repeat(rng.standard_normal((2, 64)), 1000, 0)
    table = pa.table({"cluster": np.zeros(2000, np.int32), "id": np.arange(2000), "vec": list(x)})
    asked = pa.table({"qid": np.arange(1000), "qvec": list(rng.standard_normal((1000, 64))), "clusters": pa.array([[0]] * 1000, pa.list_(pa.int32()))})
    best = []
    assert _peak(lambda: best.append(N._best(asked, table, 5, measure))) < 100  # a third of the pairs would be 300 MB
    assert len(best[0]) == 5000 and set(best[0].column("id").to_pylist()) <= {*range(5), *range(1000, 1005)}
