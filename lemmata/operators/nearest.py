"""Exact nearest rows that prune: clusters with radii and the triangle inequality.

Rows are dealt to the nearest of a few centres. A cluster at distance d from a query with radius r holds no
row nearer than d - r (and none with a larger product than q·c + |q| r). A query first visits its nearest
clusters until they hold k rows; the k-th best found bounds the rest, and only clusters whose
bound is no worse are visited. So the result is exact whatever the centres, and only its cost depends on them.

Centres are fitted on a bounded sample (`SAMPLE` bytes of rows and `EACH` rows a centre at most, by hash) and are few (`CENTRES`, at most the square
root of the rows), so they and the clusters' sizes go to every task. Clusters are packed into bins of about `ROWS` rows, a larger
cluster's bin is dealt into pieces of as many, and the queries that visit a bin into blocks of twice as many. A visit is a join by (bin, piece, block):
a query's vector travels once to a bin, with the list of the clusters that it visits there, no group grows with the data, and each hands
on k rows a query. Matrices between queries and centres or rows are made `CELLS` cells at a time. Of equal vectors in a group only the k
of smallest id are scored. Scores are summed in the order of the dimensions, so equal vectors score alike and ties go to the
smaller id.

Defined cases: vectors that are null, hold nulls or non-finite values, or differ in length from the
commonest take no part, as queries or as rows; repeated ids are rows of their own; with fewer than k rows, all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmata.session import cut

#: bytes of vectors that centres are fitted on, and rows for each centre; most centres; rounds of the fit; rows of a bin or piece
SAMPLE, EACH, CENTRES, ROUNDS, ROWS = 32 << 20, 32, 1024, 8, 4096
#: cells of a matrix that is held at once, and pairs that are scored exactly at once
CELLS, PAIRS = 1 << 20, 1 << 14
#: by how much a bound is loosened, as a part of its terms, for rounding
SLACK = 1e-9
_ROW = "cluster int, id long, vec array<double>, dist double"


@dataclass
class Index:
    """Rows (cluster, id, vec, dist), with the centres, radii and sizes of the clusters on the driver."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    size: np.ndarray


def _usable(df: DataFrame, vec: str, d: int | None = None) -> DataFrame:
    odd = F.exists(vec, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    good = df.withColumn(vec, F.col(vec).cast("array<double>")).where(f"size({vec}) > 0").where(~odd)
    return good if d is None else good.where(F.size(vec) == d)


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of rows to centres."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0))


def _own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    step = max(1, CELLS // len(c))
    return np.concatenate([np.zeros(0, np.int64), *[_far(x[a : a + step], c).argmin(1) for a in range(0, len(x), step)]])


def _centres(x: np.ndarray, n: int) -> np.ndarray:
    """Lloyd's rounds from evenly drawn rows; a centre without rows is left out."""
    c = x[np.random.default_rng(7).permutation(len(x))[:n]]
    for _ in range(ROUNDS):
        own = _own(x, c)
        held = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = total[held > 0] / held[held > 0, None]
    return c


def _deal(batches: Iterator[pa.RecordBatch], c: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = _matrix(b.column(1), c.shape[1])
        own = _own(x, c).astype(np.int32)
        dist = np.sqrt(((x - c[own]) ** 2).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(own), b.column(0), b.column(1), pa.array(dist)], ["cluster", "id", "vec", "dist"])


def _sample(usable: DataFrame, n: int, wanted: int, d: int) -> np.ndarray:
    """At most `wanted` rows by hash; hardly more than these leave the tasks."""
    chance = F.xxhash64("id", "vec")
    share = min(1.0, 1.2 * wanted / n + 100 / n)
    some = usable.where(chance <= F.lit(int(-(1 << 63) + share * ((1 << 64) - 1))) if share < 1 else F.lit(True))
    for rows in (some.orderBy(chance, "id"), usable):  # equal rows of one id may all be passed over by hash
        got = rows.limit(wanted).select("vec").toArrow()
        if got.num_rows:
            break
    return _matrix(got.column(0).combine_chunks(), d)


def build(rows: DataFrame, centres: int | None = None) -> Index | None:
    """The index of rows (id, vec); None without any that can take part."""
    usable = _usable(rows.select(F.col("id").cast("long").alias("id"), "vec"), "vec")
    common = usable.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return None
    d, n = common["d"], common["count"]
    usable = usable.where(F.size("vec") == d)
    most = centres or max(1, min(CENTRES, int(n**0.5)))
    wanted = max(1, min(n, SAMPLE // (8 * d), EACH * most))
    x = _sample(usable, n, wanted, d)
    c = _centres(x, min(len(x), most))
    return stored(cut(usable.mapInArrow(partial(_deal, c=c), _ROW)), c)


def stored(dealt: DataFrame, c: np.ndarray) -> Index:
    """The index of rows that have been dealt to centres, such as those read back from Parquet."""
    radius, size = np.zeros(len(c)), np.zeros(len(c), np.int64)
    for r in dealt.groupBy("cluster").agg(F.max("dist").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["cluster"]], size[r["cluster"]] = r["radius"], r["n"]
    return Index(dealt, c, radius, size)


def _bounds(q: np.ndarray, c: np.ndarray, radius: np.ndarray, measure: str) -> tuple[np.ndarray, np.ndarray]:
    """Per query and cluster the centre's score, and the least that a row may have (less is nearer)."""
    if measure == "l2":
        far = _far(q, c)
        # the distance's own rounding is about the root of its terms'
        return far, far - radius - SLACK * (1 + far + radius) - 1e-7 * (np.abs(q).max() + np.abs(c).max())
    product, reach = q @ c.T, np.sqrt((q * q).sum(1))[:, None] * radius
    return -product, -product - reach - SLACK * (1 + np.abs(product) + reach)


def _slices(b: pa.RecordBatch, centres: int) -> Iterator[pa.RecordBatch]:
    step = max(1, CELLS // centres)
    for a in range(0, b.num_rows, step):
        yield b.slice(a, step)


def _near(batches: Iterator[pa.RecordBatch], index: tuple, k: int, measure: str) -> Iterator[pa.RecordBatch]:
    """(qid, qvec, bin, clusters) of each query's nearest clusters, until they hold k rows."""
    c, radius, size, bins = index
    for whole in batches:
        for b in _slices(whole, len(c)):
            score, _ = _bounds(_matrix(b.column(1), c.shape[1]), c, radius, measure)
            yield from _visits(b, _first(score, size, k), bins)


def _first(score: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Whether a cluster (column) is among a query's nearest, until they hold k rows."""
    order = np.argsort(score, 1, kind="stable")
    many = np.cumsum(size[order], 1)
    before = np.hstack([np.zeros((len(score), 1), np.int64), many[:, :-1]])
    out = np.zeros(score.shape, bool)
    np.put_along_axis(out, order, before < k, 1)
    return out


def _rest(batches: Iterator[pa.RecordBatch], index: tuple, k: int, measure: str) -> Iterator[pa.RecordBatch]:
    """(qid, qvec, bin, clusters) of the further clusters that may hold a row as near as the k-th found (column worst; null: fewer)."""
    c, radius, size, bins = index
    for whole in batches:
        for b in _slices(whole, len(c)):
            score, least = _bounds(_matrix(b.column(1), c.shape[1]), c, radius, measure)
            worst = b.column(2).fill_null(np.inf).to_numpy(zero_copy_only=False)
            yield from _visits(b, (least <= worst[:, None]) & ~_first(score, size, k) & (size > 0), bins)


def _visits(b: pa.RecordBatch, chosen: np.ndarray, bins: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(qid, qvec, bin, clusters): of each query a row for every bin (of neighbouring clusters) that holds chosen clusters."""
    row, cluster = np.nonzero(chosen)
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (bins[cluster[1:]] != bins[cluster[:-1]])
    at = np.append(np.flatnonzero(fresh), len(row))
    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(cluster.astype(np.int32)))
    step = max(1, CELLS // max(1, len(b.column(1)[0]) if b.num_rows else 1))
    for a in range(0, len(at) - 1, step):
        head = at[a : min(a + step, len(at) - 1)]
        some = b.take(pa.array(row[head], pa.int64()))
        yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(bins[cluster[head]].astype(np.int32)), lists.slice(a, len(head))], ["qid", "qvec", "bin", "clusters"])


def _bins(size: np.ndarray) -> np.ndarray:
    """The bin of each cluster: neighbours together, up to `ROWS` rows."""
    out, now, held = np.zeros(len(size), np.int64), 0, 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > ROWS:
            now, held = now + 1, 0
        out[i] = now
        held += n
    return out


def _exact(q: np.ndarray, x: np.ndarray, measure: str) -> np.ndarray:
    """Scores of paired rows, summed dimension by dimension."""
    s = np.zeros(len(q))
    for j in range(q.shape[1]):
        s = s - q[:, j] * x[:, j] if measure == "dot" else s + (q[:, j] - x[:, j]) * (q[:, j] - x[:, j])
    return s if measure == "dot" else np.sqrt(s)


def _smallest(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that are among the k of smallest id of their vector."""
    same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((ids, same))
    head = np.searchsorted(same[order], same[order])
    return np.sort(order[np.arange(len(order)) - head < k])


def _best(queries: pa.Table, rows: pa.Table, k: int, measure: str) -> pa.Table:
    """The k best of a piece's rows for each query of a block, among the clusters that it visits."""
    found: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    if len(rows) and len(queries):
        d = len(rows.column("vec")[0])
        q, x = (_matrix(t.column(n).combine_chunks(), d) for t, n in ((queries, "qvec"), (rows, "vec")))
        ids, own = rows.column("id").to_numpy(), rows.column("cluster").to_numpy()
        lists = queries.column("clusters").combine_chunks()
        asked, who = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
        for cluster in np.unique(own).tolist():
            here, at = who[asked == cluster], np.flatnonzero(own == cluster)
            if not len(here):
                continue
            at = at[_smallest(x[at], ids[at], k)]
            step = max(1, CELLS // len(at))
            for a in range(0, len(here), step):
                r, c, s = _k_best(q[here[a : a + step]], x[at], ids[at], k, measure)
                found.append((here[a : a + step][r], ids[at][c], s))
    r, i, s = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3
    order = np.lexsort((i, s, r))
    r, i, s = r[order], i[order], s[order]
    top = np.arange(len(r)) - np.searchsorted(r, r) < k
    return pa.table({"qid": queries.column("qid").take(pa.array(r[top], pa.int64())), "id": pa.array(i[top], pa.int64()), "score": pa.array(s[top], pa.float64())})


def _k_best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, measure: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, of the row, score) of the k best rows of each query."""
    rough = -(q @ x.T) if measure == "dot" else _far(q, x)
    if len(x) > k:
        edge = np.partition(rough, k - 1, 1)[:, k - 1]
        loose = SLACK * (1 + np.abs(edge)) + 1e-7 * (np.abs(q).max() + np.abs(x).max()) * (1 if measure == "l2" else np.abs(x).max() * x.shape[1])
        r, c = np.nonzero(rough <= (edge + loose)[:, None])
    else:
        r, c = np.nonzero(np.ones(rough.shape, bool))
    s = np.concatenate([_exact(q[r[a : a + PAIRS]], x[c[a : a + PAIRS]], measure) for a in range(0, len(r), PAIRS)])
    order = np.lexsort((ids[c], s, r))
    r, c, s = r[order], c[order], s[order]
    top = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[top], c[top], s[top]


def _visited(visits: DataFrame, index: Index, k: int, measure: str) -> DataFrame:
    """(qid, id, score): the k best of every piece of the bins that a query visits."""
    bins = _bins(index.size)
    pieces = np.maximum(1, -(-np.bincount(bins, index.size).astype(np.int64) // ROWS))
    listed = lambda xs, at: F.get(F.array(*[F.lit(int(x)) for x in xs]), at)
    visits = cut(visits)
    blocks = visits.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / (2 * ROWS)).cast("int").alias("blocks"))
    asked = visits.join(F.broadcast(blocks), "bin").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), listed(pieces, F.col("bin")) - 1)))
    held = index.rows.withColumn("bin", listed(bins, F.col("cluster"))).join(F.broadcast(blocks), "bin").withColumn("piece", F.pmod(F.xxhash64("id"), listed(pieces, F.col("bin"))).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["bin", "piece", "block"]
    left, right = asked.select(*keys, "qid", "qvec", "clusters").groupBy(*keys), held.select(*keys, "cluster", "id", "vec").groupBy(*keys)
    return left.cogroup(right).applyInArrow(lambda q, x: _best(q, x, k, measure), "qid long, id long, score double")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("score", "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topk(queries: DataFrame, index: Index | None, k: int, measure: str = "dot") -> DataFrame:
    """(qid, id, score, rank): the k nearest rows of each query (qid, qvec), by largest product or, with "l2", smallest distance; ties to the smaller id."""
    schema = "qid long, id long, score double, rank int"
    if index is None:
        return queries.sparkSession.createDataFrame([], schema)
    hits = _both(queries, index, k, measure)[0]
    score = -F.col("score") if measure == "dot" else F.col("score")
    return _ranked(hits, k).select("qid", "id", score.alias("score"), "rank")


def _both(queries: DataFrame, index: Index, k: int, measure: str) -> tuple[DataFrame, list[DataFrame]]:
    """The hits of both rounds of visits, and the visits."""
    facts = (index.centres, index.radius, index.size, _bins(index.size))
    asked = _usable(queries.select(F.col("qid").cast("long").alias("qid"), "qvec"), "qvec", index.centres.shape[1])
    kind = "qid long, qvec array<double>, bin int, clusters array<int>"
    near = asked.mapInArrow(partial(_near, index=facts, k=k, measure=measure), kind)
    first = cut(_visited(near, index, k, measure))
    worst = _ranked(first, k).where(F.col("rank") == k).select("qid", F.col("score").alias("worst"))
    rest = asked.join(worst, "qid", "left").select("qid", "qvec", "worst").mapInArrow(partial(_rest, index=facts, k=k, measure=measure), kind)
    return first.unionByName(_visited(rest, index, k, measure)), [near, rest]


def looked_at(queries: DataFrame, index: Index, k: int, measure: str = "dot") -> float:
    """The share of all (query, row) pairs whose score is computed."""
    visits = _both(queries, index, k, measure)[1]
    sizes = queries.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(index.size)], "cluster int, n long")
    pairs = visits[0].unionByName(visits[1]).select(F.explode("clusters").alias("cluster")).join(F.broadcast(sizes), "cluster").agg(F.sum("n")).first()[0] or 0
    return pairs / max(1, queries.count() * int(index.size.sum()))
