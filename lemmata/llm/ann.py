"""Approximate nearest neighbours with a hash-prefix forest.

Vectors are dealt into shards. In a shard every tree hashes each vector to a long bit string (signs of
projections on random hyperplanes, after the shard's mean is taken off) and keeps the strings as one
sorted array. A query descends in every tree to the entries that share the longest prefix with it;
then all trees ascend level by level together until the prefixes leave enough candidates. Candidates
are ranked by exact Euclidean distance in double precision, and the shards' nearest are merged.

`EFFORT` (entries over all trees that end the ascent, for each vector of the shard) sets the recall: on
vectors spread evenly over the sphere, the hardest case, 1.2 gives 0.99. The ascent never ends with
fewer entries than make sure of k candidates; a shard with no more vectors than k is found whole at
level 0. Queries never pass the driver: they are written in blocks of bounded size to the folder that the
cluster shares, and a task builds its shard's forest once and reads block after block.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor
do those whose length is not the most frequent one (of equals the smaller); of rows that share a
vec_id each is a candidate of other queries, and the first by content is the query; a null vec_id is
no query and no candidate; candidates at equal distances are ranked by vec_id, the smaller first; further columns, whatever
their names, are ignored. Fewer candidates than k give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmata.llm.binary import filesystem, work_folder

TREES, BITS, EFFORT = 24, 64, 1.5
#: vectors in a shard at most, queries in a block on average
SHARD, QUERIES = 1 << 16, 20_000
U = np.uint64


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Forest:
    """Sorted arrays of hash strings over the rows of `vectors`."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, seed: int = 5):
        self.vectors = vectors
        self.mean = vectors.mean(0, dtype=np.float64)
        planes = np.random.default_rng(seed).standard_normal((trees, vectors.shape[1], BITS))
        self.planes = planes.astype(np.float32)
        self.keys, self.order = [], []
        for t in range(trees):
            k = self.hash(vectors, t)
            o = np.argsort(k, kind="stable")
            self.keys.append(k[o])
            self.order.append(o.astype(np.int32))

    def hash(self, x: np.ndarray, t: int) -> np.ndarray:
        bits = (x - self.mean).astype(np.float32) @ self.planes[t] > 0
        return np.packbits(bits, axis=1).view(">u8").ravel().astype(U)

    def _ranges(self, strings: list[np.ndarray], level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query the entries that share the first `level` bits."""
        low = np.where(level >= BITS, U(0), U(2**64 - 1) >> np.minimum(level, BITS - 1).astype(U))
        lo = np.stack([np.searchsorted(k, s & ~low, "left") for k, s in zip(self.keys, strings, strict=True)])
        hi = np.stack([np.searchsorted(k, s | low, "right") for k, s in zip(self.keys, strings, strict=True)])
        return lo, hi

    def candidates(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """Rows found for each query: the deepest common level of all trees that leaves enough entries."""
        strings = [self.hash(queries, t) for t in range(len(self.keys))]
        deep, shallow = np.full(len(queries), BITS), np.zeros(len(queries), np.int64)  # too few at `deep`, enough at `shallow`
        while (deep - shallow > 1).any():
            level = (deep + shallow) // 2
            lo, hi = self._ranges(strings, level)
            full = (hi - lo).sum(0) >= enough
            shallow, deep = np.where(full, level, shallow), np.where(full, deep, np.maximum(level, shallow + 1))
        lo, hi = self._ranges(strings, shallow)
        for q in range(len(queries)):
            yield np.unique(np.concatenate([o[a:b] for o, a, b in zip(self.order, lo[:, q].tolist(), hi[:, q].tolist(), strict=True)]))


@dataclass
class QueryFile:
    """A block of queries (vec_id, v) in a Parquet file of the shared folder."""

    path: str
    dim: int

    @property
    def value(self) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow.parquet as pq

        fs, where = filesystem(self.path)
        with fs.open_input_file(where) as source:
            block = pq.read_table(source, columns=["vec_id", "v"]).combine_chunks()
        return block.column("vec_id").to_numpy(), matrix(block.column("v").combine_chunks(), self.dim)


def _search(batches: Iterator[pa.RecordBatch], queries, dim: int, k: int, effort: float) -> Iterator[pa.RecordBatch]:
    """Each query's k nearest of each shard; `queries` is a block or a list of blocks, loaded one at a time."""
    blocks = queries if isinstance(queries, list) else [queries]

    def shard(held):
        who = np.concatenate([x for x, _ in held])
        rows = np.concatenate([x for _, x in held])
        forest = Forest(rows)
        enough = max(int(effort * len(rows)), len(forest.keys) * (k + 1))  # one tree then has k others than the query
        for block in blocks:
            ids, vectors = block.value
            out = []
            for a in range(0, len(ids), 512):
                some = vectors[a : a + 512]
                for i, rowset in enumerate(forest.candidates(some, enough)):
                    rowset = rowset[who[rowset] != ids[a + i]]
                    d = np.sqrt(((rows[rowset].astype(np.float64) - some[i].astype(np.float64)) ** 2).sum(1))
                    if len(d) > k:
                        least = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                        rowset, d = rowset[least], d[least]
                    best = np.lexsort((who[rowset], d))[:k]
                    out.append((np.full(len(best), ids[a + i]), who[rowset[best]], d[best]))
            yield from send(out)

    def send(out):
        for a in range(0, len(out), 2000):
            q, v, s = (np.concatenate(x) for x in zip(*out[a : a + 2000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append((b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1), dim)))
            size += b.num_rows
        if size >= SHARD:
            yield from shard(held)
            held, size = [], 0
    if size:
        yield from shard(held)


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def nearest(vectors: DataFrame, is_query, k: int = 10, effort: float = EFFORT, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest found of each query row: query_id, rank (from 1), vec_id, score (distance).

    `is_query` is a condition on vec_id. All usable rows are indexed and searched.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    out = "query_id long, vec_id long, score double"
    if common is None:
        found = spark.createDataFrame([], out)
    else:
        dim = common["dim"]
        rows = rows.where(F.size("v") == dim)
        asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
        n_asked = rows.where(is_query).select("vec_id").distinct().count()
        folder = work_folder(spark, "ann-queries")
        asked.repartition(max(1, -(-n_asked // QUERIES)), "vec_id").write.parquet(folder)
        blocks = [QueryFile(x, dim) for x in sorted(spark.read.parquet(folder).inputFiles())]
        shards = max(1, -(-int(common["count"]) // SHARD))
        dealt = rows.repartition(max(shards, min(8, -(-int(common["count"]) // 8192))))
        found = dealt.mapInArrow(partial(_search, queries=blocks, dim=dim, k=k, effort=effort), out)
    near = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
