"""Vector and keyword retrieval, chunking and neighbour context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmata.operators import nearest, patterns


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a, b) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def topk(queries: DataFrame, rows: DataFrame, k: int, measure: str = "dot") -> DataFrame:
    """The k best rows (id, vec) of each query (qid, qvec); ties to the smaller id. Exact, by an index made for the call (`nearest`)."""
    return nearest.topk(queries, nearest.build(rows), k, measure)


def mean_pool(tokens: DataFrame, key: str, vec: str, mask: str) -> DataFrame:
    """Mean of the token vectors of each key under a mask; an empty mask gives zeros."""
    each = tokens.select(key, F.col(mask).cast("double").alias("m"), F.posexplode(vec).alias("dim", "v"))
    pooled = each.groupBy(key, "dim").agg((F.sum(F.col("v").cast("double") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1e-9))).alias("v"))
    return pooled.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias("vec"))


def chunks(docs: DataFrame, size: int, overlap: int, text: str = "text") -> DataFrame:
    """Fixed character windows of `size` that overlap; the last one may be short."""
    step = size - overlap
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(text) - overlap) / step) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    each = docs.withColumn("chunk", F.explode(starts))
    return each.withColumn("content", F.substring(F.col(text), F.col("chunk") * step + 1, F.lit(size)))


def neighbours(blocks: DataFrame, part: list[str], order: str, content: str = "content") -> DataFrame:
    """Previous, own and next block joined; edges are empty."""
    w = Window.partitionBy(*part).orderBy(order)
    near = [F.coalesce(F.lag(content).over(w), F.lit("")), F.coalesce(F.col(content), F.lit("")), F.coalesce(F.lead(content).over(w), F.lit(""))]
    return blocks.withColumn("context", F.concat_ws("\n", *near))


def islands(rows: DataFrame, part: list[str], order: str, flag: str) -> DataFrame:
    """Number of the run of equal flags that a row belongs to (gaps and islands)."""
    w = Window.partitionBy(*part).orderBy(order)
    new = F.coalesce((~F.col(flag).eqNullSafe(F.lag(flag).over(w))).cast("int"), F.lit(1))
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w)).drop("_new")


def contains_join(left: DataFrame, text: str, right: DataFrame, op: str, exact: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Rows (their columns `keep`, default all) whose text contains an operator; exact: as a whole token."""
    if exact:
        token = left.withColumn("_tok", F.explode(F.array_distinct(F.split(text, r"\s+"))))
        return token.join(right, F.col("_tok") == F.col(op)).select(*(keep or left.columns), *right.columns)
    return patterns.contained(left, text, right, op, keep)


def regex_join(left: DataFrame, text: str, rules: DataFrame, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """Rows (their columns `keep`, default all) whose text matches a rule's regular expression."""
    return patterns.matched(left, text, rules, pattern, keep)


def embed(text, dim: int = 16) -> Column:
    """A deterministic stand-in for an embedding model: hashed word counts of the whole text, of length 1 (zeros without words)."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    slots = F.transform(F.regexp_extract_all(lower, F.lit("([a-z]+)"), F.lit(1)), lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dim)
    counts = lambda s: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(s, lambda x: x == i)).cast("double"))
    unit = lambda v: F.transform(v, lambda x: x / F.greatest(norm(v), F.lit(1e-9)))
    return F.transform(F.transform(F.array(slots), counts), unit)[0]


def load_or_build(spark, path: str, build) -> DataFrame:
    """A store kept as Parquet: read if it is there, else built and written."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    build().write.mode("error").parquet(path)
    return spark.read.parquet(path)
