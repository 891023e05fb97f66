"""Mixing sources to target weights by temperature.

Each source's share of the tokens is raised to an exponent in [0, 1] and normalised. The exponent is
bisected (six halvings to a job, over the small table of sources) until the weights meet a target
entropy or a limit on how often a source repeats. A token budget then gives each source a quota:
whole passes over the source, and a rest that is taken from a permutation of its blocks: whole blocks
in permuted order, and within the block where the rest ends, documents in permuted order.

DataFrame functions only. Documents are dealt into blocks by a hash, so a source that holds a third
of all rows is spread over its blocks and no window covers more than one block's documents.

Defined cases: tokens are the maximal runs of characters other than ASCII white space; null and empty
texts have none; a source without tokens gets weight 0 and each of its documents is used once; the
null source is a source; very long texts are counted whole; repeated rows (doc_id and text) are used each, all as often; a null doc_id is hashed as the empty string;
further columns are ignored by `mix` and kept by `apply_mix`. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmata.llm import _graph

BLOCK_DOCS = 4096
#: halvings of the exponent's interval, and those that one job evaluates
HALVINGS, AT_ONCE = 42, 6
WORD = r"[^\x20\x09-\x0D]+"


def _mark(seed: int, *cols):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def _exponent(totals: DataFrame, all_tokens: int, sources: int, budget: Callable[[float, float], float], entropy: float | None, repeats: float | None) -> float:
    """The largest exponent whose entropy reaches its target, raised to the least that keeps the limit.

    budget: of an exponent and the sum of its powers.
    """
    import math

    shares = totals.where("tokens > 0").select(F.log(F.col("tokens") / F.lit(float(all_tokens))).alias("q"))

    def search(good) -> tuple[float, float]:
        lo, hi, left = 0.0, 1.0, HALVINGS
        while left > 0:
            n = 2 ** min(AT_ONCE, left)
            tried = [lo + (hi - lo) * i / n for i in range(1, n)]
            at = shares.withColumn("e", F.explode(F.array(*[F.lit(x) for x in tried])))
            z = at.groupBy("e").agg(
                F.sum(F.exp(F.col("e") * F.col("q"))).alias("z"), F.sum(F.exp(F.col("e") * F.col("q")) * F.col("q")).alias("zq"), F.max(F.exp((F.col("e") - 1) * F.col("q"))).alias("most")
            )
            rows = sorted((r["e"], good(r["e"], r["z"], r["zq"], r["most"])) for r in z.collect())
            k = sum(ok for _, ok in rows)  # monotone: true below the answer
            lo, hi = (rows[k - 1][0] if k else lo), (rows[k][0] if k < len(rows) else hi)
            left -= min(AT_ONCE, left)
        return lo, hi

    e = 1.0
    if entropy is not None and sources > 1:
        target = entropy * math.log(sources)
        lo, hi = search(lambda e, z, zq, _: math.log(z) - e * zq / z >= target)
        e = (lo + hi) / 2
    if repeats is not None:
        lo, hi = search(lambda e, z, _, most: budget(e, z) * most / (z * all_tokens) > repeats)
        least = 0.0 if hi <= 2.0**-HALVINGS else (lo + hi) / 2
        e = max(e, least) if entropy is not None else least
    return e


def mix(docs: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: float | None = None, fill: bool = False, seed: int = 7, source_col: str = "source") -> DataFrame:
    """Per row of `docs`: doc_id, source, n_tokens, weight (of its source) and uses (passes over the row).

    entropy: target as a part of the most possible, of the weights; repeats: most passes over a
    source; budget: tokens of the mixture (default: as many as there are). fill: instead of a budget,
    the largest source is used once and the others as often as the weights ask, so every document is
    kept; the exponent is searched as ever.
    """
    if entropy is None and repeats is None:
        raise ValueError("give a target entropy or a repetition limit")
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), tokens.alias("n_tokens"), F.xxhash64("text").alias("tie"))
    slim = _graph.cut(slim)
    n_docs, all_tokens = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    n_blocks = max(1, -(-n_docs // BLOCK_DOCS))
    mark = _mark(seed, F.col("doc_id"))
    dealt = slim.withColumn("mark", mark).withColumn("block", F.pmod(F.conv(F.substring("mark", 1, 8), 16, 10).cast("long"), F.lit(n_blocks)))
    blocks = _graph.cut(dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens")))
    totals = _graph.cut(blocks.groupBy("source").agg(F.sum("block_tokens").alias("tokens")))
    sources = totals.where("tokens > 0").count()
    largest = (totals.agg(F.max("tokens")).first()[0] if fill else None) or 0
    fixed = float(all_tokens if budget is None else budget)
    given = (lambda e, z: largest * z / (largest / all_tokens) ** e) if largest else (lambda e, z: fixed)
    e = _exponent(totals, all_tokens, sources, given, entropy, repeats) if all_tokens else 1.0
    q = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(all_tokens or 1)), F.lit(e))).otherwise(0.0)
    z = totals.agg(F.sum(q)).first()[0] or 1.0
    quota = totals.withColumn("weight", q / F.lit(z)).withColumn("quota", F.col("weight") * F.lit(given(e, z)))
    # a hair of tolerance, so that a quota of exactly n passes is n passes
    quota = quota.withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens") + 1e-9)).otherwise(1))
    quota = quota.withColumn("rest", F.greatest(F.lit(0.0), F.col("quota") - F.col("full") * F.col("tokens")) + 1e-6)
    order = Window.partitionBy("source").orderBy(_mark(seed, F.lit("block"), F.col("block")), "block")
    placed = blocks.withColumn("before", F.sum("block_tokens").over(order) - F.col("block_tokens"))
    decided = placed.alias("b").join(quota.alias("q"), F.col("b.source").eqNullSafe(F.col("q.source"))).select(
        F.col("b.source").alias("_source"), F.col("b.block").alias("_block"), "weight", "full", (F.col("rest") - F.col("before")).alias("left"), "tokens"
    )
    inside = Window.partitionBy("source", "block").orderBy("mark", "doc_id", "tie").rangeBetween(Window.unboundedPreceding, 0)  # repeated rows together
    run = dealt.withColumn("upto", F.sum("n_tokens").over(inside))
    joined = run.join(decided, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    uses = F.when(F.col("tokens") == 0, F.lit(1)).otherwise(F.col("full") + (F.col("upto") <= F.col("left")).cast("int"))
    return joined.select("doc_id", "source", "n_tokens", "weight", uses.cast("int").alias("uses"), "tie", "block")


def realise(mixed: DataFrame, seed: int = 7) -> DataFrame:
    """The order of training: a row for each use (doc_id, epoch, block_key, doc_key), of `mix`'s blocks and within them a permutation for each epoch."""
    each = mixed.where("uses > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("uses"))))
    return each.select("doc_id", "source", "epoch", _mark(seed, F.col("epoch"), F.col("block")).alias("block_key"), _mark(seed, F.col("epoch"), F.col("doc_id")).alias("doc_key"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, each as often as the mixture uses it."""
    uses = mix(docs, **options).where("uses > 0").select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "uses").dropDuplicates(["_id", "_tie"])
    # the row travels as one struct, so that no name of its columns can clash
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_key"), F.xxhash64("text").alias("_hash"))
    joined = keyed.join(uses, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_tie")))
    return joined.withColumn("_use", F.explode(F.sequence(F.lit(1), F.col("uses")))).select("_row.*")
