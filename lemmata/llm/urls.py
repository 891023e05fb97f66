"""URL filter by character language models.

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs, are counted over
all labelled URLs into one distributed table of grams, which grows with them: the key of a gram holds
its order and bytes, so the counts are exact. URLs are dealt into blocks, the table is joined to the
distinct grams of each block, and no task holds more of it than its block asks for. A URL scores the difference of its two
log-likelihoods per character; the threshold is calibrated on labelled URLs that were not counted.
Rules (block or allow a host and path prefix) label the URLs and always have the last word.

A character's probability backs off along its context: p_k = (n(context + char) + A p_(k-1)) /
(n(context) + A), from contexts of `ORDER` characters down to none, so contexts that were not seen
lend their weight to shorter ones.

Defined cases: a null URL, or one without `://`, has an empty host and path and fits no rule; null and
empty URLs score 0; without labelled URLs of both kinds every score and the threshold are 0; a score
at the threshold allows; repeated rows are judged each, all alike; very long URLs are scored whole; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmata.llm import _graph
from lemmata.llm._bytes import LOWER, text_bytes, words

ORDER, WEIGHT = 5, 2.0
#: bytes of URLs after which a new block begins
BLOCK = 1 << 18
#: one of so many labelled URLs is kept back for the threshold; scores are binned this finely for it
FOLDS, BIN = 8, 0.005
EVERY = np.ones(256, bool)
#: fixed values: (verdict, host, path) of the contract's rules
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def ruled(of_host: Column, of_path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((of_host == h) | F.endswith(of_host, F.lit("." + h))) & F.startswith(of_path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(w, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions with at least k characters before them in their URL; keys of context and of context with character.

    A key is exact: the gram's bytes (at most ORDER + 1 = 6) below its order and kind.
    """
    begin = np.repeat(w.doc_start[:-1], np.diff(w.doc_start))
    at = np.arange(len(w.data))
    at = at[at - begin >= k]
    context = np.zeros(len(at), np.int64)
    for j in range(k, 0, -1):
        context = context << 8 | w.data[at - j]
    wide = context << 8 | w.data[at]
    kind = 8 * (ORDER + 1)
    return at, context | (2 * k) << kind, wide | (2 * k + 1) << kind


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, rejected, accepted) of url and label; a gram comes once for each run of URLs."""
    for b in batches:
        label = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for w in words(b.column(0), EVERY, LOWER, BLOCK):
            kind = np.repeat(label[w.lo : w.hi], np.diff(w.doc_start))
            for k in range(ORDER + 1):
                at, *keys = grams(w, k)
                for key in keys:
                    gram, where = np.unique(key, return_inverse=True)
                    n = [np.bincount(where[kind[at] == c], minlength=len(gram)) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(gram), *map(pa.array, n)], ["gram", "rejected", "accepted"])


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the block of each; a block is a run of rows of one task."""
    block, size = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        _, offsets = text_bytes(b.column("url"))
        own = block + (size + offsets[:-1]) // BLOCK
        size += int(offsets[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int64())], [*b.schema.names, "block"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, gram) of block and url, distinct within each run of URLs of a block."""
    for b in batches:
        block = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            for w in words(b.column(1).slice(lo, hi - lo), EVERY, LOWER, BLOCK):
                for k in range(ORDER + 1):
                    for key in grams(w, k)[1:]:
                        gram = np.unique(key)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), block[lo])), pa.array(gram)], ["block", "gram"])


def likelihoods(w, gram: np.ndarray, counts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Per URL and class: log-likelihood per character. `gram` is sorted and distinct, `counts` follow it; others count 0."""
    n = np.diff(w.doc_start)
    out = np.zeros((2, len(n)))
    p = np.full((2, len(w.data)), 1 / 256)

    def place(key):
        i = np.minimum(np.searchsorted(gram, key), len(gram) - 1)
        return i, gram[i] == key

    for k in range(ORDER + 1):
        at, context, wide = grams(w, k)
        (i, known), (j, seen) = place(context), place(wide)
        for c in (0, 1):
            p[c, at] = (counts[c][j] * seen + WEIGHT * p[c, at]) / (counts[c][i] * known + WEIGHT)
    for c in (0, 1):
        total = np.concatenate([[0], np.cumsum(np.log(p[c]))])
        out[c] = (total[w.doc_start[1:]] - total[w.doc_start[:-1]]) / np.maximum(n, 1)
    return out


def _score(rows: pa.Table, looked: pa.Table) -> pa.Table:
    """The rows of one block with their scores, from the counts of its grams."""
    gram, first = np.unique(looked.column("gram").to_numpy(), return_index=True)
    counts = tuple(looked.column(c).to_numpy()[first] for c in ("rejected", "accepted"))
    parts = [np.zeros(0)]
    for w in words(rows.column("url"), EVERY, LOWER):
        if len(gram):
            reject, accept = likelihoods(w, gram, counts)
            parts.append(accept - reject)
        else:
            parts.append(np.zeros(w.hi - w.lo))
    return rows.drop_columns(["block"]).append_column("score", pa.array(np.concatenate(parts), pa.float64()))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of `pages`: page_id, host, path, rule, verdict and score (log-likelihood difference per character)."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}).withColumn("r", ruled(F.col("host"), F.col("path"), rules))
    labelled = rows.where("r is not null").select("url", (F.col("r.verdict") == "allow").cast("int").alias("label"))
    kept_back = F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0
    counts = _graph.cut(labelled.where(~kept_back).mapInArrow(_tally, "gram long, rejected long, accepted long").groupBy("gram").agg(F.sum("rejected").alias("rejected"), F.sum("accepted").alias("accepted")))
    least = counts.agg(F.max("rejected").alias("rejected"), F.max("accepted").alias("accepted")).first()
    fields = "page_id long, url string, host string, path string, rule string, verdict string"
    flat = rows.select("page_id", "url", "host", "path", "r.rule", "r.verdict")
    threshold = 0.0
    if least.rejected and least.accepted:
        dealt = _graph.cut(flat.mapInArrow(_dealt, f"{fields}, block long"))
        looked = dealt.select("block", "url").mapInArrow(_asked, "block long, gram long").join(counts, "gram")
        scored = _graph.cut(dealt.groupBy("block").cogroup(looked.groupBy("block")).applyInArrow(_score, f"{fields}, score double"))
        held = scored.where(F.col("verdict").isNotNull() & kept_back).withColumn("label", (F.col("verdict") == "allow").cast("int"))
        bins = held.groupBy(F.floor(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), "score")) / BIN).alias("bin"), "label").count().toPandas()  # at most 16,000 rows
        threshold = calibrate({(int(r.bin), int(r.label)): int(r["count"]) for _, r in bins.iterrows()})
    else:
        scored = flat.withColumn("score", F.lit(0.0))
    own = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score")


def calibrate(bins: dict[tuple[int, int], int]) -> float:
    """The bound between bins with the least balanced error; of equals the one nearest to 0."""
    total = [max(1, sum(n for (_, c), n in bins.items() if c == k)) for k in (0, 1)]
    wrong, best = sum(n for (_, c), n in bins.items() if c == 0) / total[0], (float("inf"), 0, 0)
    seen = sorted({b for b, _ in bins})
    for below, above in zip([-(10**6), *[b + 1 for b in seen]], [*seen, 10**6], strict=True):  # any bound between is as good
        t = min(max(0, below), above)
        best = min(best, (round(wrong, 12), abs(t), t))
        wrong += bins.get((above, 1), 0) / total[1] - bins.get((above, 0), 0) / total[0]
    return best[2] * BIN
