"""Corpus curation and evaluation: eligibility, sampling, backfill, resume, censuses, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmata.session import cut


def seeded(seed: int, key) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample_n(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same for the same seed, in the order of the key (a top-n, no full sort)."""
    return rows.orderBy(seeded(seed, key), key).limit(n).orderBy(key)


def sample_exact(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """As `sample_n`, and an error where the pool has fewer than n rows."""
    held = rows.limit(n).count()
    if held < n:
        raise ValueError(f"the pool holds {held} rows, {n} are asked for")
    return sample_n(rows, n, key, seed)


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key).distinct(), key, "left_anti")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def backfill(failed: DataFrame, pool: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """The k-th failed slot gets the k-th unused record of the pool (slot, resolved), whatever order tasks end in.

    Ordinals come from per-bucket counts, so only a bucket's keys meet in a window.
    """
    left = numbered(failed.select(F.col(key).alias("slot")), "slot")
    right = numbered(pool.select(key).join(used.select(key).distinct(), key, "left_anti").select(F.col(key).alias("resolved")), "resolved")
    return left.join(right, "n", "left").select("slot", "resolved")


def numbered(rows: DataFrame, key: str, part: tuple[str, ...] = (), then: tuple[str, ...] = (), buckets: int = 64) -> DataFrame:
    """Row number `n` (from 1) in the order of a numeric key (and `then`), within `part` if given, nulls first.

    Rows are dealt into ranges of the key by its quantiles; a window covers one range, and ranges are
    put together by their counts, at most `buckets` for each part.
    """
    rows = cut(rows)  # read three times: quantiles, counts, numbers
    bounds = rows.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    marks = F.array(*[F.lit(b) for b in sorted(set(bounds))]) if bounds else F.array().cast("array<double>")
    dealt = rows.withColumn("_b", F.size(F.filter(marks, lambda b: b <= F.col(key))))
    dealt = dealt.withColumn("_b", F.when(F.col(key).isNull(), -1).otherwise(F.col("_b")))
    sizes = dealt.groupBy(*part, "_b").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    inside = dealt.withColumn("_i", F.row_number().over(Window.partitionBy(*part, "_b").orderBy(key, *then)))
    return inside.join(F.broadcast(before) if not part else before, [*part, "_b"]).withColumn("n", (F.col("_before") + F.col("_i")).cast("long")).drop("_b", "_i", "_before")


def rates(rows: DataFrame, flags: list[str], by: list[str] | None = None) -> DataFrame:
    """Count, sum and rate of each flag; no rows give a rate of 0."""
    n = F.count(F.lit(1))
    out = [n.alias("n")]
    for f in flags:
        total = F.coalesce(F.sum(F.col(f).cast("int")), F.lit(0))
        out += [total.cast("long").alias(f"n_{f}"), F.when(n > 0, total / n).otherwise(0.0).alias(f"rate_{f}")]
    return rows.groupBy(*(by or [])).agg(*out)


def histogram(rows: DataFrame, category: str, spine: DataFrame) -> DataFrame:
    """Count of every category of the spine, 0 where there is none."""
    counted = rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counted, category, "left").select(category, F.coalesce("n", F.lit(0)).alias("n"))


def taxonomy(rows: DataFrame, reason: str, top: int) -> DataFrame:
    return rows.groupBy(reason).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), reason).limit(top)


def examples(rows: DataFrame, reason: str, key: str, text: str, n: int) -> DataFrame:
    """Count of each reason and its first n examples."""
    w = Window.partitionBy(reason).orderBy(key, text)
    first = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).groupBy(reason).agg(F.transform(F.array_sort(F.collect_list(F.struct(key, text))), lambda x: x[text]).alias("examples"))
    return rows.groupBy(reason).agg(F.count(F.lit(1)).alias("n")).join(first, reason)


def census(found: DataFrame, op: str, doc: str, pos: str, example: str) -> DataFrame:
    """Occurrences of each operator, documents that hold it, and its shortest example (the earliest of equals).

    One row for each document and operator first, so documents are counted without a distinct over all occurrences.
    """
    best = F.min(F.struct(F.length(example).alias("len"), F.col(doc).alias("_doc"), F.col(pos).alias("_pos"), F.col(example).alias("_text"))).alias("_best")
    each = found.groupBy(op, doc).agg(F.count(F.lit(1)).alias("_n"), best)
    return each.groupBy(op).agg(F.sum("_n").alias("occurrences"), F.count(doc).alias("containing"), F.min("_best")["_text"].alias("example"))


def shares(rows: DataFrame, by: str, count: str) -> DataFrame:
    """(by, n, share): the sum of a count for each group, and its part of all."""
    n = rows.groupBy(by).agg(F.sum(count).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a group


def least(rows: DataFrame, by: str, value: str, k: int) -> DataFrame:
    """(by, least): the k least distinct values of each group, by k minima; nothing is gathered but these."""
    found, rest = None, rows.select(by, value).where(F.col(value).isNotNull())
    for _ in range(k):
        one = cut(rest.groupBy(by).agg(F.min(value).alias("_least")))
        found = one if found is None else found.unionByName(one)
        at = one.withColumnRenamed(by, "_by")
        rest = rest.join(F.broadcast(at), F.col(by).eqNullSafe(F.col("_by")) & (F.col(value) > F.col("_least"))).select(by, value)
    listed = found.groupBy(by).agg(F.array_sort(F.collect_list("_least")).alias("least"))
    return rows.select(by).distinct().join(listed.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")), "left").select(by, F.coalesce("least", F.array().cast(rows.select(F.array(value)).schema[0].dataType)).alias("least"))


def golden_counts(dictionary, prefix: str = "Assertion ") -> Column:
    """How many entries of a JSON dictionary are assertions, by their names; other keys, however many, don't count."""
    return F.coalesce(F.size(F.filter(F.json_object_keys(dictionary), lambda k: F.startswith(k, F.lit(prefix)))), F.lit(0))


def design_scores(report: DataFrame, golden: DataFrame, part: str, order: str, then: tuple[str, ...] = ()) -> DataFrame:
    """(part, golden, sc, fc, fm): after a design's golden rows, every two rows are a candidate and its mirror.

    sc: candidates; fc, fm: proven candidates and mirrors. golden: (part, golden), 0 for a design without one.
    """
    at = numbered(report, order, (part,), then).join(F.broadcast(golden), part, "left").withColumn("golden", F.coalesce("golden", F.lit(0)))
    after = F.col("n") - 1 - F.col("golden")
    good = (after >= 0) & (F.col("result") == "proven")
    return at.groupBy(part, "golden").agg(F.floor((F.count(F.lit(1)) - F.first("golden")) / 2).alias("sc"), F.count_if(good & (after % 2 == 0)).alias("fc"), F.count_if(good & (after % 2 == 1)).alias("fm"))


def arity(rows: DataFrame, column: str) -> DataFrame:
    """Histogram of an array column's sizes with every count from 0 to the largest, with their mean."""
    counted = rows.groupBy(F.size(column).alias("arity")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.max("arity").alias("most"), (F.sum(F.col("arity") * F.col("n")) / F.sum("n")).alias("mean"))
    spine = total.select(F.explode(F.sequence(F.lit(0), "most")).alias("arity"), "mean")
    return spine.join(counted, "arity", "left").select(F.col("arity").cast("long").alias("arity"), F.coalesce("n", F.lit(0)).alias("n"), "mean")


def throughput(rows: DataFrame, tokens: str, seconds: str) -> DataFrame:
    """Records, tokens, seconds a record and tokens a second; null where nothing was timed."""
    n, t, s = F.count(F.lit(1)), F.sum(tokens), F.sum(seconds)
    return rows.agg(n.alias("records"), t.alias("tokens"), (s / F.nullif(n, F.lit(0))).alias("seconds_a_record"), (t / F.nullif(s, F.lit(0))).alias("tokens_a_second"))


def upsert(registry: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """A registry with the entries of `more`, which replace those of the same key."""
    return registry.join(more.select(key).distinct(), key, "left_anti").unionByName(more)


def added_lines(longer, shorter) -> Column:
    """Lines of a module beyond as many as the shorter version has, without the closing one."""
    a, b = F.split(longer, "\n"), F.split(shorter, "\n")
    return F.array_join(F.slice(a, F.size(b) + 1, F.greatest(F.lit(0), F.size(a) - F.size(b) - 1)), "\n")


def section(rows: DataFrame, part: str, order: str, line: Column, head: Column) -> DataFrame:
    """Text of a report's sections: the head, then a line for each row in order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("_line")))), lambda x: x["_line"]), "\n")
    return rows.groupBy(part).agg(F.concat(head, F.lit("\n"), body).alias("text"))
