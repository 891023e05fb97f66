"""Retrieval-augmented generation as a dataflow. Model calls are a pluggable `Completer`.

One parameterised pipeline covers the grid of contexts (none, static, dynamic), keyword hints,
rechecks and prompt styles; the default completer is a deterministic stub, so the dataflow is testable.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmata.functions import text as X
from lemmata.operators import retrieval
from lemmata.session import cut


class Completer(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


@dataclass
class Stub:
    """Answers a prompt with a digest of it."""

    prefix: str = "stub:"

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self.prefix + hashlib.md5(p.encode()).hexdigest() for p in prompts]


@dataclass
class Retrying:
    """Retries a completer with doubling pauses; what still fails becomes null, never a lost row."""

    inner: Completer
    attempts: int = 3
    pause: float = 1.0

    def __call__(self, prompts: list[str]) -> list[str | None]:
        for k in range(self.attempts):
            try:
                return self.inner(prompts)
            except Exception:  # an answer that fails for good is a null, with the row kept
                if k + 1 < self.attempts:
                    time.sleep(self.pause * 2**k)
        return [None] * len(prompts)


def complete(rows: DataFrame, prompt: str, out: str, completer: Completer, batch: int = 64) -> DataFrame:
    """Each distinct prompt is completed once, in Arrow batches, and joined back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            done = [y for a in range(0, len(texts), batch) for y in completer(texts[a : a + batch])]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(done, pa.string())], ["_prompt", out])

    asked = rows.where(F.col(prompt).isNotNull()).select(F.col(prompt).alias("_prompt")).distinct()
    return rows.join(asked.mapInArrow(run, f"_prompt string, {out} string"), F.col(prompt) == F.col("_prompt"), "left").drop("_prompt")


def stuff(queries: DataFrame, hits: DataFrame, key: str, template: str, sep: str = "\n\n") -> DataFrame:
    """(key, prompt): the ranked contents of each query's hits put into a template's {context} and {query}."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), sep)
    context = hits.groupBy(F.col(key).alias("_k")).agg(joined.alias("_context"))
    filled = X.render(F.lit(template), context=F.coalesce(F.col("_context"), F.lit("")), query=F.col(key))
    return queries.join(context, F.col(key) == F.col("_k"), "left").select(key, filled.alias("prompt"))


def hybrid(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two ranked hit sets (key columns, rank, content) as one: all of the first, then the second."""
    tag = lambda df, k: df.withColumn("rank", F.format_string(f"{k}:%012d", F.col("rank").cast("long")))
    return tag(first, 0).unionByName(tag(second, 1))


def clauses(x: Column) -> Column:
    """Keyword split without a model: the clauses of a sentence."""
    parts = F.transform(F.split(x, r",|;|\bthen\b|\band\b"), lambda v: F.trim(v))
    return F.filter(parts, lambda v: v != "")


def grounded(generated: Column, source: Column) -> Column:
    """Identifiers of a generated assertion that its design does not have."""
    return F.array_except(X.signal_names(generated), X.signal_names(source))


def recheck(rows: DataFrame, column: str, step: Callable[[DataFrame, str, str], DataFrame], rounds: int = 3) -> DataFrame:
    """The correction loop, unrolled: step(rows, column, new column) replaces the column each round."""
    for k in range(rounds):
        rows = step(rows, column, f"_{column}{k}").drop(column).withColumnRenamed(f"_{column}{k}", column)
    return rows


def verified(rows: DataFrame, column: str, check: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass a check and those to be filled from the pool."""
    good = F.coalesce(check(F.col(column)), F.lit(False))
    return rows.where(good), rows.where(~good)


@dataclass
class Variant:
    """A point of the method grid."""

    context: str = "dynamic"  # none, static or dynamic
    keywords: bool = False
    recheck: int = 0
    style: str = "plain"  # plain, few_shot, steps or expand


TEMPLATES = {
    "plain": "{context}\nWrite one assertion for: {query}",
    "few_shot": "Examples:\n{context}\nWrite one assertion for: {query}",
    "steps": "{context}\nName the operations of: {query}\nThen write one assertion.",
    "expand": "{context}\nRestate with signal names and timing, then write one assertion: {query}",
}


def generate(queries: DataFrame, key: str, hits: DataFrame, keyword_hits: DataFrame, variant: Variant, completer: Completer) -> DataFrame:
    """(key, prompt, completion, answer) under a variant; hits: key, rank, content."""
    found = hits.limit(0) if variant.context == "none" else hits
    if variant.keywords:
        found = hybrid(keyword_hits, found)
    asked = stuff(queries, found, key, TEMPLATES[variant.style])
    done = complete(asked, "prompt", "completion", completer)

    def again(rows, column, new):
        return complete(rows.withColumn("_p", F.concat(F.lit("Correct: "), column)), "_p", new, completer).drop("_p")

    done = recheck(done, "completion", again, variant.recheck)
    return done.withColumn("answer", F.coalesce(X.final_answer("completion"), X.first_fence("completion"), F.col("completion")))


def stages(rows: DataFrame, steps: list[tuple[str, str]], completer: Completer) -> DataFrame:
    """Completions that build on each other: (column, template) in turn, a template's places named after columns."""
    for column, template in steps:
        filled = X.render(F.lit(template), **{c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns if "{" + c + "}" in template})
        rows = complete(rows.withColumn("_asked", filled), "_asked", column, completer).drop("_asked")
    return rows


def retrieve(queries: DataFrame, store: DataFrame, key: str, k: int = 3, dim: int = 16) -> DataFrame:
    """(key, rank, content): the k rows of a store (id, content) that are most like each query (key, text)."""
    asked = queries.select(F.col(key).alias("qid"), retrieval.embed(F.col("text"), dim).alias("qvec"))
    held = store.select("id", retrieval.embed(F.col("content"), dim).alias("vec"))
    found = retrieval.topk(asked, held, k).join(store, "id")
    return found.select(F.col("qid").alias(key), "rank", "content")


def routed(queries: DataFrame, stores: dict[str, DataFrame], key: str, k: int = 3) -> DataFrame:
    """(key, store, rank, content): each query (key, text, store) asks the store that it is routed to."""
    out = None
    for name, store in stores.items():
        found = retrieve(queries.where(F.col("store") == name), store, key, k).withColumn("store", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def expand_then_retrieve(queries: DataFrame, store: DataFrame, key: str, completer: Completer, k: int = 3, dim: int = 16, template: str = TEMPLATES["expand"]) -> DataFrame:
    """(key, expanded, rank, content): each query (key, text) is rewritten first, and the rewrite asks the store (id, content)."""
    asked = queries.select(key, X.render(F.lit(template), context=F.lit(""), query=F.coalesce("text", F.lit(""))).alias("_asked"))
    rewritten = cut(complete(asked, "_asked", "expanded", completer).drop("_asked"))
    return rewritten.join(retrieve(rewritten.select(key, F.col("expanded").alias("text")), store, key, k, dim), key)


def operations_then_operators(rows: DataFrame, key: str, text: str, operators: DataFrame, completer: Completer) -> DataFrame:
    """`rows` with the operations that a text asks for, the operators (op) that stand in them, and an answer made from the operations.

    The operators are matched and kept beside the answer; the answer is made from the operations.
    """
    asked = rows.withColumn("_p", F.concat(F.lit("Name the operations of: "), F.coalesce(text, F.lit(""))))
    named = cut(complete(asked, "_p", "operations", completer).drop("_p"))
    hits = retrieval.contains_join(named, "operations", operators, "op", keep=[key])
    matched = hits.groupBy(F.col(key).alias("_k")).agg(F.array_sort(F.collect_set("op")).alias("_ops"))
    held = named.join(matched, F.col(key).eqNullSafe(F.col("_k")), "left").withColumn("operators", F.coalesce("_ops", F.array().cast("array<string>"))).drop("_k", "_ops")
    return complete(held.withColumn("_p", F.concat(F.lit("Write one assertion with: "), F.coalesce("operations", F.lit("")))), "_p", "answer", completer).drop("_p")


def verify_loop(rows: DataFrame, column: str, check: Callable[[Column], Column], correct: Callable[[DataFrame, str], DataFrame], rounds: int = 2, feedback: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows with `ok` and `tries`: what fails the check is corrected (a new value of the column) and checked again, at most `rounds` times.

    feedback: what is told of a failed value; `correct` finds it in the column `feedback`. Each round is written before the
    next begins, so nothing is completed twice and the plan does not grow.
    """
    good = lambda: F.coalesce(check(F.col(column)), F.lit(False))
    rows = cut(rows.withColumn("ok", good()).withColumn("tries", F.lit(1)))
    names = rows.columns
    for _ in range(rounds):
        bad = rows.where("not ok")
        if bad.isEmpty():
            break
        told = bad if feedback is None else bad.withColumn("feedback", feedback(F.col(column)))
        again = correct(told, column).withColumn("ok", good()).withColumn("tries", F.col("tries") + 1)
        rows = cut(rows.where("ok").unionByName(again.select(names)))
    return rows


def walk_down(found: DataFrame, pieces: DataFrame, split: Callable[[Column, Column], Column]) -> DataFrame:
    """(key, node_id, piece): the root has its tree's piece (key, piece), a child what `split` makes of its parent's piece and its own code.

    Level by level down to the deepest, each level written before the next: a piece depends on all those above it. Nodes that
    no root leads to have no piece.
    """
    front = cut(found.where("parent_id is null").join(pieces, "key").select("key", "node_id", "piece"))
    inner = cut(found.where("parent_id is not null").select("key", "node_id", "parent_id", "code"))
    levels = [front]
    while True:
        up = front.select("key", F.col("node_id").alias("parent_id"), F.col("piece").alias("_piece"))
        front = cut(inner.join(up, ["key", "parent_id"]).select("key", "node_id", split(F.col("_piece"), F.col("code")).alias("piece")))
        if front.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        levels.append(front)


def fix_until_clean(source: DataFrame, report: Callable[[DataFrame], DataFrame], comment: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Lines that a report (file, line) names are commented out, until it names none.

    Each round is written before the next. A report that names the same lines twice in a row is an error: they are not in
    the source, or commenting them out does not help.
    """
    before = None
    while True:
        bad = cut(report(source).select("file", "line").distinct())
        n = bad.count()
        if not n:
            return source
        if before is not None and before.count() == n and bad.exceptAll(before).isEmpty():
            raise RuntimeError(f"a round changed nothing: {n} lines are still reported, {bad.first().asDict()} among them")
        source, before = cut(comment(source, bad)), bad


def assistant_turn(restated, decomposition, merge, sva) -> Column:
    """The assembled answer: restatement, the two trees, then the assertion in its fence."""
    parts = ["OL NL: ", restated, "\n\n# Decomposition\n", decomposition, "\n\n# Merge\n", merge, "\n\n```systemverilog\n", sva, "\n```"]
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
