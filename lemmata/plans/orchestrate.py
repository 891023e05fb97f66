"""Datasets built slot by slot with verification, backfill and resume.

Every target record is a slot. A round takes each open slot's candidate (the record itself, then the next record of
the pool that nobody has tried, in order), does the work for all of them at once, and is committed by one
write: `round=<n>` in the run's folder, with what was tried and what came of it. A run that was stopped goes on after
its last committed round, so no record is tried twice and none is lost. It ends when all slots are filled or
the pool is used up; slots that stay open then are in the result without content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.operators import curate
from lemmata.plans import generate
from lemmata.session import cut

#: candidates (slot, idx, and the record's columns) -> (slot, idx, content); a null content is a failure
Work = Callable[[DataFrame], DataFrame]
_TRIED = "slot long, idx long, content string"


def committed(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """What the committed rounds have tried (slot, idx, content, round), and how many rounds there are."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    n = 0
    while fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/round={n}/_SUCCESS")):
        n += 1
    if not n:
        return spark.createDataFrame([], f"{_TRIED}, round int"), 0
    rounds = [spark.read.schema(_TRIED).parquet(f"{folder}/round={k}").withColumn("round", F.lit(k)) for k in range(n)]
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out, n


def fill_slots(pool: DataFrame, targets: DataFrame, work: Work, folder: str, most: int | None = None) -> DataFrame:
    """(slot, resolved, content, tries) of the targets (idx), filled from records of the pool (idx, ...), with the state in `folder`.

    most: rounds of this call (default: until nothing is open or the pool is used up); a later call goes on.
    """
    spark = pool.sparkSession
    slots = targets.select(F.col("idx").cast("long").alias("slot")).distinct()
    while True:
        tried, n = committed(spark, folder)
        filled = tried.where("content is not null").select("slot").distinct()
        left = cut(slots.join(filled, "slot", "left_anti"))
        used = tried.select("idx").unionByName(slots.select(F.col("slot").alias("idx"))).distinct()
        if n == 0:
            asked = left.select("slot", F.col("slot").alias("idx"))
        else:
            free = cut(pool.select(F.col("idx").cast("long").alias("idx")).join(used, "idx", "left_anti"))
            dealt = curate.backfill(left.select(F.col("slot").alias("idx")), free, free.limit(0), "idx")
            asked = dealt.where("resolved is not null").select("slot", F.col("resolved").alias("idx"))
        if most is not None and most <= 0:
            return _result(slots, tried)
        asked = cut(asked)
        if asked.isEmpty():
            return _result(slots, tried)
        records = pool.withColumn("idx", F.col("idx").cast("long"))
        work(asked.join(records, "idx")).select("slot", "idx", F.col("content").cast("string").alias("content")).write.mode("overwrite").parquet(f"{folder}/round={n}")
        most = None if most is None else most - 1


def _result(slots: DataFrame, tried: DataFrame) -> DataFrame:
    tries = tried.groupBy("slot").agg(F.count(F.lit(1)).alias("tries"))
    done = tried.where("content is not null").select("slot", F.col("idx").alias("resolved"), "content")
    return slots.join(done, "slot", "left").join(tries, "slot", "left").select("slot", "resolved", "content", F.coalesce("tries", F.lit(0)).alias("tries"))


def restated_turns(text: str, completer: generate.Completer, check, explain=None, rounds: int = 2, decomposition=None, merge=None) -> Work:
    """Work that restates a record's text until the check holds (the correction is told why it failed) and assembles the turn.

    check, explain: of a restatement's column; decomposition, merge: columns of the record for the turn's sections.
    """

    def work(rows: DataFrame) -> DataFrame:
        asked = rows.withColumn("_p", F.concat(F.lit("Restate: "), F.coalesce(text, F.lit(""))))
        said = generate.complete(asked, "_p", "_said", completer).drop("_p")

        def correct(bad: DataFrame, column: str) -> DataFrame:
            why = F.concat(F.lit(" ("), F.col("feedback"), F.lit(")")) if explain else F.lit("")
            again = bad.withColumn("_p", F.concat(F.lit("Correct: "), F.coalesce(column, F.lit("")), why)).drop(column, "feedback")
            return generate.complete(again, "_p", column, completer).drop("_p")

        held = generate.verify_loop(said, "_said", check, correct, rounds, explain)
        turn = generate.assistant_turn(F.col("_said"), decomposition if decomposition is not None else F.lit(""), merge if merge is not None else F.lit(""), F.coalesce(text, F.lit("")))
        return held.select("slot", "idx", F.when(F.col("ok"), turn).alias("content"))

    return work
