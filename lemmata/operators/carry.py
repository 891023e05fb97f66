"""Values and counts carried along an order, over any number of rows of one part.

Rows are dealt into blocks of `BLOCK` consecutive numbers; a window covers one block, each block is summed up in
one row, and what comes from other blocks is carried over those rows. So one file, log or trace may
hold any share of all rows. The order is a whole number, unique in its part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: consecutive numbers of a block
BLOCK = 8192


def _blocked(rows: DataFrame, order: str, made: Column) -> DataFrame:
    return rows.withColumn("_block", F.floor(F.col(order) / BLOCK)).withColumn("_made", made)


def _told(rows: DataFrame, blocks: DataFrame, part: tuple[str, ...]) -> DataFrame:
    same = F.col("_block") == F.col("_of")
    for i, p in enumerate(part):
        same = same & F.col(p).eqNullSafe(F.col(f"_p{i}"))
    return rows.join(blocks, same).drop("_of", "_block", "_made", *[f"_p{i}" for i in range(len(part))])


def _names(part: tuple[str, ...]) -> list[Column]:
    return [F.col(p).alias(f"_p{i}") for i, p in enumerate(part)] + [F.col("_block").alias("_of")]


def count_before(rows: DataFrame, part: tuple[str, ...], order: str, flag: Column, name: str) -> DataFrame:
    """`rows` with how many earlier rows of their part have the flag."""
    made = _blocked(rows, order, F.coalesce(flag, F.lit(False)).cast("long"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    total = made.groupBy(*part, "_block").agg(F.sum("_made").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(earlier(Window.partitionBy(*part).orderBy("_block"))), F.lit(0))
    blocks = total.select(*_names(part), before.alias("_before"))
    inside = F.coalesce(F.sum("_made").over(earlier(Window.partitionBy(*part, "_block").orderBy(order))), F.lit(0))
    return _told(made.withColumn("_inside", inside), blocks, part).withColumn(name, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def next_value(rows: DataFrame, part: tuple[str, ...], order: str, value: Column, name: str) -> DataFrame:
    """`rows` with the first value that is not null at or after them in their part."""
    return _carried(rows, part, order, value, name, True)


def last_value(rows: DataFrame, part: tuple[str, ...], order: str, value: Column, name: str) -> DataFrame:
    """`rows` with the last value that is not null at or before them in their part."""
    return _carried(rows, part, order, value, name, False)


def _carried(rows: DataFrame, part: tuple[str, ...], order: str, value: Column, name: str, ahead: bool) -> DataFrame:
    made = _blocked(rows, order, value)
    # frames grow row by row towards the asked side; one up to the other end would be read anew for every row
    turn = F.desc if ahead else F.asc
    pick = F.min_by if ahead else F.max_by
    total = made.groupBy(*part, "_block").agg(pick("_made", F.when(F.col("_made").isNotNull(), F.col(order))).alias("_one"))
    over = Window.partitionBy(*part).orderBy(turn("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = total.select(*_names(part), F.last("_one", ignorenulls=True).over(over).alias("_beyond"))
    here = Window.partitionBy(*part, "_block").orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, 0)
    inside = made.withColumn("_inside", F.last("_made", ignorenulls=True).over(here))
    return _told(inside, blocks, part).withColumn(name, F.coalesce("_inside", "_beyond")).drop("_inside", "_beyond")
