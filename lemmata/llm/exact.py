"""Exact deduplication of texts behind a two-pass Bloom filter.

The first pass hashes every text and counts the slots of a blocked Bloom filter: each hash has two
slots in one bitmap, counted map-side first, and the slots that more than one row takes make the
filter of hashes that may be repeated. The second pass holds every row against that filter. A row
whose slots are not both taken again is alone and passes straight through; only the others shuffle
and are grouped by their whole SHA-256.

DataFrame functions only. A filter has `BITS` bits for each row. It is broadcast in parts of at most
`PART` bitmaps of 4 KB (64 MB), at most `PARTS` of them; beyond some two thousand million rows there
are fewer bits for each row, so more rows shuffle, and the result stays exact. Groups of any size are
counted map-side; a group with more than a fifty-thousandth of the rows is joined by broadcast.

Defined cases: null counts as the empty text, and empty texts are a group like any. A null doc_id is
below every other; of rows equal in doc_id and text one stays. Texts are hashed whole, however long;
further columns are ignored by `classes` and kept by `keep_last`. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmata.llm import _graph

#: bits of the filter for each row; slots of one bitmap; bitmaps broadcast at once and how often
BITS, SLOTS, PART, PARTS = 16, 1 << 15, 1 << 14, 64

Normalise = Callable[[Column], Column]


def _digest(text: Column, normalise: Normalise | None) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.unhex(F.sha2(normalise(text) if normalise else text, 256))


def _slots(sha: Column, bitmaps: int) -> list[Column]:
    """A hash's bitmap and its two slots in there."""
    h = F.xxhash64(F.lit(1), sha)
    return [F.pmod(F.xxhash64(sha), F.lit(bitmaps)).alias("bitmap"), F.pmod(h, F.lit(SLOTS)).alias("slot"), F.pmod(F.shiftright(h, 24), F.lit(SLOTS)).alias("other")]


def _bitmaps(rows: int, parts: int) -> int:
    return min(max(1, -(-rows * BITS // SLOTS)), PART * parts)


def _again(hashes: DataFrame) -> DataFrame:
    """The filter (key, again): of each bitmap the slots that more than one row takes."""
    taken = hashes.select("bitmap", F.explode(F.array_distinct(F.array("slot", "other"))).alias("slot"))
    counted = taken.groupBy("bitmap", "slot").agg(F.count(F.lit(1)).alias("n"))
    return counted.where("n > 1").groupBy(F.col("bitmap").alias("key")).agg(F.bitmap_construct_agg("slot").alias("again"))


def _bit(bitmap: Column, slot: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(slot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (slot % 8).cast("int")) == 1


def _tested(rows: DataFrame, again: DataFrame) -> DataFrame:
    """`rows` with maybe: whether both slots of the row are in the filter."""
    held = rows.join(F.broadcast(again), F.col("bitmap") == F.col("key"), "left")
    maybe = F.coalesce(_bit(F.col("again"), F.col("slot")) & _bit(F.col("again"), F.col("other")), F.lit(False))
    return held.withColumn("maybe", maybe).drop("key", "again")


def classes(docs: DataFrame, normalise: Normalise | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after `normalise` (default: no change); of equal texts the row
    with the largest doc_id stays.
    """
    spark = docs.sparkSession
    slim = _graph.cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(F.col(text_col), normalise).alias("sha")).withColumn("row", F.monotonically_increasing_id()))
    bitmaps = _bitmaps(slim.count(), PARTS)
    hashed = slim.select("*", *_slots(F.col("sha"), bitmaps)).withColumn("part", F.floor(F.col("bitmap") / PART))
    parts = -(-bitmaps // PART)
    folder = f"{_graph.shared_folder(spark)}/exact-{uuid4().hex}"
    if parts > 1:  # each part is then read on its own, once
        hashed.write.partitionBy("part").parquet(folder)
        hashed = spark.read.parquet(folder)
    again = _graph.cut(_again(hashed))
    tested = None
    for p in range(parts):
        of_part = _tested(hashed.where(F.col("part") == p), again.where(F.floor(F.col("key") / PART) == p))
        tested = of_part if tested is None else tested.unionByName(of_part)
    tested = tested.select("doc_id", "row", "sha", "maybe")

    maybe = _graph.cut(tested.where("maybe").drop("maybe"))
    groups = maybe.groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    repeated = _graph.hot_join(maybe, _graph.cut(groups), "sha", "group_size", maybe.count())
    alone = tested.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    rest = repeated.select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), "sha")
    return alone.unionByName(rest).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def keep_last(docs: DataFrame, normalise: Normalise | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, whole: of equal texts the one with the largest doc_id.

    Rows that the filter finds alone pass through without a shuffle; of the others each task hands
    on one row for each text. Rows equal in doc_id and text are told apart by their other columns.
    The filter is one part here, so that the texts are read twice and no more.
    """
    sha = _digest(F.col(text_col), normalise)
    hashes = docs.select(sha.alias("sha"))
    again = _graph.cut(_again(hashes.select(*_slots(F.col("sha"), _bitmaps(docs.count(), 1)))))
    # the row travels as one struct, so that no name of its columns can clash
    keyed = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"), sha.alias("sha"))
    tested = _tested(keyed.select("*", *_slots(F.col("sha"), _bitmaps(docs.count(), 1))), again)
    last = tested.where("maybe").groupBy("sha").agg(F.max_by("_row", F.struct("_id", F.to_json("_row"))).alias("_row"))
    return tested.where(~F.col("maybe")).select("_row.*").unionByName(last.select("_row.*"))
