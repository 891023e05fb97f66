"""Carried values and counts, physical lines and random access, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lemmata.operators import carry
from lemmata.sources import records


@pytest.mark.parametrize("block", [3, 8192])
@pytest.mark.parametrize("part", [(), ("f",), ("f", "g")])
def test_against_loops(spark, monkeypatch, block, part):
    monkeypatch.setattr(carry, "BLOCK", block)
    r = random.Random(8)
    rows = []
    for f, g in (("x", 1), ("x", None), (None, 1), ("y", 2)):
        rows += [(f, g, i, r.choice([None, None, "a", "b", "c"])) for i in r.sample(range(60), 25)]
    if part != ("f", "g"):
        rows = [(f, g, i + 100 * n, v) for n, (f, g, i, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "f string, g int, idx long, v string").repartition(5)
    key = lambda x: tuple(x[("f", "g").index(p)] for p in part)
    got = carry.count_before(carry.last_value(carry.next_value(df, part, "idx", F.col("v"), "n"), part, "idx", F.col("v"), "l"), part, "idx", F.col("v") == "a", "c")
    assert got.columns == ["f", "g", "idx", "v", "n", "l", "c"]
    for x in got.collect():
        own = sorted((y for y in rows if key(y) == key((x["f"], x["g"]))), key=lambda y: y[2])
        assert x["n"] == next((y[3] for y in own if y[2] >= x["idx"] and y[3]), None)
        assert x["l"] == next((y[3] for y in reversed(own) if y[2] <= x["idx"] and y[3]), None)
        assert x["c"] == sum(y[3] == "a" for y in own if y[2] < x["idx"])


def test_statements_and_errors_of_many_files(spark, monkeypatch):
    monkeypatch.setattr(carry, "BLOCK", 2)
    rows = [("a", 0, "# c"), ("a", 1, "run a"), ("a", 2, " b.v;"), ("a", 3, ""), ("a", 4, "go c.v ;"), ("b", 0, "run"), ("b", 1, "x;"), ("b", 2, "open")]
    lines = spark.createDataFrame(rows, "name string, idx long, value string")
    got = {(r["name"], tuple(r["words"])) for r in records.statements(lines, ("name",)).collect()}
    assert got == {("a", ("run", "a", "b.v")), ("a", ("go", "c.v")), ("b", ("run", "x")), ("b", ("open",))}
    log = [("a", 0, "Error-[X] bad"), ("a", 1, "text"), ("a", 2, "text"), ("a", 3, '"f.sv", 3: near'), ("a", 4, "Error-[Z] at the end"), ("b", 0, "Error-[Y]"), ("b", 1, '"g.sv", 9')]
    found = records.errors(spark.createDataFrame(log, "name string, idx long, value string"), ("name",)).collect()
    assert sorted(map(tuple, found), key=lambda x: x[:2]) == [("a", 0, "Error-[X] bad", "f.sv", 3), ("a", 4, "Error-[Z] at the end", None, None), ("b", 0, "Error-[Y]", "g.sv", 9)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    r = random.Random(2)
    d = tmp_path_factory.mktemp("some lines")
    texts = {}
    for name, end in (("b.txt", "\n"), ("a.txt", ""), ("c.txt", "\n")):
        texts[name] = ["é😀 " * r.choice([0, 1, 30]) + f"{name} {i}" * r.choice([0, 1, 1]) for i in range(r.choice([1, 400]))] + ["last"]
        (d / name).write_bytes(("\r\n" if name == "c.txt" else "\n").join(texts[name]).encode() + end.encode() * (2 if name == "c.txt" else 1))
    texts["c.txt"].append("")
    return d, texts


def test_physical_lines_over_splits(spark, folder):
    d, texts = folder
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = records.read_lines(spark, str(d)).collect()
        index = records.line_index(spark, str(d))
        records.write_index(index, str(d.parent / "index"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    want = [(n, i, v) for n in sorted(texts) for i, v in enumerate(texts[n])]
    got = sorted((r["idx"], r["file"].rsplit("/", 1)[1], r["line"], r["value"]) for r in lines)
    assert [g[1:] for g in got] == want and [g[0] for g in got] == list(range(len(want)))
    stored = spark.read.parquet(str(d.parent / "index"))
    for idx in (0, 1, len(want) // 2, len(want) - 2, len(want) - 1):
        assert records.read_record(spark, stored, idx) == want[idx][2]
    with pytest.raises(KeyError):
        records.read_record(spark, stored, len(want))


def test_slices(spark):
    rows = spark.range(10).withColumnRenamed("id", "idx")
    take = lambda *a: sorted(r["idx"] for r in records.slice_rows(rows, *a).collect())
    assert take(7, 9) == [7, 8, 9] and take(2, 3) == [2, 3, 4] and take(8) == [8, 9] and take(0, 0) == []
