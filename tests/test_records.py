import json

import pytest
from pyspark.sql import functions as F

from lemmata.functions import text as X
from lemmata.operators import curate
from lemmata.plans import generate
from lemmata.sources import records
from lemmata.streaming import resume


def test_array_and_lines_read_alike(spark, tmp_path):
    rows = [{"instruction": "a", "input": None, "output": "b\nc"}, {"instruction": "d", "input": "e", "output": "f"}]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, rows)))
    read = [sorted(map(tuple, records.read_records(spark, str(tmp_path / n), records.INSTRUCTION).collect()), key=str) for n in ("a.json", "b.jsonl")]
    assert read[0] == read[1] and len(read[0]) == 2


def test_indexed_lines_keep_physical_numbers(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"k": "a"}\n\nbroken\n{"k": "b"}\n{"k": "a"}\n')
    got = records.read_indexed(spark, str(tmp_path / "x.jsonl"), "k string").where("k is not null")
    assert [tuple(r) for r in got.orderBy("idx").collect()] == [(0, "a"), (3, "b"), (4, "a")]
    assert records.read_keyed(spark, str(tmp_path / "none"), "k string", "k").count() == 0


def test_statements_and_errors(spark):
    lines = spark.createDataFrame([(0, "# c"), (1, "run a"), (2, " b.v;"), (3, ""), (4, "go c.v ;")], "idx long, value string")
    assert sorted(r["words"] for r in records.statements(lines).collect()) == [["go", "c.v"], ["run", "a", "b.v"]]
    log = spark.createDataFrame([(0, "Error-[X] bad"), (1, '"f.sv", 3: near'), (2, "Error-[Y]"), (3, '"g.sv", 9')], "idx long, value string")
    assert [tuple(r)[2:] for r in records.errors(log).orderBy("idx").collect()] == [("f.sv", 3), ("g.sv", 9)]


def test_sinks(spark, tmp_path):
    texts = spark.createDataFrame([("module a; endmodule\nmodule b(x); y; endmodule",)], "t string")
    records.write_modules(texts, "t", str(tmp_path / "m"))
    assert sorted(p.name for p in (tmp_path / "m").glob("module=*")) == ["module=a", "module=b"]
    row = records.manifest(spark.createDataFrame([(2, "y"), (1, "x")], "index long, sva string"), "s", 0, 9).first()[0]
    assert json.loads(row) == {"source": "s", "seed": 0, "sample_size": 2, "eligible_pool_size": 9, "records": [{"index": 1, "sva": "x"}, {"index": 2, "sva": "y"}]}


def test_empty_rates_and_numbering(spark):
    none = spark.createDataFrame([], "ok boolean")
    assert tuple(curate.rates(none, ["ok"]).first()) == (0, 0, 0.0)
    got = curate.numbered(spark.createDataFrame([(5,), (250_000,), (7,)], "k long"), "k").orderBy("k")
    assert [tuple(r) for r in got.collect()] == [(5, 1), (7, 2), (250_000, 3)]


@pytest.mark.parametrize(("text", "want"), [("x</think>\n```sv\nassert property (a);\n```", "assert property (a);"), ("```sv\nassert property (a);\n```", None), ("a</think>\n```sv\nx\n```", None), (None, None)])
def test_final_answer(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.final_answer("t")).first()[0] == want


def test_failed_completions_are_null(spark):
    def fails(prompts):
        raise RuntimeError("down")

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id long, p string")
    got = generate.complete(rows, "p", "c", generate.Retrying(fails, 2, 0.0))
    assert got.count() == 3 and got.where("c is not null").count() == 0


def test_streams(spark, tmp_path):
    ticks = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, False)], "trace_id long, tick long, a boolean")
    ticks.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("trace_id long, tick long, a boolean").parquet(str(tmp_path / "in"))
    q = resume.edges(stream).writeStream.format("memory").queryName("edges").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("SELECT tick, rose, fell FROM edges ORDER BY tick").collect()] == [(0, False, False), (1, True, False), (2, False, True)]
    for _ in range(2):
        resume.append_new(stream, "tick", lambda d: d.withColumn("done", F.lit(True)), str(tmp_path / "out"), str(tmp_path / f"cp{_}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
