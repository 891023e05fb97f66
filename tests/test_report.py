"""The comparison report as it is written: in order, with what is missing said."""

from lemmata.plans import report

SCHEMA = "k long, name string, problem string, reference string, a string, a_completion string, a_exact boolean, b string, b_completion string, b_exact boolean"
MODELS = {"a": ("ours", "2048"), "b": ("base", "8192")}


def test_written_in_order(spark, tmp_path):
    rows = [(5, "second", "p\n  q ", "a |-> b", None, "x</think>", None, "s", "", True), (2, "first", None, "(a && !b) !== 1'b1", "a |=> disable iff (tb_reset)", None, True, "", None, False)]
    lines = report.comparison(spark.createDataFrame(rows, SCHEMA), "k", "Title", MODELS)
    report.write(lines, str(tmp_path / "r"))
    text = [line for f in sorted((tmp_path / "r").glob("part-*")) for line in f.read_text().splitlines()]
    assert text[:3] == ["=" * 100, "Title", "=" * 100] and text[-3:] == ["=" * 100, "END", "=" * 100]
    assert "produced a parseable assertion     1/2 (50.0%)            1/2 (50.0%)           " in text
    assert "negated-conjunction                1          0          0         " in text
    first, second = text.index("[1/2] first"), text.index("[2/2] second")
    assert first < second
    assert text[first + 2 : first + 4] == ["PROBLEM:", "    (none)"]
    assert text[second + 2 : second + 5] == ["PROBLEM:", "    p", "      q"]
    assert "    <NO ASSERTION - completed but emitted no ```systemverilog fence>" in text[second:]
    assert "    <NO ASSERTION - reasoning never terminated; hit the 8192-token cap>" in text[first:second]
    assert text[first:second].count("   [exact_match=True]") == 1


def test_no_records(spark):
    lines = report.comparison(spark.createDataFrame([], SCHEMA), "k", "Title", MODELS).collect()
    assert {r["part"] for r in lines} == {0, 2}
    assert any(r["value"].startswith("produced a parseable assertion     0/0 (0.0%)") for r in lines)
