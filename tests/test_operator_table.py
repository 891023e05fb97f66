"""The operator table from a file, lookups with numbers, and explanations from templates."""

import json

import pytest

from lemmata.plans import operators as O

TABLE = {
    "|->": {"type": "implication", "template_binary": "whenever {a}, {b}"},
    "##N": {"template_unary": "{n} cycles later {a}", "template_binary": "{a}, then {n} cycles later {b}"},
    "##[M:N]": {"template_binary": "{a}, then {m} to {n} cycles later {b}"},
    "[*N]": {"template_unary": "{a} {n} times"},
    "[*M:N]": {"template_unary": "{a} {m} to {n} times"},
    "[->M:N]": {"template_unary": "{a} as hit {m} to {n}"},
    "always[M:N]": {"template_unary": "{a} from {m} to {n}"},
    "nexttime[N]": {"template_unary": "{a} after {n}"},
    "$rose": {"template_unary": "{a} rises"},
    "NOT": {"template_unary": "not {a}"},
}


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("ops") / "operators.json"
    path.write_text(json.dumps(TABLE, indent=1))
    return O.load(spark, str(path))


def test_table_is_loaded_in_order(table):
    rows = table.orderBy("rank").collect()
    assert [r["op"] for r in rows] == list(TABLE)
    assert [(r["type"], r["template_unary"], r["template_binary"]) for r in rows] == [(v.get("type"), v.get("template_unary"), v.get("template_binary")) for v in TABLE.values()]


@pytest.mark.parametrize(
    ("label", "want"),
    [
        ("|->", ("|->", None, None)), ("##2", ("##N", None, "2")), ("##[4:9]", ("##[M:N]", "4", "9")), ("##[1:$]", ("##[M:N]", "1", "$")), ("[*3]", ("[*N]", None, "3")), ("[*2:3]", ("[*M:N]", "2", "3")), ("[->1:2]", ("[->M:N]", "1", "2")),
        ("always[3:7]", ("always[M:N]", "3", "7")), ("s_always[3:7]", None), ("nexttime[5]", ("nexttime[N]", None, "5")), ("$rose", ("$rose", None, None)), ("##N", ("##N", None, None)), ("##x", None), ("NOT", ("NOT", None, None)), ("3OT", None), (None, None),
    ],
)
def test_lookup(spark, table, label, want):
    got = O.lookup(spark.createDataFrame([(label,), (label,)], "label string"), "label", table).collect()
    assert [(r["op"], r["m"], r["n"]) for r in got] == ([want] if want else [])


def test_least_rank_wins(spark):
    table = spark.createDataFrame([("a[N]", 2, "second"), ("a[M:N]", 1, "other")], "op string, rank int, template_unary string")
    both = table.unionByName(spark.createDataFrame([("a[*N]", 0, "x")], table.schema))
    assert [r["op"] for r in O.lookup(spark.createDataFrame([("a[7]",)], "l string"), "l", both).collect()] == ["a[N]"]


def test_explanations(spark, table):
    nodes = [
        (1, 5, None, 0, "operator", "|->"), (1, 2, 5, 0, "operator", "$rose"), (1, 1, 2, 0, "signal", "a"), (1, 4, 5, 1, "operator", "##2"), (1, 3, 4, 0, "signal", "b {x}"),
        (2, 1, None, 0, "signal", "c"), (3, 3, None, 0, "operator", "odd"), (3, 1, 3, 0, "signal", "p"), (3, 2, 3, 1, "signal", "q"), (4, 1, None, 0, "operator", "none"),
    ]
    df = spark.createDataFrame(nodes, "key int, node_id int, parent_id int, child_pos int, type string, label string")
    got = {(r["key"], r["node_id"]): r["piece"] for r in O.explanations(df, table).collect()}
    assert got[1, 5] == "whenever a rises, 2 cycles later b {x}" and got[1, 4] == "2 cycles later b {x}"
    assert got[2, 1] == "c" and got[3, 3] == "odd of p, q" and got[4, 1] == "none of " and len(got) == len(nodes)
