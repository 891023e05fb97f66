import pytest

from lemmata.plans import sva

GOOD = [
    "a ##1 b", "a[*2] ##1 b", "a[*1:3]", "a[*]", "a[+]", "b[->1:2]", "b[=2]", "$sampled(e)", "$rose(e)", "$fell(e)", "$stable(e)", "$changed(e)", "$past(e, 2, gate)", "s1 intersect s2",
    "first_match(a ##[1:3] b)", "e throughout s", "s1 within s2", "strong(s)", "weak(s)", "s |-> p", "s |=> p", "p implies q", "p iff q", "s #-# p", "s #=# p", "nexttime p", "nexttime[2] p",
    "s_nexttime p", "s_nexttime[3] p", "always p", "always[1:2] p", "s_always[1:2] p", "p until q", "p s_until q", "p until_with q", "p s_until_with q", "s_eventually p", "eventually[1:2] p",
    "s_eventually[1:2] p", "##[*] a", "##[+] a", "a ? b : c", "{a, b} == 2'b01", "bus[3:0] != 4'hF", "if (a) b else c", "not (a and b) or c",
]


@pytest.mark.parametrize("text", GOOD)
def test_code_reparses_to_the_same_tree(text):
    root = sva.parse(text)
    again = sva.parse(sva.code(root))
    assert [(n.kind, n.label, n.id) for n, _, _ in sva.walk(root)] == [(n.kind, n.label, n.id) for n, _, _ in sva.walk(again)]
    assert sva.explain(root)


@pytest.mark.parametrize("text", ["", "a ||", "(a", "a b", "a ##", "|-> b"])
def test_errors(text):
    with pytest.raises(sva.ParseError):
        sva.parse(text)


def test_delays_fold_to_the_left_and_ids_are_post_order():
    root = sva.parse("A ##2 B ##1 C")
    assert sva.code(root) == "(A ##2 B) ##1 C"
    assert [(n.label, n.id) for n, _, _ in sva.walk(root)] == [("##1", 5), ("##2", 3), ("A", 1), ("B", 2), ("C", 4)]
    assert sva.merge_steps(root) == [("T1", "C"), ("T2", "B"), ("T3", "A"), ("T4", "T3 ##2 T2"), ("T5", "T4 ##1 T1")]


def test_assertion_parts():
    assert sva.split_assertion("x: assert property (@(posedge clk) disable iff (!(rst)) a |-> b);") == ("posedge clk", "!(rst)", "a |-> b")


def test_parameters():
    assert sva.operator_key("##[4:9]") == ("##[m:n]", "4", "9")
    assert sva.operator_key("[*2:3]") == ("[*m:n]", "2", "3")
    assert sva.operator_key("always[1:2]") == ("always[m:n]", "1", "2")
