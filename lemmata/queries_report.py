"""Registered query: the comparison report of two models, line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lemmata.plans import report
from lemmata.queries import query
from lemmata.session import table

_R = "CASE c_custkey % 3 WHEN 0 THEN '(a && !b) !== 1''b1' WHEN 1 THEN 'a |-> b' ELSE '' END"
_A = "CASE c_custkey % 4 WHEN 0 THEN 'disable iff (tb_reset) a |=> ' || c_name WHEN 1 THEN 'a' WHEN 2 THEN '' END"
_B = "CASE WHEN c_custkey % 5 < 2 THEN 'x != 1''b1' END"
_DONE = "CASE WHEN c_custkey % 2 = 0 THEN 'thought</think>' END"
_MADE = f"c_custkey AS k, c_name AS name, c_mktsegment || chr(10) || c_name AS problem, {_R} AS reference, {_A} AS a, {_DONE} AS a_completion, c_custkey % 7 = 0 AS a_exact, {_B} AS b, {_DONE} AS b_completion, CASE WHEN c_custkey % 8 <> 0 THEN c_custkey % 9 = 0 END AS b_exact"
_CELL = "CASE WHEN coalesce({x}, '') = '' THEN '    (none)' ELSE '    ' || replace({x}, chr(10), chr(10) || '    ') END"
_SAID = "CASE WHEN coalesce({m}, '') <> '' THEN {m} WHEN contains(coalesce({m}_completion, ''), '</think>') THEN '<NO ASSERTION - completed but emitted no ```systemverilog fence>' ELSE '<NO ASSERTION - reasoning never terminated; hit the {cap}-token cap>' END"
_KIND = "CASE WHEN contains(coalesce({x}, ''), '!== 1''b1') OR contains(coalesce({x}, ''), '!= 1''b1') THEN 0 WHEN contains(coalesce({x}, ''), '|->') OR contains(coalesce({x}, ''), '|=>') THEN 1 ELSE 2 END"


def _sql() -> str:
    nl, bar, rule = "|| chr(10) ||", f"'{report.BAR}'", f"'{report.RULE}'"
    got = lambda m: f"count(*) FILTER (coalesce({m}, '') <> '')"
    share = lambda m: f"printf('%d/%d (%.1f%%)', {got(m)}, count(*), {got(m)} * 100.0 / count(*))"
    wide = lambda x, a, b: f"printf('%-34s %-22s %-22s', '{x}', {a}, {b})"
    same = lambda m: f"'' || count(*) FILTER ({m}_exact)"
    reset = lambda m: f"'' || count(*) FILTER (contains({m}, 'disable iff (tb_reset)'))"
    kind = lambda x, k, held: f"'' || count(*) FILTER ({_KIND.format(x=x)} = {k}{held})"
    held = lambda m: f" AND coalesce({m}, '') <> ''"
    idioms = [f"printf('%-34s %-10s %-10s %-10s', '{name}', {kind('reference', k, '')}, {kind('a', k, held('a'))}, {kind('b', k, held('b'))})" for k, name in enumerate(report.IDIOMS)]
    head = [rule, "'Results'", rule, "''", "printf('records   : %d', count(*))", "'model A   : ours   [max_new_tokens=2048]'", "'model B   : base   [max_new_tokens=8192]'", "''", bar, "'SUMMARY'", bar, wide("", "'A (ours)'", "'B (baseline)'"),
            wide("produced a parseable assertion", share("a"), share("b")), wide("exact string match vs reference", same("a"), same("b")), wide("used disable iff (tb_reset)", reset("a"), reset("b")), "''", "'idiom distribution'",
            "printf('%-34s %-10s %-10s %-10s', '', 'reference', 'A', 'B')", *idioms, "''", rule, "'PER-RECORD RESULTS'", rule]
    flag = lambda m: f"'   [exact_match=' || CASE WHEN coalesce({m}_exact, FALSE) THEN 'True' ELSE 'False' END || ']'"
    body = ["''", bar, "printf('[%d/%d] %s', idx, total, name)", bar, "'PROBLEM:'", _CELL.format(x="problem"), "''", "'REFERENCE:'", _CELL.format(x="reference"), "''", "'A  ours:'", _CELL.format(x=f"({_SAID.format(m='a', cap=2048)})"), flag("a"), "''", "'B  base:'", _CELL.format(x=f"({_SAID.format(m='b', cap=8192)})"), flag("b")]
    text = f"SELECT 0 AS part, 0::BIGINT AS idx, {nl.join(f'({x})' for x in head)} AS t FROM c UNION ALL SELECT 1, idx, {nl.join(f'({x})' for x in body)} FROM c UNION ALL SELECT 2, 0::BIGINT, '' {nl} {rule} {nl} 'END' {nl} {rule}"
    return f"WITH c AS (SELECT {_MADE}, row_number() OVER (ORDER BY c_custkey) AS idx, count(*) OVER () AS total FROM customer), l AS ({text}) SELECT part, idx, CAST(unnest(range(0, len(string_split(t, chr(10))))) AS INTEGER) AS line, unnest(string_split(t, chr(10))) AS value FROM l"


@query(_sql())
def comparison_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").selectExpr(*_split(_MADE))
    return report.comparison(rows, "k", "Results", {"a": ("ours", "2048"), "b": ("base", "8192")})


def _split(columns: str) -> list[str]:
    """The columns of a select list: cut after each name."""
    out, at = [], 0
    for name in ("k", "name", "problem", "reference", "a", "a_completion", "a_exact", "b", "b_completion", "b_exact"):
        end = columns.index(f" AS {name}", at) + len(f" AS {name}")
        out.append(columns[at:end].lstrip(", "))
        at = end
    return out
