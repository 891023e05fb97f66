"""A comparison of two models' results as a plain-text report, line by line.

Lines are rows (part, idx, line, value): the head with its summary, a section for each record, the end. Sorted by the first three
they are the report; `write` does so by range, so no task holds all of it. The wording and layout of its lines, here and below, are
fixed values: a report is compared with others by its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmata.functions import text as X
from lemmata.operators import curate
from lemmata.session import cut

#: fixed values: the report's width, its kinds of assertions, and how counts are set
WIDTH = 100
IDIOMS = ("negated-conjunction", "implication", "other")
WIDE, NARROW = "%-34s %-22s %-22s", "%-34s %-10s %-10s %-10s"
RULE, BAR = "=" * WIDTH, "-" * WIDTH


def idiom(assertion) -> Column:
    """Kind of an assertion; null and empty ones are `other`."""
    x = F.coalesce(F.col(assertion), F.lit(""))
    negated = F.contains(x, F.lit("!== 1'b1")) | F.contains(x, F.lit("!= 1'b1"))
    return F.when(negated, IDIOMS[0]).when(F.contains(x, F.lit("|->")) | F.contains(x, F.lit("|=>")), IDIOMS[1]).otherwise(IDIOMS[2])


def indented(value: Column) -> Column:
    """Lines moved in by four blanks; `(none)` for nothing."""
    return F.when(F.coalesce(value, F.lit("")) == "", F.array(F.lit("    (none)"))).otherwise(F.transform(F.split(X.strip(value), "\r?\n"), lambda v: F.concat(F.lit("    "), v)))


def failure(completion: str, cap: str) -> Column:
    """What stands for an assertion that is not there."""
    never = F.lit(f"<NO ASSERTION - reasoning never terminated; hit the {cap}-token cap>")
    return F.when(F.contains(F.coalesce(F.col(completion), F.lit("")), F.lit("</think>")), F.lit("<NO ASSERTION - completed but emitted no ```systemverilog fence>")).otherwise(never)


def _held(x: str) -> Column:
    return F.coalesce(F.col(x), F.lit("")) != ""


def _head(rows: DataFrame, title: str, models: dict[str, tuple[str, str]]) -> DataFrame:
    n = F.count(F.lit(1))
    totals = [n.alias("n")]
    for m in models:
        totals += [F.count_if(_held(m)).alias(f"{m}_got"), F.count_if(F.coalesce(F.col(f"{m}_exact"), F.lit(False))).alias(f"{m}_same"), F.count_if(F.contains(F.coalesce(m, F.lit("")), F.lit("disable iff (tb_reset)"))).alias(f"{m}_reset")]
    for k, kind in enumerate(IDIOMS):
        totals.append(F.count_if(idiom("reference") == kind).alias(f"r{k}"))
        totals += [F.count_if(_held(m) & (idiom(m) == kind)).alias(f"{m}{k}") for m in models]
    one = rows.agg(*totals)
    a, b = models
    share = lambda m: F.format_string("%d/%d (%.1f%%)", F.col(f"{m}_got"), F.col("n"), F.coalesce(F.col(f"{m}_got") * 100.0 / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)))
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    wide = lambda *x: F.format_string(WIDE, *map(text, x))
    count = lambda c: F.col(c).cast("string")
    lines = [RULE, title, RULE, "", F.format_string("records   : %d", F.col("n"))]
    lines += [f"model {k}   : {label}   [max_new_tokens={cap}]" for k, (label, cap) in zip("AB", models.values(), strict=True)]
    lines += ["", BAR, "SUMMARY", BAR, wide("", "A (ours)", "B (baseline)"), wide("produced a parseable assertion", share(a), share(b)), wide("exact string match vs reference", count(f"{a}_same"), count(f"{b}_same"))]
    lines += [wide("used disable iff (tb_reset)", count(f"{a}_reset"), count(f"{b}_reset")), "", "idiom distribution", F.format_string(NARROW, *map(F.lit, ("", "reference", "A", "B")))]
    lines += [F.format_string(NARROW, F.lit(kind), count(f"r{k}"), count(f"{a}{k}"), count(f"{b}{k}")) for k, kind in enumerate(IDIOMS)]
    lines += ["", RULE, "PER-RECORD RESULTS", RULE]
    return one.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("idx"), F.posexplode(F.array(*map(text, lines))).alias("line", "value"))


def comparison(records: DataFrame, order: str, title: str, models: dict[str, tuple[str, str]]) -> DataFrame:
    """(part, idx, line, value) of a report on records (name, problem, reference, and of each of two models m: m, m_completion, m_exact).

    models: column of each model's assertions, with its label and token cap; records stand in the order of a numeric column.
    """
    rows = cut(curate.numbered(records, order))
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    one = lambda x: F.array(x if isinstance(x, Column) else F.lit(x))
    parts = [one(""), one(BAR), one(F.format_string("[%d/%d] %s", F.col("n"), F.col("_total"), F.coalesce("name", F.lit("")))), one(BAR), one("PROBLEM:"), indented(F.col("problem")), one(""), one("REFERENCE:"), indented(F.col("reference"))]
    for k, (m, (label, cap)) in zip("AB", models.items(), strict=True):
        said = F.when(_held(m), F.col(m)).otherwise(failure(f"{m}_completion", cap))
        parts += [one(""), one(f"{k}  {label}:"), indented(said), one(F.concat(F.lit("   [exact_match="), F.when(F.coalesce(F.col(f"{m}_exact"), F.lit(False)), "True").otherwise("False"), F.lit("]")))]
    # the total is one row
    each = rows.join(F.broadcast(total)).select(F.lit(1).alias("part"), F.col("n").alias("idx"), F.posexplode(F.concat(*parts)).alias("line", "value"))
    end = total.select(F.lit(2).alias("part"), F.lit(0).cast("long").alias("idx"), F.posexplode(F.array(*map(F.lit, ("", RULE, "END", RULE)))).alias("line", "value"))
    return _head(rows, title, models).unionByName(each).unionByName(end)


def write(lines: DataFrame, path: str) -> None:
    """The report as text files that are in order by their names."""
    lines.repartitionByRange("part", "idx", "line").sortWithinPartitions("part", "idx", "line").select("value").write.mode("overwrite").text(path)
