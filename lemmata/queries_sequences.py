"""Registered queries on sequences: automata and intervals of ends, with SQL from strings and pairs of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.operators import automaton as A
from lemmata.operators import ends as I
from lemmata.operators import temporal as E
from lemmata.queries import _TRACE_SQL, _trace, query

#: the attempts of `sequence_outcomes`: the sequence, and in SQL what a match begins with and what may still become one,
#: over a letter for each tick (a to h: bit 0 is a, bit 1 b, bit 2 g)
_ATTEMPTS = {
    "delay": (lambda: A.delay(A.delay(A.tick("a"), A.repeat(A.tick("b"), 1, 3)), A.tick("b"), 2), "^[bdfh][cdgh]{1,3}.[cdgh]", "([bdfh]([cdgh]{1,3}.?)?)?"),
    "empty": (lambda: A.delay(A.repeat(A.tick("b"), 0), A.tick("a")), "^[cdgh]*[bdfh]", "[cdgh]*"),
    "goto": (lambda: A.delay(A.goto("b", 2), A.tick("a")), "^([abef]*[cdgh]){2,}[bdfh]", ".*"),
    "throughout": (lambda: A.throughout("g", A.delay(A.tick("a"), A.goto("b", 2, 2))), "^[fh]([ef]*[gh]){2}", "([fh]([ef]*[gh])?[ef]*)?"),
}
_LETTERS = """let AS (SELECT trace_id, string_agg(CASE WHEN r THEN 'R' ELSE chr(97 + a::INT + 2 * b::INT + 4 * g::INT) END, '' ORDER BY tick) AS w FROM tr GROUP BY trace_id),
sfx AS (SELECT tr.trace_id, tick, regexp_extract(substr(w, tick + 1), '^[^R]*') AS w, contains(substr(w, tick + 1), 'R') AS reset FROM tr JOIN let ON tr.trace_id = let.trace_id)"""


@query(
    f"WITH {_TRACE_SQL}, {_LETTERS} "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS op, trace_id, tick, CASE WHEN regexp_matches(w, '{m}') THEN 'match' WHEN NOT regexp_full_match(w, '{p}') THEN 'fail' WHEN reset THEN 'disabled' ELSE 'live' END AS outcome FROM sfx"
        for n, (_, m, p) in _ATTEMPTS.items()
    )
)
def sequence_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    t, out = _trace(spark, sf), None
    for name, (make, _, _) in _ATTEMPTS.items():
        found = A.outcome(t, make(), "outcome", reset="r").select(F.lit(name).alias("op"), "trace_id", "tick", "outcome")
        out = found if out is None else out.unionByName(found)
    return out


@query(f"""WITH {_TRACE_SQL}, let AS (SELECT trace_id, string_agg(chr(97 + a::INT + 2 * b::INT + 4 * g::INT), '' ORDER BY tick) AS w FROM tr GROUP BY trace_id)
SELECT tr.trace_id, tick, regexp_matches(substr(w, tick + 1), '^[bdfh][cdgh].*[cdgh][cdgh]') AS strong_p, regexp_matches(substr(w, tick + 1), '^[bdfh][cdgh].*[cdgh][cdgh]') OR regexp_full_match(substr(w, tick + 1), '[bdfh]([cdgh].*)?') AS weak_p
FROM tr JOIN let ON tr.trace_id = let.trace_id""")
def weak_and_strong(spark: SparkSession, sf: str) -> DataFrame:
    s = A.delay(A.delay(A.tick("a"), A.tick("b")), A.repeat(A.tick("b"), 2, 2), 1, None)
    return A.weak(A.strong(_trace(spark, sf), s, "strong_p"), s, "weak_p").select("trace_id", "tick", "strong_p", "weak_p")


#: pairs of ticks of a trace with what lies between: b and not g counted, `a ##1 b` begun before the end
_SPANS = """run AS (SELECT *, sum(b::INT) OVER w AS sb, sum((NOT g)::INT) OVER w AS sn, coalesce(a AND lead(b) OVER (PARTITION BY trace_id ORDER BY tick), FALSE) AS ab, max(tick) OVER (PARTITION BY trace_id) AS stop FROM tr WINDOW w AS (PARTITION BY trace_id ORDER BY tick)),
pre AS (SELECT *, coalesce(sum(ab::INT) OVER (PARTITION BY trace_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sab FROM run),
x AS (SELECT s.trace_id AS trace_id, s.tick AS start, e.tick AS stop, s.a AS a0, e.b AS be, e.a AS ae, e.sb - s.sb + s.b::INT AS nb, e.sn - s.sn + (NOT s.g)::INT AS nn, e.sab - s.sab AS nab FROM pre s JOIN pre e ON s.trace_id = e.trace_id AND e.tick >= s.tick)"""
_SETS = {
    "open_goto": (lambda t: I.goto(t, "b", 2), "be AND nb >= 2"),
    "open_nonconsecutive": (lambda t: I.nonconsecutive(t, "b", 1), "nb >= 1"),
    "bounded_nonconsecutive": (lambda t: I.nonconsecutive(t, "b", 2, 3), "nb BETWEEN 2 AND 3"),
    "open_delay": (lambda t: I.delay(I.tick(t, "a"), "b", 1, None), "a0 AND be AND stop > start"),
    "throughout": (lambda t: I.throughout("g", I.goto(t, "b", 1)), "be AND nb >= 1 AND nn = 0"),
    "within": (lambda t: I.within(I.delay(I.tick(t, "a"), "b", 1, 1), I.goto(t, "b", 2)), "be AND nb >= 2 AND nab > 0"),
    "intersect": (lambda t: I.intersect(I.goto(t, "b", 1), I.delay(I.tick(t, "a"), "b", 2, None)), "be AND a0 AND stop >= start + 2"),
    "first_match": (lambda t: I.first_match(I.goto(t, "b", 2)), "be AND nb = 2"),
}


@query(
    f"WITH {_TRACE_SQL}, {_SPANS} "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS op, trace_id, start, min(stop) AS first, max(stop) AS last, count(*) AS n, count(*) FILTER (ae) AS n_true FROM x WHERE {where} GROUP BY trace_id, start" for n, (_, where) in _SETS.items()
    )
)
def sequence_intervals(spark: SparkSession, sf: str) -> DataFrame:
    t, out = _trace(spark, sf), None
    for name, (make, _) in _SETS.items():
        found = I.counts(make(t), "a").select(F.lit(name).alias("op"), "trace_id", "start", "first", "last", "n", "n_true")
        out = found if out is None else out.unionByName(found)
    return out


@query(f"""WITH {_TRACE_SQL}, {_SPANS}, j AS (SELECT x.trace_id, start, x.ae AS p0, v.a AS p1 FROM x LEFT JOIN tr v ON x.trace_id = v.trace_id AND v.tick = x.stop + 1 WHERE be AND nb >= 1),
m AS (SELECT trace_id, start, bool_and(p0) AS o, bool_and(coalesce(p1, TRUE)) AS n, bool_or(p0) AS f, bool_or(coalesce(p1, FALSE)) AS fn FROM j GROUP BY 1, 2)
SELECT tr.trace_id, tick, coalesce(o, TRUE) AS overlapped, coalesce(n, TRUE) AS next_cycle, coalesce(f, FALSE) AS followed, coalesce(fn, FALSE) AS followed_next FROM tr LEFT JOIN m ON tr.trace_id = m.trace_id AND tick = m.start""")
def open_implications(spark: SparkSession, sf: str) -> DataFrame:
    out = _trace(spark, sf)
    s = I.goto(out, "b", 1)
    for name, shift, followed in (("overlapped", 0, False), ("next_cycle", 1, False), ("followed", 0, True), ("followed_next", 1, True)):
        found = I.suffix(s, "a", name, shift, followed).select("trace_id", "tick", name)
        out = out.join(found, ["trace_id", "tick"])
    return out.select("trace_id", "tick", "overlapped", "next_cycle", "followed", "followed_next")


@query(f"""WITH {_TRACE_SQL}, up AS (SELECT *, lag(g, 1, FALSE) OVER (PARTITION BY trace_id ORDER BY tick) AS before FROM tr)
SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY tick) - 1 AS tick, a, b, d FROM up WHERE g AND NOT before""")
def clocked_trace(spark: SparkSession, sf: str) -> DataFrame:
    return E.clocked(_trace(spark, sf), "g").select("trace_id", "tick", "a", "b", "d")
