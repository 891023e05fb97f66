"""Match sets as intervals of ends: one row for each start, however many ends it has.

`Ends` holds rows (trace_id, start, first, last): the sequence that starts at `start` ends at every tick of
[first, last] that the set's gate allows (a Boolean column of the trace; None: every tick). Unbounded goto
(`b[->m:$]`), nonconsecutive repetition and `##[m:$]` so give rows linear in the trace, where explicit
(start, end) pairs grow with its square.

Rows come from windows over a trace and equi-joins on (trace, tick) or (trace, ordinal); implications count gated
ticks with prefix sums instead of visiting ends. Null samples are false; ticks of a trace are consecutive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmata.operators.temporal import TICK, TRACE


def _key():
    return Window.partitionBy(TRACE).orderBy(TICK)


def _upto():
    return _key().rowsBetween(Window.unboundedPreceding, 0)


def _ahead():
    # from the last tick back, so that the frame grows row by row; one up to the end would be read anew for every row
    return Window.partitionBy(TRACE).orderBy(F.desc(TICK)).rowsBetween(Window.unboundedPreceding, 0)


def _whole():
    return Window.partitionBy(TRACE)


def _true(sample: str | None) -> Column:
    return F.lit(True) if sample is None else F.coalesce(F.expr(sample), F.lit(False))


@dataclass
class Ends:
    trace: DataFrame
    rows: DataFrame
    gate: str | None = None

    def _with(self, rows: DataFrame, gate: str | None) -> Ends:
        return Ends(self.trace, rows.where("first <= last").select(TRACE, "start", "first", "last"), gate)


def tick(trace: DataFrame, sample: str) -> Ends:
    """A Boolean as a sequence of one tick."""
    return Ends(trace, trace.where(_true(sample)).select(TRACE, *[F.col(TICK).alias(c) for c in ("start", "first", "last")]))


def repeat(trace: DataFrame, sample: str, m: int, n: int | None = None) -> Ends:
    """`b[*m:n]` for m of 1 or more, n None for no bound."""
    if m < 1:
        raise ValueError("an empty match has no end in the trace; use an automaton")
    stop = F.coalesce(F.min(F.when(~_true(sample), F.col(TICK))).over(_ahead()) - 1, F.max(TICK).over(_whole()))
    runs = trace.select(TRACE, F.col(TICK).alias("start"), _true(sample).alias("_on"), stop.alias("_stop")).where("_on")
    last = F.col("_stop") if n is None else F.least("_stop", F.col("start") + n - 1)
    return Ends(trace, runs.select(TRACE, "start", (F.col("start") + m - 1).alias("first"), last.alias("last")).where("first <= last"))


def goto(trace: DataFrame, sample: str, m: int, n: int | None = None) -> Ends:
    """`b[->m:n]` for m of 1 or more: the m-th to the n-th (None: the last) tick with b at or after each start."""
    return _counted(trace, sample, m, n, False)


def nonconsecutive(trace: DataFrame, sample: str, m: int, n: int | None = None) -> Ends:
    """`b[=m:n]` for m of 1 or more: as `goto`, and on to the tick before b comes again."""
    return _counted(trace, sample, m, n, True)


def _counted(trace: DataFrame, sample: str, m: int, n: int | None, beyond: bool) -> Ends:
    if m < 1:
        raise ValueError("an empty match has no end in the trace; use an automaton")
    on = _true(sample).cast("int")
    seen = trace.select(TRACE, TICK, on.alias("_on"), (F.sum(on).over(_upto()) - on).alias("_seen"), F.sum(on).over(_whole()).alias("_all"), F.max(TICK).over(_whole()).alias("_end"))
    hits = seen.where("_on = 1").select(F.col(TRACE).alias("_t"), (F.col("_seen") + 1).alias("_k"), F.col(TICK).alias("_at"), F.coalesce(F.lead(TICK).over(_key()) - 1, F.col("_end")).alias("_to"))
    upto = F.col("_all") if n is None else F.least(F.col("_all"), F.col("_seen") + n)
    asked = seen.select(TRACE, F.col(TICK).alias("start"), (F.col("_seen") + m).alias("_first"), upto.alias("_last")).where("_first <= _last")
    join = lambda rows, k: rows.join(hits, (F.col(TRACE) == F.col("_t")) & (F.col(k) == F.col("_k")))
    first = join(asked, "_first").select(TRACE, "start", "_last", F.col("_at").alias("first"))
    both = join(first, "_last").select(TRACE, "start", "first", F.col("_to" if beyond else "_at").alias("last"))
    return Ends(trace, both, None if beyond else sample)


def delay(s: Ends, sample: str, m: int = 1, n: int | None = -1) -> Ends:
    """`s ##[m:n] b`; n defaults to m, None is `$`. With a bound, the ends of s have to be whole intervals or single ticks."""
    n = m if n == -1 else n
    if n is not None and s.gate is not None:
        raise ValueError("a bounded delay asks for ends without a gate; use an automaton or explicit matches")
    end = s.trace.groupBy(F.col(TRACE).alias("_t")).agg(F.max(TICK).alias("_end"))
    # where the ends are gated, only the earliest counts, and intervals begin at one
    far = F.col("_end") if n is None else F.least(F.col("_end"), F.col("last") + n)
    moved = s.rows.join(end, F.col(TRACE) == F.col("_t")).select(TRACE, "start", (F.col("first") + m).alias("first"), far.alias("last"))
    return _shrunk(s._with(moved, sample))


def _shrunk(s: Ends) -> Ends:
    """The same ends with intervals that begin and end at one."""
    if s.gate is None:
        return s
    on = _true(s.gate)
    near = s.trace.select(F.col(TRACE).alias("_t"), F.col(TICK).alias("_k"), F.min(F.when(on, F.col(TICK))).over(_ahead()).alias("_next"), F.max(F.when(on, F.col(TICK))).over(_upto()).alias("_before"))
    at = lambda rows, c: rows.join(near, (F.col(TRACE) == F.col("_t")) & (F.col(c) == F.col("_k")))
    first = at(s.rows, "first").select(TRACE, "start", F.col("_next").alias("first"), "last")
    return s._with(at(first, "last").select(TRACE, "start", "first", F.col("_before").alias("last")), s.gate)


def intersect(a: Ends, b: Ends) -> Ends:
    """Ends that both have from one start; each may have one interval for a start."""
    other = b.rows.select(F.col(TRACE).alias("_t"), F.col("start").alias("_s"), F.col("first").alias("_f"), F.col("last").alias("_l"))
    both = a.rows.join(other, (F.col(TRACE) == F.col("_t")) & (F.col("start") == F.col("_s")))
    gates = [g for g in (a.gate, b.gate) if g is not None]
    rows = both.select(TRACE, "start", F.greatest("first", "_f").alias("first"), F.least("last", "_l").alias("last"))
    return _shrunk(a._with(rows, " and ".join(f"coalesce({g}, false)" for g in gates) or None))


def first_match(s: Ends) -> Ends:
    return Ends(s.trace, s.rows.groupBy(TRACE, "start").agg(F.min("first").alias("first")).withColumn("last", F.col("first")))


def throughout(sample: str, s: Ends) -> Ends:
    """`e throughout s`: ends before the first tick at or after the start without e."""
    breaks = s.trace.select(F.col(TRACE).alias("_t"), F.col(TICK).alias("_k"), F.min(F.when(~_true(sample), F.col(TICK))).over(_ahead()).alias("_no"))
    held = s.rows.join(breaks, (F.col(TRACE) == F.col("_t")) & (F.col("start") == F.col("_k")))
    return _shrunk(s._with(held.select(TRACE, "start", "first", F.least("last", F.coalesce(F.col("_no") - 1, F.col("last"))).alias("last")), s.gate))


def within(inner: Ends, outer: Ends) -> Ends:
    """`inner within outer`: ends of outer at or after the earliest end of an inner match that starts no earlier."""
    starts = inner.rows.groupBy(F.col(TRACE).alias("_t"), F.col("start").alias("_k")).agg(F.min("first").alias("_f"))
    at = outer.trace.join(starts, (F.col(TRACE) == F.col("_t")) & (F.col(TICK) == F.col("_k")), "left").select(TRACE, TICK, "_f")
    soonest = at.select(F.col(TRACE).alias("_t"), F.col(TICK).alias("_k"), F.min("_f").over(_ahead()).alias("_done"))
    held = outer.rows.join(soonest, (F.col(TRACE) == F.col("_t")) & (F.col("start") == F.col("_k"))).where("_done is not null")
    return _shrunk(outer._with(held.select(TRACE, "start", F.greatest("first", "_done").alias("first"), "last"), outer.gate))


def explicit(s: Ends) -> DataFrame:
    """The (trace, start, end) pairs of the set, for few of them."""
    ticks = s.trace.where(_true(s.gate)).select(F.col(TRACE).alias("_t"), F.col(TICK).alias("end"))
    wide = s.rows.withColumn("_e", F.explode(F.sequence("first", "last")))
    return wide.join(ticks, (F.col(TRACE) == F.col("_t")) & (F.col("_e") == F.col("end"))).select(TRACE, "start", "end").distinct()


def counts(s: Ends, sample: str | None = None) -> DataFrame:
    """s's rows with n, the ends of each, and n_true, those at which the sample holds."""
    gate, on = _true(s.gate), _true(sample)
    total = s.trace.select(TRACE, TICK, gate.cast("int").alias("_g"), (gate & on).cast("int").alias("_p")).select(
        F.col(TRACE).alias("_t"), F.col(TICK).alias("_k"), "_g", "_p", F.sum("_g").over(_upto()).alias("_sg"), F.sum("_p").over(_upto()).alias("_sp")
    )
    at = lambda rows, c: rows.join(total, (F.col(TRACE) == F.col("_t")) & (F.col(c) == F.col("_k")))
    low = at(s.rows, "first").select(TRACE, "start", "first", "last", (F.col("_sg") - F.col("_g")).alias("_lg"), (F.col("_sp") - F.col("_p")).alias("_lp"))
    return at(low, "last").select(TRACE, "start", "first", "last", (F.col("_sg") - F.col("_lg")).alias("n"), (F.col("_sp") - F.col("_lp")).alias("n_true"))


def suffix(s: Ends, p: str, name: str, shift: int = 0, followed_by: bool = False) -> DataFrame:
    """The trace with `s |-> p` (shift 1: `s |=> p`), or with followed_by `s #-# p` (`#=#`), at each start.

    An implication holds where there is no match, and weakly beyond the trace; followed-by asks for one end with p.
    """
    then = F.coalesce(F.expr(p), F.lit(False))
    then = then if shift == 0 else F.coalesce(F.lead(then, shift).over(_key()), F.lit(not followed_by))
    held = Ends(s.trace.withColumn("_then", then), s.rows, s.gate)
    per = counts(held, "_then").groupBy(TRACE, F.col("start").alias(TICK)).agg(F.sum("n").alias("_n"), F.sum("n_true").alias("_nt"))
    value = F.coalesce(F.col("_nt"), F.lit(0)) > 0 if followed_by else F.coalesce(F.col("_nt") == F.col("_n"), F.lit(True))
    return s.trace.join(per, [TRACE, TICK], "left").withColumn(name, value).drop("_n", "_nt")
