"""Temporal operators over finite clocked traces.

A trace is a frame with one row per (trace, tick); Boolean samples are columns. Per-tick operators are
columns over windows of one trace; sequences are match sets (trace, start, end). A finite trace can
refute a property, never prove it: weak operators succeed where ticks are missing, strong ones fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRACE, TICK = "trace_id", "tick"
FAR = 1 << 60


def _key():
    return Window.partitionBy(TRACE).orderBy(TICK)


def _ahead():
    # from the last tick back, so that the frame grows row by row; one up to the end would be read anew for every row
    return Window.partitionBy(TRACE).orderBy(F.desc(TICK)).rowsBetween(Window.unboundedPreceding, 0)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# sampled values


def sampled(e) -> Column:
    return _c(e)


def lsb(e) -> Column:
    return F.pmod(_c(e).cast("bigint"), F.lit(2))


def past(e, n: int = 1, default=None) -> Column:
    return F.lag(_c(e), n, default).over(_key())


def rose(e) -> Column:
    return (lsb(e) == 1) & (F.coalesce(F.lag(lsb(e), 1).over(_key()), F.lit(0)) != 1)


def fell(e) -> Column:
    return (lsb(e) == 0) & (F.coalesce(F.lag(lsb(e), 1).over(_key()), F.lit(0)) != 0)


def stable(e, default) -> Column:
    return _c(e).eqNullSafe(F.lag(_c(e), 1, default).over(_key()))


def changed(e, default) -> Column:
    return ~stable(e, default)


def past_gated(trace: DataFrame, e: str, n: int, gate: str, name: str, default=None) -> DataFrame:
    """`$past(e, n, gate)`: the value at the n-th earlier tick at which the gate was true."""
    open_ = F.coalesce(F.col(gate), F.lit(False)).cast("int")
    run = F.coalesce(F.sum(open_).over(_key().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = trace.withColumn("_seen", run)
    held = counted.where(F.coalesce(F.col(gate), F.lit(False))).select(F.col(TRACE).alias("_t"), (F.col("_seen") + 1).alias("_k"), F.col(e).alias("_v"))
    hit = (F.col(TRACE) == F.col("_t")) & (F.col("_seen") - (n - 1) == F.col("_k"))
    value = F.when(F.col("_k").isNotNull(), F.col("_v")).otherwise(F.lit(default))
    return counted.join(held, hit, "left").withColumn(name, value).drop("_seen", "_t", "_k", "_v")


# properties, one Boolean per start tick


def implies(p, q) -> Column:
    return ~_c(p) | _c(q)


def iff(p, q) -> Column:
    return _c(p) == _c(q)


def nexttime(p, n: int = 1, strong: bool = False) -> Column:
    return F.when(F.lead(F.lit(1), n).over(_key()).isNull(), F.lit(not strong)).otherwise(F.lead(_c(p), n).over(_key()))


def always(p) -> Column:
    return F.min(_c(p)).over(_ahead())


def always_range(p, m: int, n: int, strong: bool = False) -> Column:
    frame = _key().rowsBetween(m, n)
    held = F.coalesce(F.min(_c(p)).over(frame), F.lit(True))
    return held & (F.count(F.lit(1)).over(frame) == n - m + 1) if strong else held


def eventually(p) -> Column:
    """`s_eventually p`."""
    return F.max(_c(p)).over(_ahead())


def eventually_range(p, m: int, n: int, strong: bool = False) -> Column:
    frame = _key().rowsBetween(m, n)
    met = F.coalesce(F.max(_c(p)).over(frame), F.lit(False))
    return met if strong else met | (F.count(F.lit(1)).over(frame) < n - m + 1)


def until(p, q, strong: bool = False, inclusive: bool = False) -> Column:
    """`p until q` and its s_ and _with forms, from the next tick that breaks p and the next that has q."""
    breaks = F.min(F.when(~_c(p), F.col(TICK))).over(_ahead())
    met = F.min(F.when(_c(q), F.col(TICK))).over(_ahead())
    held = F.coalesce(breaks, F.lit(FAR)) > met if inclusive else F.coalesce(breaks, F.lit(FAR)) >= met
    return F.coalesce(held, F.lit(False) if strong else breaks.isNull())


# sequences: match sets (trace, start, end)


def matches(trace: DataFrame, b) -> DataFrame:
    """A Boolean as a sequence of one tick."""
    return trace.where(_c(b)).select(TRACE, F.col(TICK).alias("start"), F.col(TICK).alias("end"))


def repeat(trace: DataFrame, b, m: int, n: int | None = None) -> DataFrame:
    """`b[*m:n]`, n None for no bound; m of 0 also gives the empty match, which ends before it starts."""
    gap = F.sum(F.when(F.coalesce(_c(b), F.lit(False)), 0).otherwise(1)).over(_key().rowsBetween(Window.unboundedPreceding, 0))
    runs = trace.withColumn("_island", gap).where(_c(b))
    length = F.count(F.lit(1)).over(Window.partitionBy(TRACE, "_island").orderBy(F.desc(TICK)).rowsBetween(Window.unboundedPreceding, 0))
    most = length if n is None else F.least(length, F.lit(n))
    long = runs.withColumn("_n", most).where(F.col("_n") >= max(1, m))
    found = long.withColumn("_k", F.explode(F.sequence(F.lit(max(1, m)).cast("bigint"), F.col("_n").cast("bigint")))).select(TRACE, F.col(TICK).alias("start"), (F.col(TICK) + F.col("_k") - 1).alias("end"))
    empty = trace.select(TRACE, F.col(TICK).alias("start"), (F.col(TICK) - 1).alias("end"))
    return found.unionByName(empty) if m == 0 else found


def goto(trace: DataFrame, b, m: int, n: int, nonconsecutive: bool = False) -> DataFrame:
    """`b[->m:n]`; nonconsecutive: `b[=m:n]`, whose end reaches to the tick before the next match."""
    true = F.coalesce(_c(b), F.lit(False)).cast("int")
    seen = F.sum(true).over(_key().rowsBetween(Window.unboundedPreceding, 0)) - true
    counted = trace.withColumn("_true", true).withColumn("_seen", seen).withColumn("_last", F.max(TICK).over(Window.partitionBy(TRACE)))
    hits = counted.where("_true = 1").select(TRACE, (F.col("_seen") + 1).alias("_k"), F.col(TICK).alias("_at"), F.coalesce(F.lead(TICK).over(_key()) - 1, F.col("_last")).alias("_to"))
    wanted = counted.select(TRACE, F.col(TICK).alias("start"), F.explode(F.sequence(F.col("_seen") + m, F.col("_seen") + n)).alias("_k"))
    found = wanted.join(hits, [TRACE, "_k"])
    end = F.explode(F.sequence("_at", "_to")) if nonconsecutive else F.col("_at")
    return found.select(TRACE, "start", end.alias("end")).distinct()


def concat(s1: DataFrame, s2: DataFrame, m: int = 1, n: int | None = None) -> DataFrame:
    """`s1 ##[m:n] s2` (n defaults to m): an equi-join on each start the delay allows."""
    ahead = s1.withColumn("_next", F.explode(F.sequence(F.col("end") + m, F.col("end") + (m if n is None else n))))
    right = s2.select(F.col(TRACE).alias("_t"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return ahead.join(right, (F.col(TRACE) == F.col("_t")) & (F.col("_next") == F.col("_s"))).select(TRACE, "start", F.col("_e").alias("end")).distinct()


def concat_unbounded(s1: DataFrame, s2: DataFrame, m: int = 1) -> DataFrame:
    """`s1 ##[m:$] s2`: a range join within each trace."""
    right = s2.select(F.col(TRACE).alias("_t"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return s1.join(right, (F.col(TRACE) == F.col("_t")) & (F.col("_s") >= F.col("end") + m)).select(TRACE, "start", F.col("_e").alias("end")).distinct()


def intersect(s1: DataFrame, s2: DataFrame) -> DataFrame:
    return s1.join(s2, [TRACE, "start", "end"]).distinct()


def first_match(s: DataFrame) -> DataFrame:
    return s.groupBy(TRACE, "start").agg(F.min("end").alias("end"))


def throughout(trace: DataFrame, e, s: DataFrame) -> DataFrame:
    """`e throughout s`, from the number of false samples up to each tick."""
    false = F.when(F.coalesce(_c(e), F.lit(False)), 0).otherwise(1)
    upto = trace.select(TRACE, F.col(TICK), false.alias("_f"), F.sum(false).over(_key().rowsBetween(Window.unboundedPreceding, 0)).alias("_sum"))
    at = s.join(upto.select(TRACE, F.col(TICK).alias("start"), (F.col("_sum") - F.col("_f")).alias("_before")), [TRACE, "start"])
    return at.join(upto.select(TRACE, F.col(TICK).alias("end"), F.col("_sum").alias("_after")), [TRACE, "end"]).where("_after = _before").select(TRACE, "start", "end")


def within(s1: DataFrame, s2: DataFrame) -> DataFrame:
    """`s1 within s2`: the matches of s2 that contain one of s1."""
    inner = s1.select(F.col(TRACE).alias("_t"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return s2.join(inner, (F.col(TRACE) == F.col("_t")) & (F.col("_s") >= F.col("start")) & (F.col("_e") <= F.col("end")), "left_semi").distinct()


def strong(trace: DataFrame, s: DataFrame, name: str) -> DataFrame:
    """`strong(s)`: a match from this tick exists."""
    has = s.select(TRACE, F.col("start").alias(TICK)).distinct().withColumn("_has", F.lit(True))
    return trace.join(has, [TRACE, TICK], "left").withColumn(name, F.coalesce("_has", F.lit(False))).drop("_has")


def weak(trace: DataFrame, s: DataFrame, alive: Column, name: str) -> DataFrame:
    """`weak(s)` of explicit matches: one exists, or the trace ends while one could still come (`alive`); `automaton.weak` finds that out itself."""
    return strong(trace, s, "_strong").withColumn(name, F.col("_strong") | F.coalesce(alive, F.lit(False))).drop("_strong")


def suffix(trace: DataFrame, s: DataFrame, p: str, name: str, shift: int = 0, followed_by: bool = False) -> DataFrame:
    """`s |-> p` (shift 1: `s |=> p`), and with followed_by `s #-# p` (`#=#`).

    An implication asks every match for p and holds where there is none; a consequent beyond the
    trace holds weakly. Followed-by asks for one match with p.
    """
    at = trace.select(F.col(TRACE).alias("_t"), F.col(TICK).alias("_k"), F.col(p).alias("_p"))
    hit = (F.col(TRACE) == F.col("_t")) & (F.col("end") + shift == F.col("_k"))
    joined = s.join(at, hit, "left").select(TRACE, F.col("start").alias(TICK), F.when(F.col("_k").isNull(), F.lit(not followed_by)).otherwise(F.col("_p")).alias("_p"))
    seen = joined.groupBy(TRACE, TICK).agg((F.max("_p") if followed_by else F.min("_p")).alias("_v"))
    return trace.join(seen, [TRACE, TICK], "left").withColumn(name, F.coalesce("_v", F.lit(not followed_by))).drop("_v")


def disable_iff(trace: DataFrame, s: DataFrame, reset: str) -> DataFrame:
    """The attempts of `s` during which the reset was never true."""
    return throughout(trace, ~F.coalesce(F.col(reset), F.lit(False)), s)


def clocked(trace: DataFrame, clock: str, falling: bool = False) -> DataFrame:
    """`@(posedge clock)` (or negedge): the samples at the clock's edges as a trace of their own, ticks numbered from 0."""
    edge = fell(F.coalesce(_c(clock), F.lit(False))) if falling else rose(F.coalesce(_c(clock), F.lit(False)))
    return trace.withColumn("_edge", edge).where("_edge").drop("_edge").withColumn(TICK, (F.row_number().over(_key()) - 1).cast("long"))


def agreement(trace: DataFrame, p: str, q: str) -> DataFrame:
    """Of each finite trace whether two properties agree at every tick, the first tick where not, and either implication."""
    a, b = F.col(p), F.col(q)
    return trace.groupBy("trace_id").agg(
        F.every(a == b).alias("agree"), F.min(F.when(a != b, F.col("tick"))).alias("counterexample"), F.every(~a | b).alias("a_implies_b"), F.every(~b | a).alias("b_implies_a")
    )
