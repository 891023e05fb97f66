"""Sequences as automata: whether an attempt matches, can still match, is disabled or has failed.

A sequence is built from Boolean columns with the functions below and compiled to a small automaton whose
letters are the valuations of those columns. A trace is read backwards: at each tick a bit mask has the
states from which a match comes later in the trace, one those from which the trace ends on a live
prefix, one those from which the attempt meets the reset. So every start tick is answered in one pass, and the live
prefix of a weak sequence comes from the automaton.

A trace may hold any share of the rows. Its ticks are dealt into blocks; a block is summed up as the relation between its
first and last states, the relations of a trace's blocks are composed from the last to the first, and then each
block is read on its own with the masks that hold at its end.

Defined cases: null samples are false; ticks of a trace are distinct; a trace without ticks has no
attempts. An empty match (`b[*0:$]`) is a match, also of a strong sequence. A fusion (`##0`) joins no empty match.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lemmata.operators.temporal import TICK, TRACE

#: ticks of a block; states that a mask holds; distinct samples of a sequence
BLOCK, STATES, SAMPLES = 4096, 62, 8
MATCH, DISABLED, LIVE, FAIL = "match", "disabled", "live", "fail"


# sequences


@dataclass(frozen=True)
class Seq:
    """A sequence: its operator, parts and bounds (high None: no bound)."""

    kind: str
    parts: tuple = ()
    low: int = 0
    high: int | None = None


def tick(sample: str) -> Seq:
    """A Boolean column, or SQL expression of columns, at one tick."""
    return Seq("tick", (sample,))


def delay(first: Seq, then: Seq, m: int = 1, n: int | None = -1) -> Seq:
    """`first ##[m:n] then`; n defaults to m, None is `$`."""
    return Seq("delay", (first, then), m, m if n == -1 else n)


def repeat(s: Seq, m: int, n: int | None = None) -> Seq:
    """`s[*m:n]`."""
    return Seq("repeat", (s,), m, n)


def goto(sample: str, m: int, n: int | None = None) -> Seq:
    """`b[->m:n]`."""
    return repeat(delay(repeat(Seq("unless", (sample,)), 0), tick(sample)), m, n)


def nonconsecutive(sample: str, m: int, n: int | None = None) -> Seq:
    """`b[=m:n]`."""
    return delay(goto(sample, m, n), repeat(Seq("unless", (sample,)), 0))


def either(a: Seq, b: Seq) -> Seq:
    """`a or b`."""
    return Seq("or", (a, b))


def both(a: Seq, b: Seq) -> Seq:
    """`a and b`: both match, the later end is the end."""
    ever = repeat(Seq("true"), 0)
    return either(intersect(delay(a, ever), b), intersect(a, delay(b, ever)))


def intersect(a: Seq, b: Seq) -> Seq:
    return Seq("intersect", (a, b))


def throughout(sample: str, s: Seq) -> Seq:
    return Seq("throughout", (sample, s))


def within(inner: Seq, outer: Seq) -> Seq:
    ever = repeat(Seq("true"), 0)
    return intersect(delay(delay(ever, inner), ever), outer)


def first_match(s: Seq) -> Seq:
    return Seq("first", (s,))


# automata


@dataclass
class Automaton:
    """States from 0 (the start, which no edge enters), edges (from, letters, to) with letters as a bit mask, ends."""

    n: int
    edges: set[tuple[int, int, int]]
    ends: set[int]
    samples: list[str] = field(default_factory=list)

    def from_(self, state: int) -> list[tuple[int, int]]:
        return [(m, q) for p, m, q in self.edges if p == state]


def _samples(s: Seq) -> list[str]:
    own = [p for p in s.parts if isinstance(p, str)]
    return list(dict.fromkeys(own + [x for p in s.parts if isinstance(p, Seq) for x in _samples(p)]))


def _after(a: Automaton, b: Automaton, fused: bool = False) -> Automaton:
    """Words of a followed by words of b; fused: the last letter of the one is the first of the other."""
    up = lambda q: q + a.n - 1
    edges = a.edges | {(up(p), m, up(q)) for p, m, q in b.edges if p}
    first = b.from_(0)
    if fused:
        edges |= {(p, m & k, up(q)) for p, m, f in a.edges if f in a.ends for k, q in first}
    else:
        edges |= {(f, k, up(q)) for f in a.ends for k, q in first}
    return Automaton(a.n + b.n - 1, edges, {up(q) for q in b.ends if q} | (a.ends if 0 in b.ends and not fused else set()))


def _or(a: Automaton, b: Automaton) -> Automaton:
    up = lambda q: q + a.n - 1 if q else 0
    return Automaton(a.n + b.n - 1, a.edges | {(up(p), m, up(q)) for p, m, q in b.edges}, a.ends | {up(q) for q in b.ends})


def _times(a: Automaton, m: int, n: int | None) -> Automaton:
    none = Automaton(1, set(), {0})
    if n is None:
        again = Automaton(a.n, a.edges | {(f, k, q) for f in a.ends for k, q in a.from_(0)}, set(a.ends))
        out = again if m else _or(again, none)
        m = max(0, m - 1)
    else:
        out = none
        for _ in range(n - m):
            out = _or(_after(a, out), none)
    for _ in range(m):
        out = _after(a, out)
    return out


def _product(a: Automaton, b: Automaton) -> Automaton:
    known, todo, edges = {(0, 0): 0}, [(0, 0)], set()
    for p, q in todo:
        for m, x in a.from_(p):
            for k, y in b.from_(q):
                if m & k:
                    if (x, y) not in known:
                        known[x, y] = len(known)
                        todo.append((x, y))
                    edges.add((known[p, q], m & k, known[x, y]))
    return Automaton(len(known), edges, {i for (x, y), i in known.items() if x in a.ends and y in b.ends})


def _first(a: Automaton, letters: int) -> Automaton:
    """Words of a without a shorter match: subsets of states, none leaves one that holds an end."""
    known, todo, edges = {frozenset([0]): 0}, [frozenset([0])], {}
    for s in todo:
        if s & a.ends:
            continue
        for x in range(letters):
            t = frozenset(q for p, m, q in a.edges if p in s and m >> x & 1)
            if t:
                if t not in known:
                    known[t] = len(known)
                    todo.append(t)
                edges[known[s], known[t]] = edges.get((known[s], known[t]), 0) | 1 << x
    return Automaton(len(known), {(p, m, q) for (p, q), m in edges.items()}, {i for s, i in known.items() if s & a.ends})


def _trim(a: Automaton) -> Automaton:
    """Only states on a way from the start to an end."""
    edges = {e for e in a.edges if e[1]}
    ahead, back = {0}, set(a.ends)
    for seen, i, j in ((ahead, 0, 2), (back, 2, 0)):
        while more := {e[j] for e in edges if e[i] in seen} - seen:
            seen |= more
    use = {0} | (ahead & back)
    name = {q: i for i, q in enumerate(sorted(use))}
    return Automaton(len(use), {(name[p], m, name[q]) for p, m, q in edges if p in use and q in use}, {name[q] for q in a.ends & use})


def automaton(s: Seq) -> Automaton:
    """The automaton of a sequence, over the valuations of its samples (bit i of a letter: sample i)."""
    samples = _samples(s)
    if len(samples) > SAMPLES:
        raise ValueError(f"a sequence has at most {SAMPLES} samples; put Boolean expressions into one")
    letters = 1 << len(samples)
    every = (1 << letters) - 1
    of = lambda x: sum(1 << v for v in range(letters) if v >> samples.index(x) & 1)

    def build(s: Seq) -> Automaton:
        parts = [build(p) for p in s.parts if isinstance(p, Seq)]
        if s.kind in ("tick", "unless", "true"):
            m = every if s.kind == "true" else of(s.parts[0]) if s.kind == "tick" else every & ~of(s.parts[0])
            made = Automaton(2, {(0, m, 1)}, {1})
        elif s.kind == "delay":
            gap = Automaton(2, {(0, every, 1)}, {1})
            if s.low:
                made = _after(_after(parts[0], _times(gap, s.low - 1, None if s.high is None else s.high - 1)), parts[1])
            else:
                made = _after(*parts, fused=True)
                if s.high != 0:
                    made = _or(made, _after(_after(parts[0], _times(gap, 0, None if s.high is None else s.high - 1)), parts[1]))
        elif s.kind == "repeat":
            made = _times(parts[0], s.low, s.high)
        elif s.kind == "or":
            made = _or(*parts)
        elif s.kind == "intersect":
            made = _product(*parts)
        elif s.kind == "throughout":
            made = Automaton(parts[0].n, {(p, m & of(s.parts[0]), q) for p, m, q in parts[0].edges}, parts[0].ends)
        else:
            made = _first(parts[0], letters)
        return _trim(made)

    a = build(s)
    if a.n > STATES:
        raise ValueError(f"the sequence has {a.n} states, at most {STATES} are read")
    a.samples = samples
    return a


@dataclass
class Reader:
    """Steps back over one letter; bit `len(samples)` of a letter is the reset."""

    automaton: Automaton

    def __post_init__(self) -> None:
        a = self.automaton
        self.end = sum(1 << q for q in a.ends)
        self.live = sum(1 << p for p in {p for p, _, _ in a.edges})
        self.reset, self.known = 1 << len(a.samples), {}

    def before(self, letter: int, masks: tuple[int, ...]) -> tuple[int, ...]:
        """Masks one tick earlier: (match ahead, reset ahead, and any further relations to states ahead)."""
        found = self.known.get((letter, masks))
        if found is None:
            if letter & self.reset:
                found = (0, self.live, *[0] * (len(masks) - 2))
            else:
                to = [0] * self.automaton.n
                for p, m, q in self.automaton.edges:
                    if m >> letter & 1:
                        to[p] |= 1 << q
                back = lambda v: sum(1 << p for p, x in enumerate(to) if x & v)
                found = (back(masks[0] | self.end), *map(back, masks[1:]))
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[letter, masks] = found
        return found


# traces

_KEYS = ("_trace", "_block")




def _sum_up(batches: Iterator[pa.RecordBatch], reader: Reader, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Per block, read backwards: the masks of an end without anything ahead, and the states before that reach each state behind."""
    start = (0, 0, *[1 << i for i in range(reader.automaton.n)])
    key, masks = None, start
    for b in batches:
        out = []
        for one in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
            if one[:2] != key:
                if key is not None:
                    out.append((key, masks))
                key, masks = one[:2], start
            masks = reader.before(one[2], masks)
        yield _table(out, schema)
    if key is not None:
        yield _table([(key, masks)], schema)


def _table(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k, _ in rows], schema.field(0).type), pa.array([k[1] for k, _ in rows], pa.int64()), pa.array([list(m) for _, m in rows], pa.list_(pa.int64()))], schema=schema
    )


def _carry(batches: Iterator[pa.RecordBatch], reader: Reader, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Per block of a trace, the last first: the masks (match, reset, live) at its end."""
    trace, now, seen = None, (0, 0, reader.live), False
    through = lambda m, v: sum_or(x for i, x in enumerate(m[2:]) if v >> i & 1)
    for b in batches:
        out = []
        for t, block, m in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
            if not seen or t != trace:
                trace, now, seen = t, (0, 0, reader.live), True
            out.append(((t, block), now))
            now = (m[0] | through(m, now[0]), m[1] | through(m, now[1]), through(m, now[2]))
        yield _table(out, schema)


def sum_or(values) -> int:
    out = 0
    for v in values:
        out |= v
    return out


def _answer(batches: Iterator[pa.RecordBatch], reader: Reader) -> Iterator[pa.RecordBatch]:
    """Each row with its attempt's outcome, blocks read backwards from the masks at their ends."""
    key, masks = None, ()
    empty = 0 in reader.automaton.ends
    for b in batches:
        out = []
        for t, block, letter, carried in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
            if (t, block) != key:
                key, masks = (t, block), tuple(carried)
            masks = reader.before(letter, masks)
            met = masks[0] & 1 or (empty and not letter & reader.reset)
            out.append(MATCH if met else DISABLED if masks[1] & 1 else LIVE if masks[2] & 1 else FAIL)
        yield pa.RecordBatch.from_arrays([b.column(4), pa.array(out, pa.string())], ["_row", "_outcome"])


def outcome(trace: DataFrame, s: Seq, name: str, reset: str | None = None) -> DataFrame:
    """`trace` with the outcome of the attempt that starts at each tick.

    match: the sequence matches before any reset; disabled: the reset (`disable iff`) comes while
    a match could still come; live: the trace ends there; fail: no match can come.
    """
    a = automaton(s)
    reader = Reader(a)
    bits = [F.when(F.coalesce(F.expr(x), F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate([*a.samples, *([reset] if reset else [])])]
    letter = sum(bits[1:], bits[0]) if bits else F.lit(0)
    keyed = trace.select(F.col(TRACE).alias("_trace"), F.floor(F.col(TICK) / BLOCK).alias("_block"), letter.cast("long").alias("_letter"), F.col(TICK).alias("_tick"), F.struct("*").alias("_row"))

    kept = StructType([keyed.schema["_trace"], StructField("_block", LongType())])
    masks = StructType([*kept.fields, StructField("_masks", keyed.select(F.array(F.lit(0).cast("long"))).schema[0].dataType)])
    arrow = _arrow(masks)
    ordered = lambda df, *last: df.repartition(*_KEYS).sortWithinPartitions(*_KEYS, *last)
    summed = ordered(keyed.drop("_row"), F.desc("_tick")).select(*_KEYS, "_letter").mapInArrow(partial(_sum_up, reader=reader, schema=arrow), masks)
    by_trace = summed.repartition("_trace").sortWithinPartitions("_trace", F.desc("_block"))
    carried = by_trace.mapInArrow(partial(_carry, reader=reader, schema=arrow), masks).withColumnsRenamed({"_trace": "_t", "_block": "_b"})
    told = keyed.join(carried, F.col("_trace").eqNullSafe(F.col("_t")) & (F.col("_block") == F.col("_b")))
    rows = ordered(told, F.desc("_tick")).select(*_KEYS, "_letter", "_masks", "_row")
    answered = rows.mapInArrow(partial(_answer, reader=reader), StructType([keyed.schema["_row"], StructField("_outcome", StringType())]))
    return answered.select(*[F.col("_row").getField(c).alias(c) for c in trace.columns], F.col("_outcome").alias(name))


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def strong(trace: DataFrame, s: Seq, name: str, reset: str | None = None) -> DataFrame:
    """`strong(s)`: a match comes (or, with a reset, the attempt is disabled)."""
    return _held(trace, s, name, reset, (MATCH, DISABLED))


def weak(trace: DataFrame, s: Seq, name: str, reset: str | None = None) -> DataFrame:
    """`weak(s)`: as strong, or the trace ends while a match can still come."""
    return _held(trace, s, name, reset, (MATCH, DISABLED, LIVE))


def _held(trace: DataFrame, s: Seq, name: str, reset: str | None, good: tuple[str, ...]) -> DataFrame:
    found = outcome(trace, s, "_how", reset)
    held: Column = F.col("_how").isin(*good)
    return found.withColumn(name, held).drop("_how")
