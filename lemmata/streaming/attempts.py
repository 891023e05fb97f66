"""Outcomes of a sequence's attempts over live ticks, with late ones put in order and traces closed when idle.

Ticks (trace_id, tick, ts, samples) are buffered until the watermark has passed them and then read in the order of their numbers, so
ticks may arrive late within the watermark. A trace's state is the automaton's: for each mask of states the starts of the attempts
that are there. An attempt's outcome comes out at the tick that decides it; when the watermark has passed a trace's last
tick by the idle time, what is still open comes out as `live` and the state goes. Needs the RocksDB state store.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lemmata.operators import automaton as A

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ["trace_id", "tick", "outcome", "decided"]


class Attempts(StatefulProcessor):
    """Reads one trace's ticks; `open` holds {mask: starts} and the last tick read, `ticks` those that wait for the watermark."""

    def __init__(self, automaton: A.Automaton, idle_ms: int) -> None:
        self.a, self.idle = automaton, idle_ms
        self.reset, self.ends = 1 << len(automaton.samples), sum(1 << q for q in automaton.ends)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "held string")
        self.ticks = handle.getMapState("ticks", "tick long", "ms long, letter long")

    def _read(self, held: dict[int, list[int]], tick: int, letter: int) -> tuple[dict[int, list[int]], list[tuple]]:
        after: dict[int, list[int]] = {}
        out = []
        held = {**held, 1: [*held.get(1, []), tick]}
        for mask, starts in held.items():
            if letter & self.reset:
                out += [(s, A.DISABLED if mask > 1 or self.a.edges else A.FAIL, tick) for s in starts]
                continue
            if mask == 1 and 0 in self.a.ends:  # the empty match
                out += [(s, A.MATCH, tick) for s in starts]
                continue
            to = A.sum_or(1 << q for p, m, q in self.a.edges if mask >> p & 1 and m >> letter & 1)
            if to & self.ends or not to:
                out += [(s, A.MATCH if to else A.FAIL, tick) for s in starts]
            else:
                after.setdefault(to, []).extend(starts)
        return after, out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = 0
        for df in rows:
            for tick, ms, letter in zip(df["tick"], df["ms"], df["letter"], strict=True):
                self.ticks.updateValue((int(tick),), (int(ms), int(letter)))
                last = max(last, int(ms))
        self.handle.registerTimer(last + 1)
        self.handle.registerTimer(last + self.idle)
        yield pd.DataFrame(columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        state = json.loads(self.open.get()[0]) if self.open.exists() else {"held": [], "last": 0}
        held, last, out = {m: s for m, s in state["held"]}, state["last"], []
        due = sorted((k[0], v[0], v[1]) for k, v in self.ticks.iterator() if v[0] < now)
        for tick, ms, letter in due:
            held, more = self._read(held, tick, letter)
            out += more
            last = max(last, ms)
            self.ticks.removeKey((tick,))
        if last + self.idle <= now and not any(True for _ in self.ticks.keys()):
            out += [(s, A.LIVE, None) for starts in held.values() for s in starts]
            self.open.clear()
        else:
            self.open.update((json.dumps({"held": list(held.items()), "last": last}),))
        yield pd.DataFrame([(key[0], *row) for row in out], columns=COLUMNS).astype({"decided": "Int64"})

    def close(self) -> None:
        pass


def outcomes(stream: DataFrame, s: A.Seq, late: str = "10 seconds", idle: str = "60 seconds", reset: str | None = None) -> DataFrame:
    """(trace_id, tick, outcome, decided) of each attempt, as soon as it is decided; decided is null for what a closed trace leaves open.

    stream: trace_id (long), tick, ts and the sequence's samples; late: how far the watermark stays behind; idle: how
    long after its last tick a trace is closed.
    """
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        raise RuntimeError(f"live attempts keep their state in RocksDB: set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    a = A.automaton(s)
    letter = F.lit(0).cast("long")
    for i, x in enumerate([*a.samples, *([reset] if reset else [])]):
        letter = letter + F.when(F.coalesce(F.expr(x), F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0))
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    ticks = stream.withWatermark("ts", late).select("trace_id", F.col("tick").cast("long").alias("tick"), "ts", F.unix_millis("ts").alias("ms"), letter.alias("letter"))
    return ticks.groupBy("trace_id").transformWithStateInPandas(Attempts(a, ms), "trace_id long, tick long, outcome string, decided long", "Append", "EventTime")
