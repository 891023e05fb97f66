"""Code within page lines: a state that opens at a line's indent and closes below it.

Outside of code, a line that looks like code opens a block at its indent. Inside, a line with an end mark, or one
that stands left of that indent and does not look like code, is the block's last. What a run of lines does to the state is a
small table: where it leads from outside, and for an open block at indent L, the first line that closes it (the least
threshold below L) and where the rest of the run leads. Runs are summed up apart and composed in order, so a part may have any
number of lines.

Defined cases: a null line is empty; blank lines and lines of digits alone are left out before (`page_lines`); an order is a whole number,
unique in its part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmata.functions import text as X
from lemmata.operators import blocks as B

#: consecutive order numbers of a run
BLOCK = 8192
#: fixed values: marks that end a block
END_MARKS = ("endmodule", "endinterface", "endpackage", "endprogram", "endclass", "endgenerate", ");")
#: a state: outside, or the indent of the open block; a threshold that closes nothing
OUTSIDE, NEVER = -1, 1 << 30


def page_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, content): the lines of page texts but for blank ones and page numbers; numbers are those of the text."""
    each = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("idx", "content"))
    return each.where(~F.col("content").rlike(r"\A\s*\d*\s*\z"))


def _facts(content: str):
    line = X.strip(F.coalesce(content, F.lit("")))
    looks = X.pattern_hits(line) > 0
    ends = F.exists(F.array(*[F.lit(m) for m in END_MARKS]), lambda m: F.contains(line, m))
    indent = F.length(F.coalesce(content, F.lit(""))) - F.length(line)
    closes = F.when(ends, F.lit(-1)).when(looks, F.lit(NEVER)).otherwise(indent)
    return F.when(looks & ~X.is_prose(line), indent).otherwise(F.lit(OUTSIDE)).cast("int"), closes.cast("int")


def _step(state: int, opens: int, closes: int) -> int:
    """After a line: `opens` is its indent if it may open a block, `closes` the indent above which it closes one."""
    return opens if state == OUTSIDE else OUTSIDE if state > closes else state


def _through(state: int, run: tuple) -> int:
    out, above, to = run
    if state == OUTSIDE:
        return out
    return next((t for c, t in zip(above, to, strict=True) if state > c), state)


def _sum_up(batches: Iterator[pa.RecordBatch], parts: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Per (part, block): where outside leads, and for falling thresholds where a block above each leads."""
    key, out, above, to = None, OUTSIDE, [], []

    def row(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    for b in batches:
        rows = []
        for one in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if one[: parts + 1] != key:
                if key is not None:
                    rows.append((*key, out, above, to))
                key, out, above, to = one[: parts + 1], OUTSIDE, [], []
            opens, closes = one[-2:]
            to = [_step(t, opens, closes) for t in to]
            if closes < (above[-1] if above else NEVER):
                above, to = [*above, closes], [*to, OUTSIDE]
            out = _step(out, opens, closes)
        yield row(rows)
    if key is not None:
        yield row([(*key, out, above, to)])


def _carry(batches: Iterator[pa.RecordBatch], parts: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Per (part, block) in order: the state before it."""
    part, state = None, OUTSIDE
    for b in batches:
        rows = []
        for one in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if one[:parts] != part:
                part, state = one[:parts], OUTSIDE
            rows.append((*one[: parts + 1], state))
            state = _through(state, one[parts + 1 :])
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _apply(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Each row with what its line does: open, close, inside or outside."""
    key, state = None, OUTSIDE
    for b in batches:
        did = []
        for one in zip(*[c.to_pylist() for c in b.columns[:-1]], strict=True):
            if one[: parts + 1] != key:
                key, state = one[: parts + 1], one[-1]
            after = _step(state, one[-3], one[-2])
            did.append("outside" if state == after == OUTSIDE else "open" if state == OUTSIDE else "close" if after == OUTSIDE else "inside")
            state = after
        yield pa.RecordBatch.from_arrays([b.columns[-1], pa.array(did, pa.string())], ["_row", "_did"])


def fence_state(lines: DataFrame, part: list[str], order: str, content: str = "content", name: str = "state") -> DataFrame:
    """`lines` with what each does: `open` (the first of a block), `inside`, `close` (its last) or `outside`."""
    from pyspark.sql.pandas.types import to_arrow_schema

    opens, closes = _facts(content)
    keys = [*[f"_p{i}" for i in range(len(part))], "_block"]
    keyed = lines.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(part)], F.floor(F.col(order) / BLOCK).alias("_block"), F.col(order).alias("_at"), opens.alias("_opens"), closes.alias("_closes"), F.struct("*").alias("_row"))
    ints = F.array(F.lit(0))
    shape = keyed.select(*keys, F.lit(0).alias("_out"), ints.alias("_above"), ints.alias("_to")).schema
    in_order = keyed.drop("_row").repartition(*keys).sortWithinPartitions(*keys, "_at").select(*keys, "_opens", "_closes")
    runs = in_order.mapInArrow(partial(_sum_up, parts=len(part), schema=to_arrow_schema(shape)), shape)
    by_part = runs.repartition(*keys[:-1]) if part else runs.coalesce(1)  # one row a run
    state = keyed.select(*keys, F.lit(0).alias("_state")).schema
    before = by_part.sortWithinPartitions(*keys).mapInArrow(partial(_carry, parts=len(part), schema=to_arrow_schema(state)), state)
    before = before.withColumnsRenamed({k: f"{k}_" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    told = keyed.join(before, same).repartition(*keys).sortWithinPartitions(*keys, "_at").select(*keys, "_opens", "_closes", "_state", "_row")
    done = told.mapInArrow(partial(_apply, parts=len(part)), told.select("_row", F.lit("").alias("_did")).schema)
    return done.select("_row.*", F.col("_did").alias(name))


def fenced_page(lines: DataFrame, part: list[str], order: str, content: str = "content", lang: str = "verilog") -> DataFrame:
    """(part, order, lines): what each line becomes, code blocks between fences and prose lines with their inline code fenced."""
    did = fence_state(lines, part, order, content, "_state")
    last = did.groupBy(*part).agg(F.max(order).alias("_last")).withColumnsRenamed({p: f"_l{i}" for i, p in enumerate(part)})
    same = F.lit(True)
    for i, p in enumerate(part):
        same = same & F.col(p).eqNullSafe(F.col(f"_l{i}"))
    own, open_, close = F.array(F.coalesce(content, F.lit(""))), F.array(F.lit(f"```{lang}")), F.array(F.lit("```"))
    made = F.when(F.col("_state") == "outside", B.fenced_lines(F.coalesce(content, F.lit("")), lang=lang)).when(F.col("_state") == "open", F.concat(open_, own)).when(F.col("_state") == "close", F.concat(own, close)).otherwise(own)
    ended = F.when((F.col(order) == F.col("_last")) & F.col("_state").isin("open", "inside"), F.concat(made, close)).otherwise(made)
    return did.join(last, same).select(*part, order, ended.alias("lines"))
