"""Many operators against many texts: one multi-pattern automaton for all literals of a block.

Operators are taken to the tasks in blocks of at most about `BLOCK` bytes (measured, then dealt by hash), and
each block is one pass over the texts, with one Aho-Corasick automaton built once in a task. Regular
expressions get a literal that every match has to contain; the automaton finds the rows that hold it, and
only those are held against the expression, by the JVM. There is one plan for any number of operators.

Defined cases: a null text or operator matches nothing; the empty operator is in every text; a
repeated operator row gives its matches again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: bytes of operators in a block, each counted with so many more; bytes of rows handed on at once
BLOCK, EACH, HANDED = 8 << 20, 64, 8 << 20
PLAIN = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def literal(pattern: str) -> str | None:
    """The longest run of plain characters that every match of a regular expression contains; None if none is certain.

    Only runs outside of groups and classes count; an alternative or an inline flag anywhere gives none.
    """
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        plain = None
        if c == "\\":
            nxt = pattern[i + 1 : i + 2]
            if nxt in ("Q", ""):
                return None
            plain, i = (nxt if nxt not in PLAIN and not nxt.isalnum() else None), i + 2
            if nxt.isalnum() and nxt not in "dDwWsSbBhHvVRAzZGtnrfaeX":
                return None  # an escape with an argument or a reference
        elif c == "[":
            end = _class_end(pattern, i)
            if end is None:
                return None
            i = end
        elif c == "(":
            if pattern[i + 1 : i + 2] == "?" and pattern[i + 2 : i + 3] not in (":", "=", "!", "<", ">"):
                return None
            depth, i = depth + 1, i + 1
        elif c == ")":
            depth, i = depth - 1, i + 1
        elif c == "|":
            return None
        elif c in ".^$?*+{":
            i += 1
            if c == "{":
                i = pattern.find("}", i) + 1 or len(pattern)
        else:
            plain, i = c, i + 1
        follow = pattern[i : i + 1]
        if plain is None or depth or follow in ("?", "*", "{") and follow:
            runs.append(run)
            run = ""
        else:
            run += plain
            if follow == "+":
                runs.append(run)
                run = ""
    best = max([*runs, run], key=len)
    return best or None


def _class_end(pattern: str, i: int) -> int | None:
    """The place after a character class without nested ones."""
    i += 1 + (pattern[i + 1 : i + 2] == "^")
    i += pattern[i : i + 1] == "]"
    while i < len(pattern):
        if pattern[i] == "[":
            return None
        if pattern[i] == "]":
            return i + 1
        i += 1 + (pattern[i] == "\\")
    return None


def _blocks(right: DataFrame, op: str) -> Iterator[list[str]]:
    """The distinct operators in sorted blocks of bounded size."""
    ops = right.select(F.col(op).alias("op")).where("op is not null").distinct()
    size = ops.agg(F.coalesce(F.sum(F.octet_length("op") + EACH), F.lit(0)).alias("n")).first()["n"]
    n = -(-size // BLOCK)
    for b in range(n):
        yield sorted(r["op"] for r in ops.where(F.pmod(F.xxhash64("op"), F.lit(n)) == b).collect())


def _search(batches: Iterator[pa.RecordBatch], words: list[str | None], names: list[str], schema: pa.Schema, first: int) -> Iterator[pa.RecordBatch]:
    """The columns from `first` on of each row with the name of every word that its text (column 0) holds; None and the empty word are in every text."""
    found = ahocorasick.Automaton()
    named: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        named.setdefault(w or "", []).append(i)
    always = named.pop("", [])
    for w, ids in named.items():
        found.add_word(w, ids)
    found.make_automaton()
    for b in batches:
        row, hit, sizes = [], [], []
        for i, text in enumerate(b.column(0).to_pylist()):
            if text is None:
                continue
            ids = set(always)
            if named:
                for _, more in found.iter(text):
                    ids.update(more)
            row += [i] * len(ids)
            hit += sorted(ids)
            sizes += [len(text) + EACH] * len(ids)
        cut = np.searchsorted(np.cumsum(sizes), np.arange(HANDED, sum(sizes) + HANDED, HANDED)) + 1 if sizes else []
        lo = 0
        for hi in [*map(int, cut)]:
            hi = min(hi, len(row))
            if hi > lo:
                at = pa.array(row[lo:hi], pa.int64())
                yield pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns[first:]], pa.array([names[h] for h in hit[lo:hi]], pa.string())], schema=schema)
            lo = hi


def _found(left: DataFrame, text: str, words: list[str | None], names: list[str], keep: list[str], with_text: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    # the row travels as one struct, so that no name of its columns can clash
    keyed = left.select(F.col(text).alias("_text"), F.struct(*keep).alias("_row"))
    first = 0 if with_text else 1
    schema = StructType([*keyed.schema.fields[first:], StructField("_op", StringType())])
    return keyed.mapInArrow(partial(_search, words=words, names=names, schema=to_arrow_schema(schema), first=first), schema)


def contained(left: DataFrame, text: str, right: DataFrame, op: str, keep: list[str] | None = None) -> DataFrame:
    """The rows of `left` joined to every row of `right` whose operator is in their text.

    keep: the columns of `left` to return (default: all); a text that is left out is not repeated for each of its operators.
    """
    keep = keep or left.columns
    return _joined(left, [_found(left, text, words, words, keep, False) for words in _blocks(right, op)], right, op, keep)


def matched(left: DataFrame, text: str, rules: DataFrame, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """The rows of `left` (their columns `keep`) joined to every row of `rules` whose regular expression is found in their text."""
    keep = keep or left.columns
    hits = [_found(left, text, [literal(p) for p in patterns], patterns, keep, True) for patterns in _blocks(rules, pattern)]
    return _joined(left, [x.where(F.regexp_like("_text", F.col("_op"))) for x in hits], rules, pattern, keep)


def _joined(left: DataFrame, hits: list[DataFrame], right: DataFrame, op: str, keep: list[str]) -> DataFrame:
    if not hits:
        return left.select(*keep).join(right, F.lit(False))
    rows = reduce(DataFrame.unionByName, [x.select(*[F.col("_row").getField(c).alias(c) for c in keep], F.col("_op").alias(op)) for x in hits])
    return rows.join(right, op)
