"""Texts split at the strongest separator that fits, and merged again under a size with overlap.

A text is cut at the first of the ranked separators that it holds; pieces that are still too long are cut
at the next ones, the last of which is every character. Neighbouring pieces are then merged greedily up to `size` characters, and a
chunk begins with as many of the pieces before it as fit into `overlap`. One pass over the texts, each on its own.

Defined cases: a null or blank text has no chunks; white space at the ends of a chunk is dropped; a separator stays with
the piece after it; with all separators used up, a piece longer than `size` stays whole.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", " ", "")


def _cut(text: str, by: str) -> list[str]:
    if not by:
        return list(text)
    first, *rest = text.split(by)
    return [p for p in (first, *(by + r for r in rest)) if p]


def _merge(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    held, total = deque(), 0
    for p in pieces:
        if held and total + len(p) > size:
            yield "".join(held).strip()
            while held and (total > overlap or total + len(p) > size):
                total -= len(held.popleft())
        held.append(p)
        total += len(p)
    yield "".join(held).strip()


def chunks_of(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> Iterator[str]:
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    weaker, small = separators[at + 1 :], []
    for piece in _cut(text, separators[at]):
        if len(piece) < size:
            small.append(piece)
            continue
        yield from filter(None, _merge(small, size, overlap))
        small = []
        if weaker:
            yield from chunks_of(piece, size, overlap, weaker)
        else:
            yield piece
    yield from filter(None, _merge(small, size, overlap))


def _run(batches: Iterator[pa.RecordBatch], size: int, overlap: int, separators: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, text in enumerate(b.column(0).to_pylist()):
            made = list(chunks_of(text, size, overlap, separators)) if text else []
            if made:
                row = b.column(1).take(pa.array([i] * len(made)))
                yield pa.RecordBatch.from_arrays([row, pa.array(range(len(made)), pa.int32()), pa.array(made, pa.string())], ["_row", "chunk", "content"])


def recursive_chunks(docs: DataFrame, size: int, overlap: int, text: str = "text", keep: list[str] | None = None, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """`docs` (their columns `keep`; default: all but the text) with chunk (from 0) and content."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap has to be less than the size")
    keep = keep or [c for c in docs.columns if c != text]
    keyed = docs.select(F.col(text).alias("_text"), F.struct(*keep).alias("_row"))
    shape = keyed.select("_row", F.lit(0).alias("chunk"), F.lit("").alias("content")).schema
    return keyed.mapInArrow(partial(_run, size=size, overlap=overlap, separators=separators), shape).select("_row.*", "chunk", "content")
