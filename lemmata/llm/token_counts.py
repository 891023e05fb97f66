"""Token counts of fields or sections, attributed by the offsets of a document's tokens.

Each text is encoded once, whole or, where the vocabulary drops white space, by the parts between it, which gives the same
tokens (`tokenize`); token character spans are interval-joined to the text's sections
(sorted, disjoint character ranges) inside the task that holds the text. A token counts for exactly
one section: the one that holds most of its characters, and of equals the first. Tokens with no
character in any section count for none.

The default sections are the text's lines, each with its newline. Characters are code points.

Defined cases: a null or empty text has one section 0 of no tokens when sections are lines, and none
when sections are given and null or empty; very long texts are taken whole; repeated rows are counted each; a null doc_id is kept;
sections that overlap or run backwards raise an error; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmata.llm._bytes import IDENTITY, NON_SPACE, words
from lemmata.llm.tokenize import tokenizer

SCHEMA = "doc_id long, section int, start int, end int, n_tokens long, n_crossing long"


def allocate(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token span (-1 for none), and whether it crosses a section's bound.

    Interval join on sorted disjoint sections by binary search; the sections that a token meets are
    walked only for tokens that meet more than one.
    """
    a, b = tokens[:, 0], np.maximum(tokens[:, 1], tokens[:, 0])
    first = np.searchsorted(ends, a, "right")
    last = np.searchsorted(starts, b, "left") - 1
    out = np.where(first <= last, first, -1)
    many = np.flatnonzero(first < last)
    for i in many.tolist():
        k = np.arange(first[i], last[i] + 1)
        out[i] = k[np.argmax(np.minimum(ends[k], b[i]) - np.maximum(starts[k], a[i]))]
    hit = out >= 0
    crossing = np.zeros(len(out), bool)
    crossing[hit] = (a[hit] < starts[out[hit]]) | (b[hit] > ends[out[hit]])
    return out, crossing


def _lines(chars: np.ndarray, newline: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    ends = np.append(chars[newline], total)
    return np.concatenate([[0], ends[:-1]]), ends


def _count(batches: Iterator[pa.RecordBatch], path: str, given: bool) -> Iterator[pa.RecordBatch]:
    encoder = tokenizer(path)
    for b in batches:
        ids = b.column(0)
        sections = b.column(2).to_pylist() if given else None
        for w in words(b.column(1), NON_SPACE, IDENTITY):
            _, first, spans, origin = encoder.encode(w)
            chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
            at = chars[origin][:, None] + spans
            if given:
                starts, ends, owner, number = [], [], [], []
                for d in range(w.hi - w.lo):
                    own = [(int(x["start"]), int(x["end"])) for x in sections[w.lo + d] or []]
                    if any(e < s for s, e in own) or any(x[1] > y[0] for x, y in zip(own, own[1:], strict=False)):
                        raise ValueError("sections must be sorted and disjoint")
                    starts += [s + chars[w.doc_start[d]] for s, _ in own]
                    ends += [e + chars[w.doc_start[d]] for _, e in own]
                    owner += [d] * len(own)
                    number += range(len(own))
                starts, ends, owner, number = (np.array(x, np.int64) for x in (starts, ends, owner, number))
                which, cross = np.full(len(at), -1), np.zeros(len(at), bool)
                bounds = np.searchsorted(owner, np.arange(w.hi - w.lo + 1))
                for d in range(w.hi - w.lo):
                    s = slice(int(bounds[d]), int(bounds[d + 1]))
                    t = slice(int(first[d]), int(first[d + 1]))
                    if s.stop > s.start:
                        got, cross[t] = allocate(at[t], starts[s], ends[s])
                        which[t] = np.where(got >= 0, got + s.start, -1)
            else:
                newline = np.flatnonzero(w.data == 10) + 1
                doc = np.concatenate([np.searchsorted(w.doc_start, newline - 1, "right") - 1, np.arange(w.hi - w.lo)])
                ends = np.concatenate([chars[newline], chars[w.doc_start[1:]]])
                order = np.lexsort((np.concatenate([np.zeros(len(newline)), np.ones(w.hi - w.lo)]), ends, doc))
                owner, ends = doc[order], ends[order]
                new = np.ones(len(owner), bool)
                new[1:] = owner[1:] != owner[:-1]
                starts = np.concatenate([[0], ends[:-1]])
                starts[new] = chars[w.doc_start[owner[new]]]
                number = np.arange(len(owner)) - np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(owner))))
                full = np.flatnonzero(ends > starts)
                which, cross = allocate(at, starts[full], ends[full])
                which = np.where(which >= 0, full[which], -1) if len(full) else which
            hit = which >= 0
            n = np.bincount(which[hit], minlength=len(owner))
            over = np.bincount(which[hit & cross], minlength=len(owner))
            shift = chars[w.doc_start[owner]] if len(owner) else np.zeros(0, np.int64)
            out = [ids.slice(w.lo, w.hi - w.lo).take(pa.array(owner)), pa.array(number, pa.int32()), pa.array(starts - shift, pa.int32()), pa.array(ends - shift, pa.int32()), pa.array(n, pa.int64()), pa.array(over, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])


def section_counts(docs: DataFrame, path: str, sections: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each section: doc_id, section (from 0), start, end, n_tokens, n_crossing.

    `sections` names a column of array<struct<start:int,end:int>> in code points; without it the
    text's lines are the sections. n_crossing counts the section's tokens that reach beyond it.
    """
    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    if sections:
        cols.append(F.col(sections).alias("sections"))
    return docs.select(*cols).mapInArrow(partial(_count, path=path, given=bool(sections)), SCHEMA)
