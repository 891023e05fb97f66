"""Benchmark decontamination with word-level suffix arrays over the training documents.

Each shard of documents becomes one sorted suffix array of word numbers (prefix doubling, which stops
where all suffixes differ or the longest benchmark item is passed). Every suffix of every benchmark
item is binary-searched in every shard; the range of training suffixes that share its window gives
the occurrences, and comparison with the neighbouring suffixes beyond the window the longest verbatim
match and its place.

Defined cases: null, empty and wordless texts have no words and hit nothing; very long texts and items are taken whole; an item of fewer words
than the window is searched as a whole, one without words never; repeated rows are judged each on
its own; a null item_id is left out of the list of items, though its windows count as hits; further
columns are kept by `decontaminate` and ignored by `matches`. Empty tables give empty results, and
an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmata.llm import _graph
from lemmata.llm._bytes import ALNUM, LOWER, Words, runs, words

#: bytes of text in one shard's suffix array, and of benchmark text searched at once
SHARD, BLOCK = 1 << 20, 32 << 20
SCHEMA = "doc_id long, text string, n_words long, hits array<int>, items array<long>, longest int, longest_at int"


@dataclass
class Items:
    """Benchmark suffixes: word hashes end to end with a gap after each item, and for each suffix its place, item and item end."""

    word: np.ndarray
    gap: np.ndarray
    at: np.ndarray
    end: np.ndarray
    width: np.ndarray
    item: np.ndarray
    known: np.ndarray


def prepare(ids: list, texts: list, window: int) -> Items:
    hashes, gap, at, end, width, item, known = [], [], [], [], [], [], []
    base = 0
    for w in words(pa.array(texts, pa.large_string()), ALNUM, LOWER):
        docs = w.hi - w.lo
        hashes.append(np.insert(w.hashes, w.first[1:], np.uint64(0)))
        gap.append(np.insert(np.zeros(len(w.start), bool), w.first[1:], True))
        for d in range(docs):
            a, b = base + int(w.first[d]) + d, base + int(w.first[d + 1]) + d
            size = min(window, b - a)
            if size:
                starts = np.arange(a, b - size + 1)
                at.append(starts)
                end.append(np.full(len(starts), b))
                width.append(np.full(len(starts), size))
                item.append(np.full(len(starts), ids[w.lo + d] if ids[w.lo + d] is not None else 0))
                known.append(np.full(len(starts), ids[w.lo + d] is not None))
        base += len(w.start) + docs
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return Items(cat(hashes, np.uint64), cat(gap, bool), cat(at, np.int64), cat(end, np.int64), cat(width, np.int64), cat(item, np.int64), cat(known, bool))


def suffix_array(code: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, exact for the first `depth` words (ties by position).

    `code`: word numbers from 1, 0 between documents. Rounds after the first sort only what is tied.
    """
    n = len(code)
    rank = code.astype(np.int64)
    step, order = 1, None
    while True:
        ahead = np.zeros(n, np.int64)
        if step < n:
            ahead[: n - step] = rank[step:]
        ahead[code == 0] = 0
        key = rank * np.int64(n + 2) + ahead
        if order is None:
            order = np.argsort(key, kind="stable")
        else:
            same = np.zeros(n, bool)
            r = rank[order]
            same[1:] = r[1:] == r[:-1]
            same[:-1] |= same[1:]
            tied = np.flatnonzero(same & (code[order] > 0))
            if not len(tied):
                break
            sub = order[tied]
            order[tied] = sub[np.lexsort((sub, key[sub]))]
        k = key[order]
        fresh = np.ones(n, np.int64)
        fresh[1:] = k[1:] != k[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.where(code[order] > 0, np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) + 1, 0)
        step *= 2
        if step >= depth or fresh.all():
            break
    return order


def _order(code: np.ndarray, sa: np.ndarray, mid: np.ndarray, query: np.ndarray, q_at: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign of (training suffix - query) over the query's first `width` words, and the words in common."""
    sign, common = np.zeros(len(mid), np.int8), np.zeros(len(mid), np.int64)
    live, pos = np.arange(len(mid)), sa[mid]
    k = 0
    while len(live):
        live = live[k < width[live]]
        if not len(live):
            break
        p = pos[live] + k
        a = np.where(p < len(code), code[np.minimum(p, len(code) - 1)], 0)
        b = query[q_at[live] + k]
        sign[live] = np.sign(a - b)
        live = live[a == b]
        k += 1
        common[live] = k
    return sign, common


def search(code: np.ndarray, sa: np.ndarray, query: np.ndarray, at: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search: ranges [lo, hi) of the suffix array that begin with the query's first `width` words."""
    out = []
    for right in (False, True):
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(sa))
        while (open_ := lo < hi).any():
            i = np.flatnonzero(open_)
            mid = (lo[i] + hi[i]) // 2
            sign, _ = _order(code, sa, mid, query, at[i], width[i])
            go = sign <= 0 if right else sign < 0
            lo[i] = np.where(go, mid + 1, lo[i])
            hi[i] = np.where(go, hi[i], mid)
        out.append(lo)
    return out[0], out[1]


def longest_common(code: np.ndarray, sa: np.ndarray, places: np.ndarray, query: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """For each place of the suffix array the most words that its suffix has in common with a query's.

    Queries are sorted like the suffixes; the longest match is with one of the two neighbours.
    """
    rank = np.empty(len(query), np.int64)
    rank[suffix_array(query, int(width.max()))] = np.arange(len(query))
    order = np.argsort(rank[at], kind="stable")
    at, width = at[order], width[order]
    before = np.maximum.accumulate(search(code, sa, query, at, width)[0])
    after = np.searchsorted(before, places, "right")
    out = np.zeros(len(places), np.int64)
    for k in (after - 1, after):
        some = np.flatnonzero((k >= 0) & (k < len(at)))
        _, n = _order(code, sa, places[some], query, at[k[some]], width[k[some]])
        out[some] = np.maximum(out[some], n)
    return out


def scan(w: Words, items: Items) -> tuple[list[list[int]], list[list[int]], list[int], list[int]]:
    """Of each document of a shard: hit word runs [start, end, ...], items, longest match and its place.

    Equal windows have one range of the suffix array, and ranges of one width are disjoint, so the
    occurrences that are looked at are at most the words of the shard for each width.
    """
    docs = w.hi - w.lo
    hits: list[list[int]] = [[] for _ in range(docs)]
    found: list[list[int]] = [[] for _ in range(docs)]
    longest, place = np.zeros(docs, np.int64), np.full(docs, -1, np.int64)
    none = hits, found, longest.tolist(), place.tolist()
    if not len(w.start) or not len(items.at):
        return none
    vocabulary, number = np.unique(w.hashes, return_inverse=True)
    slot = np.minimum(np.searchsorted(vocabulary, items.word), len(vocabulary) - 1)
    there = (vocabulary[slot] == items.word) & ~items.gap
    query = np.where(items.gap, 0, np.where(there, slot + 1, len(vocabulary) + 1))
    absent = np.concatenate([[0], np.cumsum(~there)])
    ask = np.flatnonzero(absent[items.at + items.width] == absent[items.at])
    if not len(ask):
        return none
    doc = w.doc
    code = np.zeros(len(number) + docs, np.int64)
    code[np.arange(len(number)) + doc] = number.ravel() + 1
    sa = suffix_array(code, int((items.end - items.at)[ask].max()))
    lo, hi = search(code, sa, query, items.at[ask], items.width[ask])
    met = hi > lo
    ask, lo, hi = ask[met], lo[met], hi[met]
    if not len(ask):
        return none
    widest = int(items.width.max()) + 1
    _, first, window = np.unique(lo * widest + items.width[ask], return_index=True, return_inverse=True)
    window = window.ravel()
    n = (hi - lo)[first]
    each = np.repeat(np.arange(len(first)), n)
    spot = np.repeat(lo[first] - np.cumsum(n) + n, n) + np.arange(n.sum())
    index = np.full(len(code), -1, np.int64)
    index[np.arange(len(number)) + doc] = np.arange(len(number))
    word = index[sa[spot]]

    cover = np.zeros(len(number) + 1, np.int64)
    np.add.at(cover, word, 1)
    np.add.at(cover, word + items.width[ask][first][each], -1)
    begin, end = runs(np.cumsum(cover[:-1]) > 0, w.first)
    for d, a, b in zip(doc[begin].tolist(), (begin - w.first[doc[begin]]).tolist(), (end - w.first[doc[begin]]).tolist(), strict=True):
        hits[d] += [a, b]

    # windows with the same items are one set, so a passage of many windows is listed once
    sets: dict[tuple[int, ...], int] = {}
    known = items.known[ask]
    pairs = np.unique(np.stack([window[known], items.item[ask][known]], 1), axis=0)
    bounds = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1)).tolist()
    named = [sets.setdefault(tuple(pairs[a:b, 1].tolist()), len(sets)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    members = list(sets)
    got: list[set[int]] = [set() for _ in range(docs)]
    for d, k in np.unique(np.stack([doc[word], np.array(named)[each]], 1), axis=0).tolist():
        got[d].update(members[k])
    found = [sorted(x) for x in got]

    places = np.unique(spot)
    length = longest_common(code, sa, places, query, items.at[ask], (items.end - items.at)[ask])
    word = index[sa[places]]
    best = np.lexsort((word, -length, doc[word]))
    who, head = np.unique(doc[word][best], return_index=True)
    longest[who] = length[best][head]
    place[who] = (word - w.first[doc[word]])[best][head]
    return hits, found, longest.tolist(), place.tolist()


def _scan(batches: Iterator[pa.RecordBatch], items) -> Iterator[pa.RecordBatch]:
    """The rows (doc_id, text, and what earlier blocks of the benchmark found) with this block's finds."""
    for b in batches:
        for w in words(b.column(1), ALNUM, LOWER, SHARD):
            rows = b.slice(w.lo, w.hi - w.lo)
            hits, found, longest, place = scan(w, items.value)
            if b.num_columns > 2:
                old = [rows.column(i).to_pylist() for i in range(3, 7)]
                hits = [merge_runs([x, y]) for x, y in zip(hits, old[0], strict=True)]
                found = [sorted({*x, *y}) for x, y in zip(found, old[1], strict=True)]
                better = [(n, -p) >= (m, -q) for n, p, m, q in zip(longest, place, old[2], old[3], strict=True)]
                longest, place = ([x if ok else y for ok, x, y in zip(better, new, was, strict=True)] for new, was in ((longest, old[2]), (place, old[3])))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(w.counts), pa.array(hits, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64())), pa.array(longest, pa.int32()), pa.array(place, pa.int32())],
                ["doc_id", "text", "n_words", "hits", "items", "longest", "longest_at"],
            )


def merge_runs(lists: list) -> list[int]:
    out: list[int] = []
    for a, b in sorted((x[i], x[i + 1]) for x in lists for i in range(0, len(x), 2)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def blocks_of(benchmark: DataFrame, window: int, item_col: str, item_text: str) -> Iterator:
    """The benchmark as broadcast blocks of about `BLOCK` bytes of text or one item, at least one block."""
    bench = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    blocks = int(bench.agg(F.ceil(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) / BLOCK)).first()[0]) or 1
    for k in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(prepare([r[0] for r in rows], [r[1] for r in rows], window))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_words, hits (merged [start, end) word runs), items, longest, longest_at.

    The benchmark is broadcast in blocks of about `BLOCK` bytes of text, whose number follows its
    measured size. The rows pass the blocks one after the other, each adding its finds to the row; they
    are never shuffled, and between blocks they are written to the checkpoint folder.
    """
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    for k, items in enumerate(blocks_of(benchmark, window, item_col, item_text)):
        out = (out if not k else _graph.cut(out)).mapInArrow(partial(_scan, items=items), SCHEMA)
    return out.drop("text")


def report(found: DataFrame) -> DataFrame:
    """The digest of `matches`: counts, and a checksum of the items."""
    ends = F.transform("hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long"))
    total = F.aggregate(ends, F.lit(0).cast("long"), lambda s, x: s + x)
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", total.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (total > 0).alias("contaminated"), "longest"
    )


def _clean(batches: Iterator[pa.RecordBatch], items) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for w in words(b.column("text"), ALNUM, LOWER, SHARD):
            good = [not hits for hits in scan(w, items.value)[0]]
            yield b.slice(w.lo, w.hi - w.lo).filter(pa.array(good, pa.bool_()))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of `docs` without those that hold a benchmark window, where they stand."""
    out = docs
    for items in blocks_of(benchmark, window, "item_id", "text"):
        out = out.mapInArrow(partial(_clean, items=items), docs.schema)
    return out
