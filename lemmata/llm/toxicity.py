"""Toxic spans by a linear-chain conditional random field.

Document labels become token labels: a word or affix marks toxic tokens if its documents are toxic
so often that chance among all features does not explain it (a large-deviation bound), and tokens
of toxic documents that carry one are labelled 1, all others 0. A two-state chain over hashed word
and affix features is fitted to those tokens. For every document, forward-backward marginals give
token probabilities; their sum and maximum give a calibrated document score, and runs of likely
tokens the offending offsets (code points).

The model is fitted on at most `SAMPLE` labelled rows of at most `SAMPLE_CHARS` characters, chosen by
a hash of doc_id, and of these on the first by that hash that hold `SAMPLE_TOTAL` characters together; scoring reads every whole text. The marks and the document score are fitted on all
of these rows; the chain on segments of `TRAIN_WORDS` words: at most `TRAIN_SEGMENTS` with a toxic
token, and at most as many of every `PLAIN`th without one, both the least by a hash of row and place,
so that every row of the sample has its chance. In scoring, chains longer than `SEGMENT` words are laid out
in segments of that many, with the messages carried over their bounds: marginals are those of the whole
chain.

Defined cases: a null or empty text scores as one without toxic tokens; a null label is no label;
several labels of one doc_id count once, as toxic if any is, and of its texts the one of least hash is
learnt from; repeated rows score alike; a null doc_id
is scored and never trained on; without labels every score is 0; further columns are kept by
`drop_toxic` and ignored by `score`.
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
from lemmata.llm._bytes import ALNUM, LOWER, U, Words, mix, words

SAMPLE, SAMPLE_CHARS, SEGMENT = 8_000, 100_000, 256
#: characters of the whole sample, which the driver holds
SAMPLE_TOTAL = 64_000_000
SLOTS = 1 << 20
#: (from the word's start?, bytes): the word itself, prefixes and a suffix
AFFIXES = ((True, 4), (True, 5), (True, 6), (True, 7), (False, 5))
#: segments of each kind in the training set, words in each, and one of so many plain ones
TRAIN_SEGMENTS, TRAIN_WORDS, PLAIN = 4_000, 48, 7


@dataclass
class Model:
    weight: np.ndarray  # of each feature slot, for state 1
    bias: float
    moves: np.ndarray  # log potentials, from state (row) to state
    doc: np.ndarray  # of (1, log1p(sum), max, log1p(words) / 5) for the document score
    fitted: bool


def features(w: Words) -> np.ndarray:
    """Feature slots of each word; an affix as long as the word or longer counts as the word."""
    made = [mix(w.hashes ^ U(1))]
    size = w.end - w.start
    for k, (front, n) in enumerate(AFFIXES):
        take = np.minimum(size, n)
        h = w.span_hash(w.start, w.start + take) if front else w.span_hash(w.end - take, w.end)
        made.append(mix(h ^ np.where(size > n, U(k + 2), U(1))))
    return np.stack([(x >> U(44)).astype(np.int32) for x in made], 1)


def _norm(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    v = np.stack([zero, one], -1)
    return v / v.sum(-1, keepdims=True)


def chain(u: np.ndarray, lengths: np.ndarray, moves: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None, pairs: bool = False):
    """Marginals of state 1 for padded rows of emission scores, longest row first.

    enter: of each row the forward message after the move into its first word, leave: the backward
    message at its last word (without them rows are whole chains). With `pairs` also the sum of the
    marginals of neighbouring states, from state (row) to state.
    """
    rows, width = u.shape
    m = np.exp(moves)
    up = np.exp(np.clip(u, -30, 30))
    live = np.searchsorted(-lengths, -np.arange(width), "left")  # rows longer than t
    ahead, out = np.zeros((width, rows, 2)), np.zeros((width, rows))
    q = np.full((rows, 2), 0.5) if enter is None else enter.copy()
    for t in range(width):
        if not (k := live[t]):
            break
        v = q[:k] @ m if t else q[:k]
        ahead[t, :k] = q[:k] = _norm(v[:, 0], v[:, 1] * up[:k, t])
    b = np.full((rows, 2), 0.5) if leave is None else leave.copy()
    both = np.zeros((2, 2))
    for t in range(width - 1, -1, -1):
        if not (k := live[t]):
            continue
        x = ahead[t, :k] * b[:k]
        out[t, :k] = x[:, 1] / x.sum(1)
        psi = np.stack([b[:k, 0], b[:k, 1] * up[:k, t]], 1)
        if pairs and t:
            each = ahead[t - 1, :k, :, None] * m * psi[:, None, :]
            both += (each / each.sum((1, 2), keepdims=True)).sum(0)
        v = psi @ m.T
        b[:k] = v / v.sum(1, keepdims=True)
    return (out.T, both) if pairs else out.T


def transfer(u: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """For each padded row the product of its words' matrices (scores after moves), up to a factor; the first word's move left out."""
    rows, width = u.shape
    m = np.exp(moves)
    up = np.exp(np.clip(u, -30, 30))
    live = np.searchsorted(-lengths, -np.arange(width), "left")
    p = np.broadcast_to(np.eye(2), (rows, 2, 2)).copy()
    for t in range(width):
        if not (k := live[t]):
            break
        v = p[:k] @ m if t else p[:k]
        v = v * np.stack([np.ones(k), up[:k, t]], 1)[:, None, :]
        p[:k] = v / v.sum((1, 2), keepdims=True)
    return p


def messages(u: np.ndarray, lengths: np.ndarray, moves: np.ndarray, place: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages at the bounds of a chain's segments, so that cut chains give whole chains' marginals.

    place: a segment's number within its chain; follows: the row of the segment before it (-1 for none).
    """
    m = np.exp(moves)
    p = transfer(u, lengths, moves)
    enter, leave = np.full((len(u), 2), 0.5), np.full((len(u), 2), 0.5)
    for k in range(1, int(place.max(initial=0)) + 1):
        rows = np.flatnonzero(place == k)
        v = (enter[follows[rows]][:, None, :] @ p[follows[rows]])[:, 0] @ m
        enter[rows] = v / v.sum(1, keepdims=True)
    for k in range(int(place.max(initial=0)), 0, -1):
        rows = np.flatnonzero(place == k)
        v = (p[rows] @ leave[rows][:, :, None])[:, :, 0] @ m.T
        leave[follows[rows]] = v / v.sum(1, keepdims=True)
    return enter, leave


def segments(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of at most `size` words, longest first."""
    counts = np.diff(first)
    n = -(-counts // size)
    doc = np.repeat(np.arange(len(counts)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = first[doc] + k * size
    length = np.minimum(size, first[doc + 1] - start)
    order = np.argsort(-length, kind="stable")
    return start[order], length[order]


def marginals(w: Words, model: Model) -> np.ndarray:
    total = len(w.start)
    if not total:
        return np.zeros(0)
    f = features(w)
    u = model.bias + model.weight[f].sum(1)
    start, length = segments(w.first, SEGMENT)
    doc = np.searchsorted(w.first, start, "right") - 1
    place = (start - w.first[doc]) // SEGMENT
    by_start = np.argsort(start)
    before = by_start[np.searchsorted(start[by_start], np.maximum(start - SEGMENT, 0))]
    at = start[:, None] + np.arange(int(length.max()))[None, :]
    inside = np.arange(at.shape[1])[None, :] < length[:, None]
    scores = np.where(inside, u[np.minimum(at, total - 1)], 0)
    enter, leave = messages(scores, length, model.moves, place, np.where(place > 0, before, -1)) if place.any() else (None, None)
    p = chain(scores, length, model.moves, enter, leave)
    out = np.zeros(total)
    out[at[inside]] = p[inside]
    return out


def doc_inputs(w: Words, p: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(p)])
    most = np.zeros(w.hi - w.lo)
    full = w.counts > 0
    if full.any():
        most[full] = np.maximum.reduceat(p, w.first[:-1][full])
    return np.stack([np.ones(w.hi - w.lo), np.log1p(np.maximum(0, total[w.first[1:]] - total[w.first[:-1]])), most, np.log1p(w.counts) / 5], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        penal = np.array([1e-3, *[ridge] * (x.shape[1] - 1)])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penal), x.T @ (p - y) + penal * b)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _fit_chain(slots: np.ndarray, y: np.ndarray, length: np.ndarray, dims: int, rounds: int = 60) -> tuple[np.ndarray, float, np.ndarray]:
    """Adam on the chain's penalised log-likelihood. slots: rows x words x features, `dims` for none."""
    rows, width, _ = slots.shape
    inside = np.arange(width)[None, :] < length[:, None]
    theta, moves, bias = np.zeros(dims + 1), np.zeros((2, 2)), -2.0
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (theta, moves, np.zeros(1))]
    pairs = inside[:, 1:]
    seen = np.array([[((y[:, :-1] == i) & (y[:, 1:] == j) & pairs).sum() for j in (0, 1)] for i in (0, 1)], float)
    n = inside.sum()
    for r in range(1, rounds + 1):
        u = bias + theta[slots].sum(2)
        p, both = chain(np.where(inside, u, 0), length, moves, pairs=True)
        gap = np.where(inside, p - y, 0)
        g = np.bincount(slots.ravel(), np.repeat(gap.ravel(), slots.shape[2]), dims + 1)
        grads = [g + 0.02 * theta, both - seen + 1.0 * moves, np.array([gap.sum()]) + 0.02 * bias]
        grads[0][dims] = 0
        for x, (v, s), d in zip((theta, moves, None), state, grads, strict=True):
            v += 0.1 * (d - v)
            s += 0.01 * (d * d - s)
            step = 0.2 * (v / (1 - 0.9**r)) / (np.sqrt(s / (1 - 0.99**r)) + 1e-6 * n)
            if x is None:
                bias -= float(step[0])
            else:
                x -= step
    return theta, bias, moves


def least(held: list[tuple[int, np.ndarray, np.ndarray]]) -> int:
    """Cut to the `TRAIN_SEGMENTS` of least hash; the hash of the last one."""
    held.sort(key=lambda x: x[0])
    del held[TRAIN_SEGMENTS:]
    return held[-1][0] if held else 0


def fit(column: pa.Array | pa.ChunkedArray, toxic: np.ndarray) -> Model:
    """A model from a string column and its 0/1 labels. The texts stay in Arrow's memory."""
    none = Model(np.zeros(SLOTS, np.float32), -8.0, np.zeros((2, 2)), np.array([-30.0, 0, 0, 0]), False)
    if not len(column):
        return none
    df = np.zeros((2, SLOTS), np.int32)
    for w in words(column, ALNUM, LOWER):
        f, doc = features(w), w.doc
        key = np.unique((doc[:, None].astype(np.int64) * SLOTS + f).ravel())
        y = toxic[w.lo : w.hi][key // SLOTS]
        for k in (0, 1):
            slot, times = np.unique(key[y == k] % SLOTS, return_counts=True)
            df[k][slot] += times.astype(np.int32)
    held = np.flatnonzero(df[1])
    seen = int((df.sum(0) > 0).sum())
    a, n = df[1][held].astype(float), df[:, held].sum(0).astype(float)
    p = float(np.clip(toxic.mean(), 1e-3, 0.5))
    r = np.clip(a / n, 1e-9, 1 - 1e-9)
    deviation = n * (r * np.log(r / p) + (1 - r) * np.log((1 - r) / (1 - p)))
    marks = np.zeros(SLOTS, bool)
    marks[held[(r >= 0.7) & (deviation >= np.log(max(2, seen)) + 2)]] = True
    if not marks.any():
        none.doc = np.array([np.log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 0.5)), 0, 0, 0])
        none.fitted = True
        return none
    chosen = np.flatnonzero(marks)
    index = np.full(SLOTS, len(chosen), np.int32)
    index[chosen] = np.arange(len(chosen))
    rows: list[tuple[int, np.ndarray, np.ndarray]] = []
    plain: list[tuple[int, np.ndarray, np.ndarray]] = []
    bound = {id(rows): 1 << 64, id(plain): 1 << 64}
    for w in words(column, ALNUM, LOWER):
        f = features(w)
        y = marks[f].any(1) & (toxic[w.lo : w.hi][w.doc] == 1)
        start, length = segments(w.first, TRAIN_WORDS)
        doc = np.searchsorted(w.first, start, "right") - 1
        chance = mix((doc + w.lo).astype(U) << U(32) | (start - w.first[doc]).astype(U))
        for s, m, h in zip(start.tolist(), length.tolist(), chance.tolist(), strict=True):
            hit = y[s : s + m].any()
            held = rows if hit else plain
            if h < bound[id(held)] and (hit or h % PLAIN == 0):
                held.append((h, index[f[s : s + m]], y[s : s + m]))
                if len(held) >= 2 * TRAIN_SEGMENTS:
                    bound[id(held)] = least(held)
    for held in (rows, plain):
        least(held)
    rows = [x[1:] for x in rows + plain]
    rows.sort(key=lambda x: -len(x[1]))
    width, length = len(rows[0][1]), np.array([len(x[1]) for x in rows])
    slots = np.full((len(rows), width, 1 + len(AFFIXES)), len(chosen), np.int32)
    y = np.zeros((len(rows), width), int)
    for i, (s, t) in enumerate(rows):
        slots[i, : len(t)], y[i, : len(t)] = s, t
    theta, bias, moves = _fit_chain(slots, y, length, len(chosen))
    weight = np.zeros(SLOTS, np.float32)
    weight[chosen] = theta[:-1]
    model = Model(weight, bias, moves, np.zeros(4), True)
    x = np.concatenate([doc_inputs(w, marginals(w, model)) for w in words(column, ALNUM, LOWER)])
    model.doc = logistic(x, toxic.astype(float))
    return model


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = model.value
    for b in batches:
        for w in words(b.column(1), ALNUM, LOWER):
            p = marginals(w, m)
            z = doc_inputs(w, p) @ m.doc
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30))) if m.fitted else np.zeros(len(z))
            spans: list[list[dict]] = [[] for _ in range(w.hi - w.lo)]
            hot = np.flatnonzero(p >= 0.5)
            if len(hot):
                doc = np.searchsorted(w.first, hot, "right") - 1
                new = np.ones(len(hot), bool)
                new[1:] = (np.diff(hot) > 1) | (np.diff(doc) > 0)
                at = np.flatnonzero(new)
                for i, j in zip(at.tolist(), [*at[1:].tolist(), len(hot)], strict=True):
                    d = int(doc[i])
                    text = w.data[w.doc_start[d] : w.end[hot[j - 1]]]
                    chars = np.cumsum((text & 0xC0) != 0x80)
                    begin = int(w.start[hot[i]] - w.doc_start[d])
                    spans[d].append({"start": int(chars[begin]) - 1, "end": int(chars[-1]), "p": float(p[hot[i:j]].max())})
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(w.lo, w.hi - w.lo), pa.array(score), pa.array(spans, kind)], ["doc_id", "score", "spans"])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled rows whose crc32(doc_id) mod 4 is not 2."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).where(F.length("text") <= SAMPLE_CHARS).select("_id", "text", "toxic")
    one = rows.groupBy("_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("text"), F.col("text").alias("t")))["t"].alias("text"))
    one = _graph.cut(one)
    kept, total = [], 0
    for r in one.select("_id", F.xxhash64("_id").alias("h"), F.length("text").alias("n")).orderBy("h", "_id").collect():
        total += r["n"]
        if total > SAMPLE_TOTAL:
            break
        kept.append((r["_id"],))
    ids = F.broadcast(docs.sparkSession.createDataFrame(kept, "_id long"))
    got = one.join(ids, "_id").toArrow().sort_by("_id")
    return fit(got.column("text"), (got.column("toxic").to_numpy() > 0).astype(int))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score and spans (start, end, p) in code points."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    out = docs.mapInArrow(partial(_score, model=model), "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "spans")


def _keep(batches: Iterator[pa.RecordBatch], model, threshold: float) -> Iterator[pa.RecordBatch]:
    m = model.value
    for b in batches:
        for w in words(b.column("text"), ALNUM, LOWER):
            z = doc_inputs(w, marginals(w, m)) @ m.doc
            good = 1 / (1 + np.exp(-np.clip(z, -30, 30))) < threshold if m.fitted else np.ones(len(z), bool)
            yield b.slice(w.lo, w.hi - w.lo).filter(pa.array(good))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that score below the threshold, where they stand: nothing is shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    return docs.mapInArrow(partial(_keep, model=model, threshold=threshold), docs.schema)
