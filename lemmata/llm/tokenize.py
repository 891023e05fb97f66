"""Ids and character offsets of whole texts, each text encoded once.

Where a vocabulary file drops white space and ends words, a text's ids are those of its parts between
ASCII white space in order, and token offsets shift with the part. Parts are then found by hash in a
bounded cache, which replaces most of the encoding; `tests/llm` holds this against whole texts. Whether
a file is of this kind is probed when it is loaded; with any other file every whole text is encoded.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from lemmata.llm._bytes import IDENTITY, NON_SPACE, Words, words

#: parts that a worker keeps, and those that one call encodes
CACHE, TOGETHER = 400_000, 512
VOCABULARY = "word_bpe_49k.json"
#: words, numbers, marks and scripts between all kinds of ASCII white space, single and repeated
PROBE = "".join(a + b for a, b in zip(("The", "quick's", "12,345", "(fox)", "Straße", "東京", "e\u0301a", "!?", "it's", "'s", "привет", "a-b_c", "\u0301x", "🙂", "end."), (" ", "  ", "\t", "\n", "\n\n", "\r\n", " ", "\x0b", "\x0c", " ", " \t ", "\n ", " ", " ", ""), strict=True))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pool:
    """A growing array that can be cut back."""

    def __init__(self, shape: tuple[int, ...], kind):
        self.data, self.size = np.zeros((1 << 16, *shape), kind), 0

    def add(self, x: np.ndarray) -> None:
        if self.size + len(x) > len(self.data):
            grown = np.zeros((max(2 * len(self.data), self.size + len(x)), *self.data.shape[1:]), self.data.dtype)
            grown[: self.size] = self.data[: self.size]
            self.data = grown
        self.data[self.size : self.size + len(x)] = x
        self.size += len(x)


class WordTokenizer:
    """Ids and offsets of texts; `path` names a tokenizers file.

    The first `CACHE` parts that a worker meets stay; others are encoded when they come. New parts are
    encoded many to a call, joined by spaces, and told apart by their tokens' offsets.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_parts = self._stands_alone()
        # sorted hashes of the kept parts and their places: a tenth of a dict's memory
        self.known, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.spans = Pool((), np.uint32), Pool((2,), np.int32)
        self.begin, self.length = Pool((), np.int64), Pool((), np.int64)

    def _stands_alone(self) -> bool:
        """Whether the probe's tokens are those of its parts, at the parts' places."""
        whole, ids, spans = self.tokenizer.encode(PROBE, add_special_tokens=False), [], []
        for m in re.finditer(r"[^\x20\x09-\x0D]+", PROBE):
            part = self.tokenizer.encode(m[0], add_special_tokens=False)
            ids += part.ids
            spans += [(m.start() + a, m.start() + b) for a, b in part.offsets]
        return (whole.ids, [tuple(x) for x in whole.offsets]) == (ids, spans)

    def _learn(self, texts: list[str]) -> None:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        at = np.array(got.offsets, np.int64).reshape(-1, 2)
        owner = np.searchsorted(start, at[:, 0], "right") - 1
        n = np.bincount(owner, minlength=len(texts))
        self.begin.add(self.ids.size + np.cumsum(n) - n)
        self.length.add(n)
        self.ids.add(np.array(got.ids, np.uint32))
        self.spans.add(at - start[owner][:, None])

    def encode(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a run of documents: ids, each document's first id, each id's offsets (code points) from a byte, and that byte."""
        if not self.by_parts:
            return self._encode_whole(w)
        unique, at, back = np.unique(w.hashes, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.known, unique)
        slots = np.full(len(unique), -1, np.int64)
        met = np.flatnonzero(spot < len(self.known))
        met = met[self.known[spot[met]] == unique[met]]
        slots[met] = self.places[spot[met]]
        new = np.flatnonzero(slots < 0)
        kept = (self.ids.size, self.spans.size, self.begin.size, self.length.size)
        data = w.data.tobytes()
        slots[new] = self.begin.size + np.arange(len(new))
        lo, hi = w.start[at[new]].tolist(), w.end[at[new]].tolist()
        for a in range(0, len(new), TOGETHER):
            self._learn([data[x:y].decode("utf-8") for x, y in zip(lo[a : a + TOGETHER], hi[a : a + TOGETHER], strict=True)])
        begin, length, back = self.begin.data[slots], self.length.data[slots], back.ravel()
        n = length[back]
        first = np.concatenate([[0], np.cumsum(n)])
        index = np.repeat(begin[back] - first[:-1], n) + np.arange(first[-1])
        out = self.ids.data[index], first[w.first], self.spans.data[index], w.start[np.repeat(np.arange(len(back)), n)]
        if len(self.known) + len(new) <= CACHE:
            self.known, self.places = np.insert(self.known, spot[new], unique[new]), np.insert(self.places, spot[new], slots[new])
        else:
            self.ids.size, self.spans.size, self.begin.size, self.length.size = kept
        return out

    def _encode_whole(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data, at = w.data.tobytes(), w.doc_start.tolist()
        ids, spans = [np.zeros(0, np.uint32)], [np.zeros((0, 2), np.int32)]
        for a, b in zip(at[:-1], at[1:], strict=True):
            got = self.tokenizer.encode(data[a:b].decode("utf-8"), add_special_tokens=False)
            ids.append(np.array(got.ids, np.uint32))
            spans.append(np.array(got.offsets, np.int32).reshape(-1, 2))
        n = [len(x) for x in ids[1:]]
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(n, dtype=np.int64)]), np.concatenate(spans), np.repeat(w.doc_start[:-1], n)

    def documents(self, column) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
        for w in words(column, NON_SPACE, IDENTITY):
            ids, first, _, _ = self.encode(w)
            yield w, ids, first


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer: its cache outlives a task."""
    return WordTokenizer(path)
