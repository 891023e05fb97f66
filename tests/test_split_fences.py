"""Separator-aware chunks and the state of code fences, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lemmata.functions import text as X
from lemmata.operators import fences, split


def check(text, chunks, size, overlap):
    """What the greedy merge promises, from the text alone."""
    squeezed = lambda t: re.sub(r"\s", "", t)
    at = 0
    for c in chunks:
        assert c and c == c.strip() and len(c) <= size
        on = len(text) - len(text[at:].lstrip())
        found = on if text.startswith(c, on) else text.find(c, max(0, at - overlap - 2))
        assert found >= 0
        assert not squeezed(text[at:found])  # nothing but white space is lost
        at = max(at, found + len(c))
    assert not squeezed(text[at:])


@pytest.mark.parametrize(("size", "overlap"), [(40, 10), (25, 0), (100, 30)])
def test_chunks_cover_and_fit(spark, size, overlap):
    r = random.Random(size)
    word = lambda n: "".join(r.choice("abcdefgé😀") for _ in range(n))
    texts = ["".join(r.choice([word(2), word(6) + " ", " ", "\n", "\n\n", word(60)]) for _ in range(r.choice([0, 5, 80]))) for _ in range(60)] + [None, "", "   ", word(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("chunk_", F.lit(1))
    got = {}
    for x in split.recursive_chunks(df, size, overlap).orderBy("id", "chunk").collect():
        got.setdefault(x["id"], []).append((x["chunk"], x["content"]))
    for i, t in enumerate(texts):
        mine = got.get(i, [])
        assert [n for n, _ in mine] == list(range(len(mine)))
        check(t or "", [c for _, c in mine], size, overlap)


@pytest.mark.parametrize(
    ("text", "size", "overlap", "want"),
    [
        ("a b c d", 3, 0, ["a b", "c", "d"]),
        ("one two three", 8, 4, ["one two", "three"]),
        ("aa bb cc dd", 6, 3, ["aa bb", "bb cc", "cc dd"]),
        ("first par\n\nsecond one is longer", 12, 0, ["first par", "second one", "is longer"]),
        ("abcdef", 3, 1, ["abc", "cde", "ef"]),
    ],
)
def test_worked_chunks(text, size, overlap, want):
    assert list(split.chunks_of(text, size, overlap)) == want


def walk(lines):
    """The state machine as it is told, line by line."""
    out, indent = [], None
    for line in lines:
        body = (line or "").strip()
        looks = any(re.search(p, body) for p in X.CODE_PATTERNS)
        prose = any(re.search(p, body) for p in X.PROSE_PATTERNS)
        here = len(line or "") - len(body)
        if indent is None:
            opens = looks and not prose
            out.append("open" if opens else "outside")
            indent = here if opens else None
        elif any(m in body for m in fences.END_MARKS) or (here < indent and not looks):
            out.append("close")
            indent = None
        else:
            out.append("inside")
    return out


LINES = ["wire w", "plain words", "the module is good", "endmodule", "x <= y;", "Good Words", "f(a);", "text", None]


@pytest.mark.parametrize("block", [2, 3, 8192])
@pytest.mark.parametrize("part", [["d"], []])
def test_fence_state(spark, monkeypatch, block, part):
    monkeypatch.setattr(fences, "BLOCK", block)
    r = random.Random(block)
    pages = {d: [None if (x := r.choice(LINES)) is None else " " * r.choice([0, 2, 2, 4, 7]) + x for _ in range(r.choice([1, 6, 30]))] for d in range(25 if part else 1)}
    rows = [(d, i, x) for d, lines in pages.items() for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "d int, idx long, content string").repartition(4)
    got = {(x["d"], x["idx"]): x["state"] for x in fences.fence_state(df, part, "idx").collect()}
    assert got == {(d, i): s for d, lines in pages.items() for i, s in enumerate(walk(lines))}


def test_fenced_page(spark):
    text = "Intro words\n12\n\n  wire w;\n  x <= y;\n text below\nmore the assign y = 5 long\nwire z"
    lines = fences.page_lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "d int, t string"), "d", "t")
    got = [line for r in fences.fenced_page(lines, ["d"], "idx").orderBy("idx").collect() for line in r["lines"]]
    assert got == ["Intro words", "```verilog", "  wire w;", "  x <= y;", " text below", "```", "more the ", "```verilog", "assign y =", "```", " 5 long", "```verilog", "wire z", "```"]
