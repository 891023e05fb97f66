"""N-gram Jaccard join by PartEnum signatures.

Texts become sets of word shingles. The feature domain is hashed into groups of three partitions and
each signature is the projection of a set on two of the three partitions of one group, so sets that
differ in few features agree on at least one signature of their size band. Bands double in size; a
set near the lower edge of its band also signs for the band below, so any two sets whose sizes allow
the threshold share a band. Sets of up to 13 features sign by enumerating their subsets with up to
two features removed, which finds every similar pair. Larger sets sign for 21 groups, a sample of those
that PartEnum would enumerate: a pair at the threshold agrees on a signature with probability of 0.33 or
more, on about 20 of 63, and candidates are pairs with three. That no similar pair agrees on fewer is
measured (412,000 simulated pairs, none did) and not proven. Every candidate is verified exactly, in
blocks of bounded size; nothing is capped.

Texts are looked up by id and hash of the text, once for each class, so rows without an id, or of
one id, meet no other's text.

Defined cases: a null or empty text, or one without words, has an empty set, links with nothing and
is its own component; very long texts are taken whole; repeated rows and equal texts are one class; a null doc_id is kept and takes
part like any other (it reports the least non-null doc_id of its component, else null); further
columns of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lemmata.llm import _graph
from lemmata.llm._bytes import LOWER, NON_SPACE, U, list_array, mix, ngram_sets, signed, words

GROUPS, TINY, LEAST = 21, 13, 12
#: features that a projection holds at a band's lower edge
HELD = 2.5
#: stands for a null id where the texts of classes are looked up
NO_ID = (1 << 63) - 1


def _salt(*xs: int) -> np.ndarray:
    v = np.array([0x51ED270B], U)
    for x in xs:
        v = mix(v * U(0x9FB21C651E98DF25) + np.array([x + 1], U))
    return v


def stamp(s: np.ndarray) -> int:
    """The name of a set: a 64-bit hash of its features."""
    return int(signed(mix(np.array([np.add.reduce(mix(s ^ U(0xA5A5A5A5A5A5A5A5)), dtype=U) + U(len(s))], U)))[0])


def _tiny(s: np.ndarray) -> np.ndarray:
    f = mix(s ^ U(0x1234567))
    total, n = np.add.reduce(f, dtype=U), len(s)
    made = [np.array([total], U)]
    if n >= 5:
        made.append(total - f)
    if n >= 10:
        i, j = np.triu_indices(n, 1)
        made.append(total - f[i] - f[j])
    return mix(np.concatenate(made) + _salt(7)) | U(1)


def _band(sets: np.ndarray, doc: np.ndarray, level: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and their documents; level: the band of each document, -1 for none."""
    cells = np.zeros(docs * GROUPS * 3, U)
    n1 = np.maximum(1, np.rint(LEAST * 2.0 ** np.maximum(level, 0) * 2 / 3 / HELD)).astype(np.int64)
    times = -(-GROUPS // n1)
    fprint = mix(sets ^ U(0x1234567))
    for r in range(int(times[level >= 0].max(initial=0))):
        use = (level[doc] >= 0) & (times[doc] > r)
        d, h = doc[use], mix(sets[use] ^ _salt(11, r))
        group = r * n1[d] + ((h >> U(32)).astype(np.int64) * n1[d] >> 32)
        ok = group < GROUPS
        cell = (h & U(0xFFFF)).astype(np.int64) % 3
        np.add.at(cells, (d * GROUPS + group)[ok] * 3 + cell[ok], fprint[use][ok])
    cells = cells.reshape(docs, GROUPS, 3)
    lv = (level + 1).astype(U)[:, None]
    out, who = [], []
    for k, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        x, y = cells[:, :, a], cells[:, :, b]
        salt = mix(np.arange(GROUPS, dtype=U) * U(3) + U(k))[None, :] ^ mix(lv)
        sig = mix(mix(x + salt) * U(0x9FB21C651E98DF25) + mix(y ^ salt)) & ~U(1)
        keep = ((x != 0) | (y != 0)) & (level >= 0)[:, None]
        out.append(sig[keep])
        who.append(np.nonzero(keep)[0])
    return np.concatenate(out), np.concatenate(who)


def signatures(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of each set, flat, and their offsets."""
    n, docs = np.diff(offsets), len(offsets) - 1
    doc = np.repeat(np.arange(docs), n)
    level = np.full(docs, -1, np.int64)
    big = n >= LEAST
    level[big] = np.floor(np.log2(n[big] / LEAST)).astype(np.int64)
    level[big & (LEAST * 2.0**level > n)] -= 1
    level[big & (LEAST * 2.0 ** (level + 1) <= n)] += 1
    below = np.where((level > 0) & (4 * n < 5 * LEAST * 2.0**level), level - 1, -1)
    parts = [_band(sets, doc, level, docs)]
    if (below >= 0).any():
        use = below[doc] >= 0
        parts.append(_band(sets[use], doc[use], below, docs))
    for d in np.flatnonzero((n > 0) & (n <= TINY)):
        s = _tiny(sets[offsets[d] : offsets[d + 1]])
        parts.append((s, np.full(len(s), d)))
    sig, who = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(who, kind="stable")
    return sig[order], np.searchsorted(who[order], np.arange(docs + 1))


def shingle_sets(column, n: int = 5) -> list[np.ndarray]:
    out = []
    for w in words(column, NON_SPACE, LOWER):
        s, at = ngram_sets(w, n)
        out += [s[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return out


def _sign(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for w in words(b.column(1), NON_SPACE, LOWER):
            s, at = ngram_sets(w, n)
            sig, sig_at = signatures(s, at)
            sizes = np.diff(at)
            total = np.concatenate([np.zeros(1, U), np.cumsum(mix(s ^ U(0xA5A5A5A5A5A5A5A5)), dtype=U)])
            name = signed(mix(total[at[1:]] - total[at[:-1]] + sizes.astype(U)))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(k).slice(w.lo, w.hi - w.lo) for k in (0, 2)], pa.array(sizes), pa.array(name), list_array(signed(sig), sig_at)], ["doc_id", "h", "n_shingles", "node", "sigs"]
            )


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id and n_links.

    Two documents link when their sets' Jaccard similarity is at least percent/100; component_id is
    the least doc_id reachable by links, n_links how many other documents it links with directly.
    The signatures are laid out for 80 percent; a smaller threshold is refused.
    """
    return _joined(docs, n, percent, id_col, text_col).drop("node", "root")


def _joined(docs: DataFrame, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `jaccard_join` with the name of each row's set (node) and of its component (root)."""
    if percent < 80:
        raise ValueError("the signatures hold for thresholds of 80 percent or more")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    base = _graph.cut(docs.mapInArrow(partial(_sign, n=n), "doc_id long, h long, n_shingles long, node long, sigs array<long>"))
    some = base.where("n_shingles > 0")
    # a class is represented by one text: ids may be null or come again, an id and a text's hash name the text
    at = F.coalesce("doc_id", F.lit(NO_ID))
    look = F.min(F.struct(at.alias("at"), "h"))
    classes = _graph.cut(some.groupBy("node").agg(F.min("doc_id").alias("rep"), look.alias("look"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("items")))

    keys = _graph.shared(some, "node", "sigs").groupBy("node").agg(F.collect_set("key").alias("keys"))
    # a similar pair shares three signatures; sets of up to 13 features one
    likely = keys.where((F.size("keys") >= 3) | F.exists("keys", lambda k: k.bitwiseAND(F.lit(1)) == 1))
    candidates = _graph.components(_graph.shared(likely, "node", "keys", stars=True))
    chosen = _graph.cut(candidates.join(classes, "node").select("node", "root", "look", "copies", "items"))
    named = docs.withColumn("at", at).join(chosen.select("node", "look.at", "look.h"), ["at", "h"])
    texts = named.groupBy("node").agg(F.min("text").alias("text"))
    blocks = _graph.in_blocks(chosen.drop("look"), percent).join(texts, "node")
    linked = _graph.cut(_graph.verify(blocks, partial(shingle_sets, n=n), percent, stamp))

    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    joined = _graph.components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    rooted = _graph.cut(joined.join(classes.select("node", "rep"), "node").join(links, "node"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("least"))
    found = _graph.spread_join(rooted.drop("rep"), least, "root", "node")
    facts = classes.join(found, "node", "left").select(
        "node", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("least", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = ("doc_id", "n_shingles", "component_id", F.col("n_links").cast("long").alias("n_links"), "node", "root")
    full = _graph.hot_join(some.select("doc_id", "n_shingles", "node"), _graph.cut(facts), "node", "copies", some.count()).select(*out)
    alone = base.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), "node", F.lit(None).cast("long").alias("root"))
    return full.unionAll(alone)


def _named(batches: Iterator[pa.RecordBatch], n: int, text_col: str) -> Iterator[pa.RecordBatch]:
    """The rows with the name of each one's set, null without words."""
    for b in batches:
        names = [stamp(s) if len(s) else None for s in shingle_sets(b.column(text_col), n)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.int64())], [*b.schema.names, "_name"])


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that lead their component, one row for each component.

    Rows without words and rows with a null doc_id stay. Rows that share a doc_id are told apart by
    their sets, so unlike texts under one doc_id are judged each in its own component.
    """
    # the row travels as one struct, so that no name of its columns can clash
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_own"), F.col(text_col).alias("_text"))
    again = rows.where("_own is not null").groupBy(F.col("_own").alias("_again")).count().where("count > 1").select("_again")
    unlike = not again.isEmpty()
    found = _joined(docs, n, percent, id_col, text_col) if unlike else jaccard_join(docs, n, percent, id_col, text_col)
    groups = _graph.cut(found.where("n_shingles > 0 and doc_id is not null"))
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    if not unlike:
        return rows.join(gone, F.col("_own") == F.col("_gone"), "left_anti").select("_row.*")
    kept = rows.join(again, F.col("_own") == F.col("_again"), "left_anti").join(gone, F.col("_own") == F.col("_gone"), "left_anti")
    repeated = rows.join(again, F.col("_own") == F.col("_again"), "left_semi")
    named = repeated.mapInArrow(partial(_named, n=n, text_col="_text"), StructType([*repeated.schema.fields, StructField("_name", LongType())]))
    leaders = groups.where("component_id = doc_id").select(F.col("doc_id").alias("_lead"), F.col("node").alias("_node"), F.col("root").alias("_root")).distinct()
    once = named.join(leaders, (F.col("_own") == F.col("_lead")) & (F.col("_name") == F.col("_node"))).dropDuplicates(["_lead", "_root"])
    return kept.select("_row.*").unionByName(once.select("_row.*")).unionByName(named.where("_name is null").select("_row.*"))
