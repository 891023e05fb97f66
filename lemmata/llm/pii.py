"""Personal data: base patterns, and bootstrapped contextual extraction of further identifiers.

Four base kinds (email, ip, card, phone) are found by regular expression and checked. The bootstrap
then looks at entities: the base spans, each whole, are the seeds; the others are identifier-like
tokens (a digit or an at sign, six letters or digits or more) and runs of number groups with blanks
between them, where no base span overlaps them. The word to an entity's left and the label within
its token (`key=`, `id:`) are lexical patterns. Patterns and entities form a graph of distinct edges;
in each round a pattern's confidence is the mean score of its entities (with one pseudo-count against
it; `SUPPORT` of them at least have to be seeds or promoted) and an entity's score the noisy-or of its
confident patterns. Entities that reach the bar after the last round are reported as kind `other`; of
a run and the tokens within it only the run.

DataFrame functions only. Positions are code points, ends exclusive. Matches come from marking them
within the text and adding up the lengths between marks; possessive forms keep the expressions
linear on long runs.

Defined cases: a null text is an empty one and has no spans; a null doc_id is kept; rows that repeat
doc_id and text get the same spans; characters U+0001 are read as U+0002, which no pattern matches;
very long texts are walked whole, in blocks; further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmata.llm import _graph

KINDS = ("email", "ip", "card", "phone", "other")
#: fixed patterns of the base kinds, as possessive equivalents that start only where a run starts
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: an identifier-like token: no white space, with a digit or an at sign
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: two or more number groups with blanks between them, after a label and before other signs
GROUP = r"[+(]{0,2}+[0-9][0-9()./-]*+(?=[^\s\p{L}0-9@]*+(?!\S))"
RUN = rf"(?<!\S)(?:[^\s0-9@=:]{{1,40}}+[=:])?+[^\s\p{{L}}0-9@+(]*+{GROUP}(?:[\x20\t]++{GROUP})++"
ROUNDS, BAR, SUPPORT = 3, 0.8, 3
LEFT_CHARS = 64
#: pieces of a text that are walked at once
WALK = 256
SPAN = "array<struct<start:int,kind:int,end:int>>"
SEED = "array<struct<start:int,kind:int,end:int,left:string,label:string,core:string>>"
CAND = "array<struct<start:int,end:int,left:string,label:string,core:string>>"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether a string of at most 19 digits passes the check of payment cards."""
    d = F.split(F.reverse(x), "")

    def worth(c: Column, i: Column) -> Column:
        v = c.cast("int")
        twice = v * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(v)

    return F.aggregate(F.transform(F.filter(d, lambda c: c != ""), worth), F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: int, x: Column) -> Column:
    n = F.length(digits(x))
    if kind == 1:
        return x.rlike(rf"\A{BYTE}(?:\.{BYTE}){{3}}\z")
    if kind == 2:
        return F.when(n.between(12, 19), luhn(digits(x))).otherwise(F.lit(False))
    if kind == 3:
        return n.between(9, 15)
    return F.lit(True)


def _marked(text: Column, pattern: str) -> Column:
    """Pieces of the text; those at odd places are the matches."""
    return F.split(F.regexp_replace(text, pattern, "\u0001$0\u0001"), "\u0001", -1)


def _label(token: Column) -> Column:
    return F.regexp_extract(token, r"\A([^\s0-9@=:]{1,40}[=:])", 1)


def _left(before: Column) -> Column:
    """The last word of a text, without signs; none if it is identifier-like itself."""
    word = F.regexp_extract(before, r"(?<!\S)(\S++)\s*+\z", 1)
    return F.when(word.rlike("[0-9@]"), F.lit("")).otherwise(F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}=:]", "")))


def _let(x: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(x), f)[0]


def _walk(text: Column, pattern: str, kind: str, take) -> Column:
    """What `take(at, before, piece)` makes of each match: (fits, struct), in order. `before`: the text on its left.

    The pieces are walked in blocks, so that the time follows the length of the text: lists grow
    within a block only.
    """

    def blocks(pieces: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / WALK).cast("int"))
        return F.transform(starts, lambda i: F.slice(pieces, i * WALK + 1, F.lit(WALK)))

    def offsets(cut: Column) -> Column:
        length = lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + F.length(x))
        begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        step = lambda s, b: F.struct((s["at"] + length(b)).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all"))
        return F.aggregate(cut, begun, step, lambda s: s["all"])

    def inside(block: Column, at: Column, before: Column) -> Column:
        start = F.struct(at.alias("at"), F.lit(0).alias("i"), before.alias("before"), F.array().cast(kind).alias("found"))

        def step(s: Column, x: Column) -> Column:
            fits, one = take(s["at"], s["before"], x)
            left = F.right(F.concat(s["before"], F.right(x, F.lit(LEFT_CHARS))), F.lit(LEFT_CHARS))
            found = F.when((s["i"] % 2 == 1) & fits, F.concat(s["found"], F.array(one))).otherwise(s["found"])
            return F.struct((s["at"] + F.length(x)).cast("int").alias("at"), (s["i"] + 1).alias("i"), left.alias("before"), found.alias("found"))

        return F.aggregate(block, start, step, lambda s: s["found"])

    def all_blocks(cut: Column) -> Column:
        def one(block: Column, i: Column, at: Column) -> Column:
            # a block's pieces hold as many characters as the left context asks for, or all there are
            near = F.when(i > 0, F.array_join(F.get(cut, i - 1), "")).otherwise(F.lit(""))
            return inside(block, at, F.right(near, F.lit(LEFT_CHARS)))

        return _let(offsets(cut), lambda at: F.flatten(F.transform(cut, lambda block, i: one(block, i, F.get(at, i)))))

    return _let(_marked(text, pattern), lambda pieces: _let(blocks(pieces), all_blocks))


def base_spans(text: Column, kind: int, pattern: str) -> Column:
    """The valid spans of one kind with the word on their left, the label of their token and their text."""

    def take(at: Column, before: Column, x: Column) -> tuple[Column, Column]:
        begun = F.regexp_extract(before, r"(?<!\S)(\S++)\z", 1)
        left = _left(F.substr(before, F.lit(1), F.length(before) - F.length(begun)))
        to = (at + F.length(x)).cast("int")
        return _valid(kind, x), F.struct(at.alias("start"), F.lit(kind).alias("kind"), to.alias("end"), left.alias("left"), F.lower(_label(begun)).alias("label"), x.alias("core"))

    return _walk(text, pattern, SEED, take)


def candidates(text: Column, pattern: str) -> Column:
    """Identifier-like matches with the word on their left, the label within them and the rest."""

    def take(at: Column, before: Column, x: Column) -> tuple[Column, Column]:
        label = _label(x)
        bare = F.regexp_replace(F.substr(x, F.length(label) + 1), r"\A[^A-Za-z0-9+(]+", "")
        begin = F.length(x) - F.length(bare)
        core = F.regexp_replace(bare, r"[^A-Za-z0-9)]{1,20}\z", "")
        fits = core.rlike("[0-9@]") & (F.length(F.regexp_replace(core, "[^A-Za-z0-9]", "")) >= 6)
        start, end = (at + begin).cast("int"), (at + begin + F.length(core)).cast("int")
        return fits, F.struct(start.alias("start"), end.alias("end"), _left(before).alias("left"), F.lower(label).alias("label"), core.alias("core"))

    return _walk(text, pattern, CAND, take)


def apart(entities: DataFrame) -> DataFrame:
    """The entities (doc_id, h, start, end, seed, ...) that are no seeds and overlap none of their text's, by two running bounds."""
    text = Window.partitionBy("doc_id", "h")
    until = F.max(F.when(F.col("seed"), F.col("end"))).over(text.orderBy("start"))
    onward = F.min(F.when(F.col("seed"), F.col("start"))).over(text.orderBy(F.desc("start")))
    marked = entities.withColumn("_until", F.coalesce(until, F.lit(0))).withColumn("_from", onward)
    return marked.where(~F.col("seed") & (F.col("_until") <= F.col("start")) & (F.col("_from").isNull() | (F.col("_from") >= F.col("end")))).drop("_until", "_from")


def outermost(spans: DataFrame) -> DataFrame:
    """Spans (doc_id, h, start, end) without those that lie within another of their text, of nested or disjoint ones."""
    before = Window.partitionBy("doc_id", "h").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_to", F.coalesce(F.max("end").over(before), F.lit(-1))).where(F.col("end") > F.col("_to")).drop("_to")


def bootstrap(edges: DataFrame) -> DataFrame:
    """(core, score) of the entities that are no seeds and reach the bar. edges: pattern, core, seed."""
    tokens = edges.groupBy("core").agg(F.max("seed").alias("seed"))
    scored = tokens.where("seed").select("core", F.lit(1.0).alias("score"))
    for _ in range(ROUNDS):
        rated = edges.join(scored, "core", "left").groupBy("pattern").agg(
            (F.sum(F.coalesce("score", F.lit(0.0))) / (F.count(F.lit(1)) + 1)).alias("confidence"), F.count("score").alias("support")
        )
        sure = rated.where((F.col("confidence") >= BAR) & (F.col("support") >= SUPPORT)).select("pattern", "confidence")
        new = edges.where("not seed").join(sure, "pattern").groupBy("core").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        scored = _graph.cut(tokens.where("seed").select("core", F.lit(1.0).alias("score")).union(new.join(tokens.where("seed"), "core", "left_anti").select("core", "score")))
    return scored.join(tokens.where("not seed"), "core", "left_semi").where(F.col("score") >= BAR)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, base and all, arrays of (start, kind, end) in order of start and kind."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), "\u0001", "\u0002")
    none = F.array().cast(SEED)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumns({"h": F.xxhash64("text"), "digit": F.col("text").rlike("[0-9]"), "at": F.contains("text", F.lit("@"))})
    rows = rows.select(
        "doc_id",
        "h",
        F.when(F.col("at"), base_spans(F.col("text"), 0, EMAIL)).otherwise(none).alias("k0"),
        F.when(F.col("digit"), base_spans(F.col("text"), 1, IP)).otherwise(none).alias("k1"),
        F.when(F.col("digit"), base_spans(F.col("text"), 2, CARD)).otherwise(none).alias("k2"),
        F.when(F.contains("text", F.lit("+")), base_spans(F.col("text"), 3, PHONE)).otherwise(none).alias("k3"),
        F.when(F.col("digit") | F.col("at"), candidates(F.col("text"), TOKEN)).otherwise(F.array().cast(CAND)).alias("tokens"),
        F.when(F.col("digit"), candidates(F.col("text"), RUN)).otherwise(F.array().cast(CAND)).alias("runs"),
    )
    rows = rows.select("doc_id", "h", F.array_sort(F.concat("k0", "k1", "k2", "k3")).alias("seeds"), F.concat("tokens", "runs").alias("cands"))
    plain = F.transform("seeds", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    base = _graph.cut(rows.select("doc_id", "h", plain.alias("base"), "seeds", "cands"))
    name = ["left", "label", "core"]
    seeds = base.where(F.size("seeds") > 0).select("doc_id", "h", F.explode("seeds").alias("c")).select("doc_id", "h", "c.start", "c.end", *[f"c.{x}" for x in name], F.lit(True).alias("seed"))
    cands = base.where(F.size("cands") > 0).select("doc_id", "h", F.explode("cands").alias("c")).select("doc_id", "h", "c.start", "c.end", *[f"c.{x}" for x in name], F.lit(False).alias("seed"))
    unseen = apart(seeds.union(cands).distinct())
    each = seeds.select(*name, "seed").union(unseen.select(*name, "seed"))
    patterns = F.array_compact(F.array(F.when(F.col("left") != "", F.concat(F.lit("L:"), "left")), F.when(F.col("label") != "", F.concat(F.lit("I:"), "label"))))
    edges = _graph.cut(each.select(F.explode(patterns).alias("pattern"), "core", "seed").groupBy("pattern", "core").agg(F.max("seed").alias("seed")))
    found = outermost(unseen.join(bootstrap(edges), "core", "left_semi").select("doc_id", "h", "start", "end").distinct())
    one = F.struct("start", F.lit(4).alias("kind"), "end")
    more = found.groupBy("doc_id", "h").agg(F.collect_list(one).alias("more")).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "more")
    joined = base.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    return joined.select("doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("all"))


def listing(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """The digest of `find`: counts of the base kinds, their checksum, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[count(k) for k in range(4)], F.sha2(listing("base"), 256).alias("base_sha256"), listing("all").alias("spans"))
