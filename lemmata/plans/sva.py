"""Assertions as operator trees: a Pratt parser, and renderings over the trees.

`parse` turns a property into nodes in post-order numbering with local ids; `nodes` is the DataFrame
form (a row for each node, a status row for what does not parse), and `register` adds the SQL table
function `parse_sva`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.functions.text import leading_names

#: fixed table: binary operators by binding power, loosest first; right-associative ones are named below
LEVELS = (
    ("iff",),
    ("implies",),
    ("|->", "|=>", "#-#", "#=#"),
    ("until", "s_until", "until_with", "s_until_with"),
    ("or",),
    ("and",),
    ("throughout",),
    ("within",),
    ("intersect",),
    ("##",),
    ("?",),
    ("||",),
    ("&&",),
    ("|",),
    ("^", "~^"),
    ("&",),
    ("==", "!=", "===", "!==", "==?", "!=?"),
    ("<", "<=", ">", ">="),
    ("<<", ">>", "<<<", ">>>"),
    ("+", "-"),
    ("*", "/", "%"),
    ("**",),
)
POWER = {op: 10 * (i + 1) for i, level in enumerate(LEVELS) for op in level}
RIGHT = {"implies", "|->", "|=>", "#-#", "#=#", "until", "s_until", "until_with", "s_until_with", "throughout", "iff"}
RANGED = {"always", "s_always", "nexttime", "s_nexttime", "eventually", "s_eventually"}
UNARY = {"!", "~", "-", "+", "&", "|", "^", "~&", "~|", "~^"}
PROPERTY_PREFIX, UNARY_POWER = 25, 250
TOKEN = re.compile(
    r"\s+|(?P<num>\d*'[bodhBODH][0-9a-fA-FxzXZ_?]+|'[01xz]\b|\d+(?:\.\d+)?)|(?P<name>\$?[A-Za-z_][\w$]*)"
    r"|(?P<op>\|->|\|=>|#-#|#=#|##|\[\*|\[->|\[=|\[\+\]|<<<|>>>|===|!==|==\?|!=\?|&&|\|\||==|!=|<=|>=|<<|>>|\*\*|~&|~\||~\^|[-+*/%&|^~!<>?:()\[\]{},.@$;#=])"
)


class ParseError(ValueError):
    pass


@dataclass
class Node:
    kind: str  # operator or signal
    label: str
    children: list[Node] = field(default_factory=list)
    id: int = 0


def tokens(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup:
            out.append(m[0])
        at = m.end()
    return out


class Parser:
    def __init__(self, text: str):
        self.t, self.i = tokens(text), 0

    def peek(self) -> str:
        return self.t[self.i] if self.i < len(self.t) else ""

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if not got or want is not None and got != want:
            raise ParseError(f"expected {want or 'more'}, got {got or 'the end'}")
        self.i += 1
        return got

    def until(self, close: str) -> str:
        """Text up to the matching close bracket, which is taken."""
        depth, parts = 0, []
        while True:
            x = self.take()
            if x == close and not depth:
                return "".join(parts)
            depth += x in ("[", "(", "[*", "[->", "[=") and 1 or -(x in ("]", ")"))
            parts.append(x)

    def delay(self) -> str:
        self.take("##")
        if self.peek() == "[":
            self.take()
            return f"##[{self.until(']')}]"
        if self.peek() == "[*":
            self.take()
            self.take("]")
            return "##[*]"
        if self.peek() == "[+]":
            return "##" + self.take()
        return "##" + self.take()

    def expression(self, power: int = 0) -> Node:
        left = self.prefix()
        while True:
            left = self.postfix(left)
            op = self.peek()
            bound = POWER.get(op, 0)
            if bound <= power:
                return left
            if op == "##":
                label = self.delay()
                left = Node("operator", label, [left, self.expression(bound)])
            elif op == "?":
                self.take()
                yes = self.expression()
                self.take(":")
                left = Node("operator", "?:", [left, yes, self.expression(bound - 1)])
            else:
                self.take()
                left = Node("operator", op, [left, self.expression(bound - 1 if op in RIGHT else bound)])

    def prefix(self) -> Node:
        x = self.peek()
        if x == "##":
            return Node("operator", self.delay(), [self.expression(POWER["##"])])
        x = self.take()
        if x == "(":
            inner = self.expression()
            while self.peek() == ",":  # sequence match items
                self.take()
                self.expression()
            self.take(")")
            return inner
        if x == "{":
            return Node("operator", "{}", self.arguments("}"))
        if x == "not":
            return Node("operator", "not", [self.expression(PROPERTY_PREFIX)])
        if x in RANGED:
            label = x
            if self.peek() == "[":
                self.take()
                label += f"[{self.until(']')}]"
            return Node("operator", label, [self.expression(PROPERTY_PREFIX)])
        if x in UNARY:
            return Node("operator", x, [self.expression(UNARY_POWER)])
        if x == "@":
            self.take("(")
            self.until(")")
            return self.expression()
        if x == "if":
            self.take("(")
            test = self.expression()
            self.take(")")
            parts = [test, self.expression(PROPERTY_PREFIX)]
            if self.peek() == "else":
                self.take()
                parts.append(self.expression(PROPERTY_PREFIX))
            return Node("operator", "if", parts)
        if re.match(r"[$A-Za-z_]", x):
            while self.peek() == ".":
                self.take()
                x += "." + self.take()
            if self.peek() == "(":
                self.take()
                return Node("operator", x, self.arguments(")"))
            return Node("signal", x)
        if re.match(r"[\d']", x):
            return Node("signal", x)
        raise ParseError(f"unexpected {x}")

    def arguments(self, close: str) -> list[Node]:
        """Arguments of a call; omitted ones and clocking events are left out."""
        out: list[Node] = []
        while self.peek() != close:
            if self.peek() == ",":
                self.take()
            elif self.peek() == "@":
                self.take()
                self.take("(")
                self.until(")")
            else:
                out.append(self.expression())
        self.take(close)
        return out

    def postfix(self, left: Node) -> Node:
        while self.peek() in ("[*", "[->", "[=", "[+]", "["):
            x = self.take()
            if x == "[+]":
                left = Node("operator", "[+]", [left])
            elif x == "[":
                if left.kind != "signal":
                    raise ParseError("index on an expression")
                left = Node("signal", f"{left.label}[{self.until(']')}]")
            else:
                left = Node("operator", f"{x}{self.until(']')}]", [left])
        return left


def split_assertion(text: str) -> tuple[str | None, str | None, str]:
    """Clock, disable condition and property of `assert property (...);` or of a bare property."""
    body = text.strip().rstrip(";").strip()
    m = re.match(r"(?:\w+\s*:\s*)?(?:assert|assume|cover)\s+property\s*\(", body)
    if m:
        if not body.endswith(")"):
            raise ParseError("unclosed assertion")
        body = body[m.end() : -1].strip()
    clock = disable = None
    if m := re.match(r"@\s*\(([^()]*)\)\s*", body):
        clock, body = m[1].strip(), body[m.end() :]
    if m := re.match(r"disable\s+iff\s*\(", body):
        depth, at = 1, m.end()
        while depth and at < len(body):
            depth += {"(": 1, ")": -1}.get(body[at], 0)
            at += 1
        disable, body = body[m.end() : at - 1].strip(), body[at:].strip()
    return clock, disable, body


def parse(text: str) -> Node:
    """The operator tree of an assertion or a property; ids are given in post-order from 1."""
    parser = Parser(split_assertion(text)[2])
    root = parser.expression()
    if parser.peek():
        raise ParseError(f"left over: {parser.peek()}")
    count = 0
    stack = [(root, False)]
    while stack:
        node, ready = stack.pop()
        if ready:
            count += 1
            node.id = count
        else:
            stack.append((node, True))
            stack += [(c, False) for c in reversed(node.children)]
    return root


def walk(root: Node) -> Iterator[tuple[Node, Node | None, int]]:
    """Nodes with parent and place among its children, in pre-order."""
    stack: list[tuple[Node, Node | None, int]] = [(root, None, 0)]
    while stack:
        node, parent, place = stack.pop()
        yield node, parent, place
        stack += [(c, node, i) for i, c in reversed(list(enumerate(node.children)))]


def code(node: Node, names: dict[int, str] | None = None, top: bool = True) -> str:
    """Source text of a node; with names, of its children as they are named."""
    parts = [names[c.id] if names else code(c, None, False) for c in node.children]
    if node.kind == "signal":
        return node.label
    x = node.label
    if x == "{}":
        return "{" + ", ".join(parts) + "}"
    if x == "?:" and len(parts) == 3:
        text = f"{parts[0]} ? {parts[1]} : {parts[2]}"
    elif x == "if":
        return f"if ({parts[0]}) {parts[1]}" + (f" else {parts[2]}" if len(parts) > 2 else "")
    elif x.startswith("[") and len(parts) == 1:
        return f"{parts[0]}{x}"
    elif (x.startswith("##") or x in POWER) and len(parts) == 2:
        text = f"{parts[0]} {x} {parts[1]}"
    elif x.startswith("##") or x == "not" or x.split("[")[0] in RANGED:
        text = f"{x} {parts[0]}"
    elif x in UNARY and len(parts) == 1:
        return f"{x}{parts[0]}"
    else:
        return f"{x}({', '.join(parts)})"
    return text if top else f"({text})"


def merge_steps(root: Node) -> list[tuple[str, str]]:
    """Symbolic merge: (T1.., expression over symbols), numbered in reverse pre-order; two operands as infix, else as a call."""
    order = [n for n, _, _ in walk(root)][::-1]
    name = {n.id: f"T{i}" for i, n in enumerate(order, 1)}
    out = []
    for n in order:
        kids = [name[c.id] for c in n.children]
        out.append((name[n.id], n.label if not kids else f"{kids[0]} {n.label} {kids[1]}" if len(kids) == 2 else f"{n.label}({', '.join(kids)})"))
    return out


#: fixed phrases of the templated operators; {a}, {b} are operands, {m}, {n} parameters
PHRASES = {
    ("|->", 2): "whenever {a}, {b} in the same cycle", ("|=>", 2): "whenever {a}, {b} in the next cycle",
    ("#-#", 2): "{a} is followed at once by {b}", ("#=#", 2): "{a} is followed in the next cycle by {b}",
    ("implies", 2): "{a} implies {b}", ("iff", 2): "{a} exactly when {b}", ("and", 2): "both {a} and {b}", ("or", 2): "{a} or {b}",
    ("&&", 2): "{a} and {b}", ("||", 2): "{a} or {b}", ("==", 2): "{a} equals {b}", ("!=", 2): "{a} differs from {b}",
    ("===", 2): "{a} is identical to {b}", ("!==", 2): "{a} is not identical to {b}", ("!", 1): "{a} is false", ("not", 1): "it is not the case that {a}",
    ("until", 2): "{a} until {b}", ("s_until", 2): "{a} until {b}, which must come", ("until_with", 2): "{a} up to and with {b}", ("s_until_with", 2): "{a} up to and with {b}, which must come",
    ("always", 1): "always {a}", ("s_eventually", 1): "eventually {a}", ("nexttime", 1): "{a} in the next cycle", ("s_nexttime", 1): "{a} in a next cycle that must come",
    ("throughout", 2): "{a} throughout {b}", ("within", 2): "{a} within {b}", ("intersect", 2): "{a} over the same span as {b}",
    ("$rose", 1): "{a} rises", ("$fell", 1): "{a} falls", ("$stable", 1): "{a} keeps its value", ("$changed", 1): "{a} changes", ("$sampled", 1): "the sampled {a}",
    ("$past", 1): "the previous {a}", ("$past", 2): "{a} of {b} cycles before", ("first_match", 1): "the first match of {a}", ("strong", 1): "strongly {a}", ("weak", 1): "weakly {a}",
    ("##m", 2): "{a}, then {m} cycles later {b}", ("##m", 1): "{m} cycles later {a}", ("##[m:n]", 2): "{a}, then {m} to {n} cycles later {b}", ("##[m:n]", 1): "{m} to {n} cycles later {a}",
    ("[*m]", 1): "{a} for {m} cycles", ("[*m:n]", 1): "{a} for {m} to {n} cycles", ("[->m]", 1): "{a} for the {m}th time", ("[=m]", 1): "{a} {m} times",
    ("[->m:n]", 1): "{a} for the {m}th to {n}th time", ("[=m:n]", 1): "{a} {m} to {n} times", ("[*]", 1): "{a} for any number of cycles", ("[+]", 1): "{a} for one cycle or more",
    ("always[m:n]", 1): "{a} from {m} to {n} cycles on", ("s_always[m:n]", 1): "{a} from {m} to {n} cycles on, all of which must come",
    ("eventually[m:n]", 1): "{a} within {m} to {n} cycles", ("s_eventually[m:n]", 1): "{a} within {m} to {n} cycles that must come", ("nexttime[m]", 1): "{a} {m} cycles on", ("s_nexttime[m]", 1): "{a} {m} cycles on, which must come",
}


def operator_key(label: str) -> tuple[str, str, str]:
    """The template's label and its parameters: `##[4:9]` is `##[m:n]` with 4 and 9."""
    if m := re.fullmatch(r"\[(\*|->|=)([^:\]]+):([^\]]+)\]", label):
        return f"[{m[1]}m:n]", m[2], m[3]
    if m := re.fullmatch(r"\[(\*|->|=)([^:\]]+)\]", label):
        return f"[{m[1]}m]", m[2], ""
    if m := re.fullmatch(r"(##|[a-z_]*)\[([^:\]]+):([^\]]+)\]", label):
        return f"{m[1]}[m:n]", m[2], m[3]
    if m := re.fullmatch(r"([a-z_]+)\[([^\]]+)\]", label):
        return f"{m[1]}[m]", m[2], ""
    if m := re.fullmatch(r"##(\d+|\w+)", label):
        return "##m", m[1], ""
    return label, "", ""


def meanings(root: Node, complete=None) -> dict[int, str]:
    """Bottom-up meaning of each node: its template, else what `complete(label, operands)` says, else a call in words."""
    said: dict[int, str] = {}
    for node in reversed([n for n, _, _ in walk(root)]):
        if node.kind == "signal":
            said[node.id] = node.label
            continue
        key, m, n = operator_key(node.label)
        kids = [said[c.id] for c in node.children]
        phrase = PHRASES.get((key, len(kids)))
        if phrase:
            said[node.id] = phrase.format(a=kids[0], b=kids[1] if len(kids) > 1 else "", m=m, n=n)
        else:
            said[node.id] = (complete(node.label, kids) if complete else None) or f"{node.label} of {', '.join(kids)}"
    return said


def explain(root: Node, complete=None) -> str:
    """Bottom-up explanation of the whole tree."""
    return meanings(root, complete)[root.id]


def numbered(root: Node) -> str:
    """The nodes as a list in pre-order, operators with their source and the numbers of their operands."""
    order = {n.id: k for k, (n, _, _) in enumerate(walk(root), 1)}
    rows = [
        f"{k}. {n.label}" if n.kind == "signal" else f"{k}. {n.label} <- {', '.join(str(order[c.id]) for c in n.children)}: {code(n)}"
        for k, (n, _, _) in enumerate(walk(root), 1)
    ]
    return "\n".join(rows)


def derivation(root: Node, complete=None) -> str:
    """Each step of the symbolic merge with its source and meaning, then the meaning of the whole."""
    said = meanings(root, complete)
    order = [n for n, _, _ in walk(root)][::-1]
    rows = [f"{name} = {expression} | {code(n)} | {said[n.id]}" for n, (name, expression) in zip(order, merge_steps(root), strict=True)]
    return "\n".join([*rows, f"Meaning: {said[root.id]}"])


def outline(root: Node) -> str:
    """Branch drawing of the tree, a line for each node in pre-order."""
    lines: list[str] = []
    stack = [(root, "", True, True)]
    while stack:
        node, pad, last, top = stack.pop()
        lines.append(node.label if top else f"{pad}{'└─ ' if last else '├─ '}{node.label}")
        inner = "" if top else pad + ("   " if last else "│  ")
        kids = [(c, inner, i == len(node.children) - 1, False) for i, c in enumerate(node.children)]
        stack += reversed(kids)
    return "\n".join(lines)


def dot(root: Node) -> str:
    esc = lambda s: s.replace("\\", "\\\\").replace('"', '\\"')
    rows = [f'  n{n.id} [label="{esc(n.label)}", shape={"box" if n.kind == "operator" else "ellipse"}];' for n, _, _ in walk(root)]
    rows += [f"  n{p.id} -> n{n.id};" for n, p, _ in walk(root) if p]
    return "\n".join(["digraph sva {", *rows, "}"])


NODE_SCHEMA = "key long, status string, node_id int, parent_id int, child_pos int, preorder int, type string, label string, code string"
TREE_SCHEMA = "key long, status string, n_nodes int, clock string, disable string, explanation string, outline string, merge string, dot string, numbered string, derivation string"


NODE = {
    "node_id": lambda n, p, i, k: n.id,
    "parent_id": lambda n, p, i, k: p.id if p else None,
    "child_pos": lambda n, p, i, k: i,
    "preorder": lambda n, p, i, k: k,
    "type": lambda n, p, i, k: n.kind,
    "label": lambda n, p, i, k: n.label,
    "code": lambda n, p, i, k: code(n),
}
TREE = {
    "n_nodes": lambda root: sum(1 for _ in walk(root)),
    "explanation": lambda root: explain(root),
    "outline": lambda root: outline(root),
    "merge": lambda root: "; ".join(f"{a} = {b}" for a, b in merge_steps(root)),
    "dot": lambda root: dot(root),
    "numbered": lambda root: numbered(root),
    "derivation": lambda root: derivation(root),
}


def _parsed(text: str):
    """Clock, disable condition and root, or what went wrong."""
    try:
        clock, disable, _ = split_assertion(text or "")
        return (clock, disable, parse(text or "")), "ok"
    except (ParseError, RecursionError) as e:
        return None, f"error: {e}"


def _node_rows(text, columns) -> list[dict]:
    got, status = _parsed(text)
    if not got:
        return [{"status": status}]
    made = {c: NODE[c] for c in columns if c in NODE}
    return [{"status": status} | {c: f(n, p, i, k) for c, f in made.items()} for k, (n, p, i) in enumerate(walk(got[2]), 1)]


def _tree_row(text, columns) -> list[dict]:
    got, status = _parsed(text)
    if not got:
        return [{"status": status}]
    return [{"status": status, "clock": got[0], "disable": got[1]} | {c: TREE[c](got[2]) for c in columns if c in TREE}]


def _mapped(df: DataFrame, key: str, text: str, make, schema: str, columns) -> DataFrame:
    """Each distinct text is parsed once, for the asked columns only, and joined back to its keys."""
    kinds = dict(x.split() for x in schema.split(", "))
    names = ["status", *(columns or [c for c in kinds if c not in ("key", "status")])]
    types = [{"int": pa.int32(), "string": pa.string()}[kinds[n]] for n in names]

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 500):
                rows = [(t, r) for t in b.column(0).slice(a, 500).to_pylist() for r in make(t, names)]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), *(pa.array([r.get(n) for _, r in rows], t) for n, t in zip(names, types, strict=True))], ["_text", *names])

    keyed = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    parsed = keyed.select("_text").distinct().mapInArrow(run, ", ".join(["_text string", *(f"{n} {kinds[n]}" for n in names)]))
    return keyed.join(parsed, "_text").select("key", *names)


def nodes(df: DataFrame, key: str, text: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each node of each assertion's tree; what does not parse gives one row with its status."""
    return _mapped(df, key, text, _node_rows, NODE_SCHEMA, columns)


def trees(df: DataFrame, key: str, text: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each assertion with its tree's renderings."""
    return _mapped(df, key, text, _tree_row, TREE_SCHEMA, columns)


def first_node(found: DataFrame, label: str) -> DataFrame:
    """Of each tree (key, preorder, label, code) the first node in pre-order whose label begins so."""
    best = F.min_by("code", "preorder")
    return found.where(F.startswith("label", F.lit(label))).groupBy("key").agg(best.alias("code"), F.min("preorder").alias("preorder"))


def signals(found: DataFrame) -> DataFrame:
    """Of each tree (key, preorder, type, label) the leading identifiers of its signals in pre-order."""
    leaves = F.array_sort(F.collect_list(F.when(F.col("type") == "signal", F.struct("preorder", "label"))))
    return found.groupBy("key").agg(leading_names(F.transform(leaves, lambda v: v["label"])).alias("signals"))


def without_macros(text: Column) -> Column:
    """Macro uses as plain identifiers, so that the text parses; `with_macros` turns them back."""
    return F.regexp_replace(text, r"`([A-Za-z_]\w*)", "macro__$1")


def with_macros(text: Column) -> Column:
    return F.regexp_replace(text, r"\bmacro__([A-Za-z_]\w*)", "`$1")


def register(spark: SparkSession, name: str = "parse_sva") -> None:
    """The SQL table function `parse_sva(key, text)`, for lateral joins."""
    from pyspark.sql.functions import udtf

    class ParseSva:
        def eval(self, key: int, text: str):
            for r in _node_rows(text, NODE):
                yield tuple({"key": key, **r}.get(x.split()[0]) for x in NODE_SCHEMA.split(", "))

    spark.udtf.register(name, udtf(ParseSva, returnType=NODE_SCHEMA))
