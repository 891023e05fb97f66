"""Column functions on completions, assertions, module texts and logs. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "```"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nullif_empty(x: Column) -> Column:
    return F.when(x == "", F.lit(None)).otherwise(x)


def final_answer(x, phrase: str = "assert property") -> Column:
    """The first fence after the first closing think tag, if it holds the phrase; else null."""
    text = _c(x)
    cut = F.instr(text, "</think>")
    after = F.when(cut > 0, F.substr(text, cut + F.lit(8)))
    body = F.regexp_replace(F.regexp_extract(after, r"(?s)```[A-Za-z]*\n(.*?)```", 1), r"^\s+|\s+$", "")
    return F.when(F.contains(body, F.lit(phrase)), body)


def last_fence(x, lang: str = "systemverilog") -> Column:
    """What the last fence of the language holds; null without one."""
    mark = FENCE + lang
    tail = F.substring_index(F.substring_index(_c(x), mark, -1), FENCE, 1)
    return F.when(F.contains(_c(x), F.lit(mark)), F.trim(F.regexp_replace(tail, r"^\s+|\s+$", "")))


def first_fence(x) -> Column:
    return nullif_empty(F.trim(F.regexp_replace(F.regexp_extract(_c(x), r"(?s)```[A-Za-z]*\n(.*?)```", 1), r"^\s+|\s+$", "")))


def literal_count(x, literal: str) -> Column:
    return ((F.length(_c(x)) - F.length(F.replace(_c(x), F.lit(literal), F.lit("")))) / len(literal)).cast("int")


def assertion_count(x) -> Column:
    return F.regexp_count(_c(x), F.lit(r"assert\s+property"))


def normalize(x) -> Column:
    """Without label, white space collapsed, trailing semicolons gone."""
    flat = F.regexp_replace(F.regexp_replace(_c(x), r"^\s*[A-Za-z_]\w*\s*:\s*", ""), r"\s+", " ")
    return F.trim(F.regexp_replace(F.trim(flat), r";+$", ""))


def strip(x) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def flat_line(x) -> Column:
    return F.replace(strip(x), F.lit("\n"), F.lit(""))


#: fixed values: what `property_body` takes away, in this order
WRAPPERS = (r"^\w+\s*:\s*(assert)", r"^assert\s+property\s*\(", r"^assert\s*\(", r"@\s*\(\s*(?:posedge|negedge)\s+\w+\s*\)", r"disable\s+iff\s*\([^)]*\)")


def property_body(x) -> Column:
    """The property itself: newlines, label, wrapper, clock and disable clause removed, cut at `);`."""
    y = F.regexp_replace(flat_line(x), WRAPPERS[0], "$1")
    for pattern in WRAPPERS[1:]:
        y = F.regexp_replace(y, pattern, "")
    return strip(F.get(F.split(y, r"\)\s*;"), F.lit(0)))


def guarded_body(x, reset: str = "tb_reset") -> Column:
    """The property of a wrapped assertion, cut after its last reset clause and at `);`; other text as it is."""
    y = flat_line(x)
    wrapped = y.rlike(r"^(\w+\s*:\s*)?assert\s*(property\s*)?\(")
    after = strip(F.substring_index(y, f"{reset})", -1))
    return F.when(wrapped, strip(F.get(F.split(after, r"\)\s*;"), F.lit(0)))).otherwise(y)


def assertion_of(x, missing: str | None = None) -> Column:
    """The first whole assertion on one line, or what stands for none; quotes and tabs escaped if that is given."""
    y = nullif_empty(F.replace(F.regexp_extract(_c(x), r"(?s)assert\s+property\s*\(.*?\)\s*;", 0), F.lit("\n"), F.lit(" ")))
    if missing is None:
        return y
    return F.replace(F.replace(F.coalesce(y, F.lit(missing)), F.lit('"'), F.lit('\\"')), F.lit("\t"), F.lit("\\t"))


def after_label(x, label: str = "OL NL:") -> Column:
    """The first line after a label; null without one."""
    rest = F.substr(_c(x), F.instr(_c(x), label) + len(label))
    return F.when(F.contains(_c(x), F.lit(label)), strip(F.get(F.split(strip(rest), "\n"), F.lit(0))))


def user_content(x, intro: str, outro: str) -> Column:
    """Struct (testbench, question) of a user turn: the question goes from its label to the closing instructions."""
    y = _c(x)
    at = F.instr(y, "Question:")
    rest = strip(F.substr(y, at))
    return F.struct(
        strip(F.replace(F.left(y, at - 1), F.lit(intro), F.lit(""))).alias("testbench"), strip(F.substring_index(rest, outro, 1)).alias("question")
    )


def leading_names(labels) -> Column:
    """Leading identifiers of signal labels, in order, once each; literals have none."""
    return F.array_distinct(F.filter(F.transform(_c(labels), lambda v: F.regexp_extract(v, r"^[A-Za-z_]\w*", 0)), lambda v: v != ""))


def parameters(bench) -> Column:
    """Names that a test bench declares as parameters: the word after the keyword and an optional type or range."""
    kind = r"(?:(?:int|real|bit)\b|\[[^\]]*\])?"
    return F.regexp_extract_all(_c(bench), F.lit(rf"\b(?:parameter|localparam)\b\s*{kind}\s*(\w+)"), F.lit(1))


def quoted_and_parameters(prompt, bench) -> Column:
    """Names in single quotes of a prompt, then the parameters of a test bench."""
    return F.concat(F.regexp_extract_all(_c(prompt), F.lit(r"'([^'\s]+)'"), F.lit(1)), parameters(bench))


def with_parameters(names, bench) -> Column:
    """Signal names with the test bench's parameters that are not among them."""
    return F.array_union(_c(names), parameters(bench))


#: openings of an explanation after the quoted expression, the longer before those it begins with
OPENINGS = (
    "evaluates to true if and only if", "evaluates to true when", "evaluates to true if", "evaluate to true if and only if", "evaluate to true when", "evaluate to true if",
    "is true when", "is true if", "means that", "means",
)


def plain_operand(x) -> Column:
    """An operand's explanation without its stock opening and its last period."""
    openings = "|".join(o.replace(" ", r"\s+") for o in OPENINGS)
    subject = r'(?:the\s+expression\s+)?"[^"]*"'
    return F.regexp_replace(F.regexp_replace(strip(x), rf"(?i)\A{subject}\s+(?:{openings})\s+", ""), r"\.\z", "")


def json_part(x) -> Column:
    """From the first opening to the last closing brace; null without both."""
    return nullif_empty(F.regexp_extract(_c(x), r"(?s)\{.*\}", 0))


def scenario(conditions) -> Column:
    """Conditions of consecutive cycles as one sequence."""
    return F.array_join(F.transform(_c(conditions), lambda v: F.concat(F.lit("("), v, F.lit(")"))), " ##1 ")


def declarations(names, clock: str = "clk") -> Column:
    """A declaration for each name, once, the clock among them."""
    return F.array_join(F.transform(F.array_distinct(F.array_append(_c(names), F.lit(clock))), lambda v: F.concat(F.lit("logic "), v, F.lit(";"))), "\n")


def fenced_blocks(x) -> Column:
    """What each fence of any language holds, without white space at the ends; empty ones left out."""
    held = F.regexp_extract_all(_c(x), F.lit(r"(?s)```[A-Za-z]*\n(.*?)```"), F.lit(1))
    return F.filter(F.transform(held, lambda v: strip(v)), lambda v: v != "")


def book_and_page(path) -> Column:
    """Struct (book, page) of paths `.../book/page_12.ext`."""
    y = F.regexp_extract(_c(path), r"([^/]+)/[^/]*?(\d+)\.\w+$", 1)
    return F.struct(nullif_empty(y).alias("book"), F.regexp_extract(_c(path), r"([^/]+)/[^/]*?(\d+)\.\w+$", 2).try_cast("int").alias("page"))


def bytes_text(x) -> Column:
    """A size with its unit, one decimal."""
    y = _c(x).cast("double")
    out = F.format_string("%.1f GB", y / 1e9)
    for unit, size in (("MB", 1e6), ("KB", 1e3), ("B", 1.0)):
        out = F.when(y < size * 1000, F.format_string(f"%.1f {unit}", y / size)).otherwise(out)
    return out


def numbered_items(x) -> Column:
    """Texts of the lines `1. text`; other lines are dropped."""
    lines = F.filter(F.split(_c(x), "\n"), lambda v: v.rlike(r"^\d+\.\s+.*"))
    return F.transform(lines, lambda v: F.regexp_replace(v, r"^\d+\.\s+", ""))


def labeled_fields(x) -> Column:
    """Map of `(a) text` fields; the last of equal labels wins."""
    keys = F.regexp_extract_all(_c(x), F.lit(r"\(([a-z])\)\s*([^(]*)"), F.lit(1))
    values = F.transform(F.regexp_extract_all(_c(x), F.lit(r"\(([a-z])\)\s*([^(]*)"), F.lit(2)), lambda v: F.trim(v))
    entries = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e, i: F.array_position(F.slice(keys, i + 2, F.greatest(F.lit(1), F.size(keys))), e["k"]) == 0)
    return F.map_from_entries(entries)


def last_module(x) -> Column:
    return F.try_element_at(F.regexp_extract_all(_c(x), F.lit(r"(?s)(\bmodule\b.*?\bendmodule\b)"), F.lit(1)), F.lit(-1))


def module_name(x) -> Column:
    return nullif_empty(F.regexp_extract(_c(x), r"\bmodule\s+(\w+)", 1))


def before_last(x, word: str, added: str) -> Column:
    """`added` put before the last occurrence of `word`; unchanged without one."""
    text = _c(x)
    tail = F.substring_index(text, word, -1)
    head = F.substr(text, F.lit(1), F.length(text) - F.length(tail) - len(word))
    return F.when(F.contains(text, F.lit(word)), F.concat(head, F.lit(added + word), tail)).otherwise(text)


def before_first(x, word: str, added: str) -> Column:
    text = _c(x)
    head = F.substring_index(text, word, 1)
    return F.when(F.contains(text, F.lit(word)), F.concat(head, F.lit(added), F.substr(text, F.length(head) + F.lit(1)))).otherwise(text)


def drop_last_line(x, line: str) -> Column:
    """Without its last line that equals `line` (trimmed)."""
    lines = F.split(_c(x), "\n")
    at = F.array_position(F.reverse(F.transform(lines, lambda v: F.trim(v))), F.lit(line))
    gone = F.size(lines) - at
    return F.when(at > 0, F.array_join(F.filter(lines, lambda v, i: i != gone), "\n")).otherwise(_c(x))


def signal_names(x) -> Column:
    """Identifiers of an expression in order of first use, without system functions and literals."""
    return F.array_distinct(F.filter(F.regexp_extract_all(_c(x), F.lit(r"([$\w']+)"), F.lit(1)), lambda v: v.rlike(r"^[A-Za-z_]\w*$")))


def signal_list(x) -> Column:
    """A list given as `['a', 'b']`, `a, b` or empty, as an array."""
    bare = F.translate(F.trim(_c(x)), "[]'\"", "")
    return F.filter(F.transform(F.split(bare, ","), lambda v: F.trim(v)), lambda v: v != "")


def idiom(x) -> Column:
    """negated_conj, implication or other."""
    y = _c(x)
    return F.when(y.rlike(r"!==\s*1'b1"), "negated_conj").when(y.rlike(r"\|->|\|=>"), "implication").otherwise("other")


def failure_reason(completion, truncated) -> Column:
    return F.when(_c(truncated), "truncated").when(~F.contains(_c(completion), F.lit(FENCE)), "no_fence").otherwise("other")


def think_turn(x, lang: str = "systemverilog") -> Column:
    """Struct (ok, reason, text): what stands before the last fence of the language, wrapped in think tags, then the fence."""
    text, mark = _c(x), FENCE + lang
    tail = F.substring_index(text, mark, -1)
    reasoning = strip(F.left(text, F.length(text) - F.length(tail) - len(mark)))
    code = strip(F.concat(F.lit(mark), tail))
    bad = F.when(~F.contains(text, F.lit(mark)), "no_fence").when(reasoning == "", "empty_reasoning").when(~F.endswith(code, F.lit(FENCE)), "unclosed")
    made = F.concat(F.lit("<think>\n"), reasoning, F.lit("\n</think>\n\n"), code)
    return F.struct(bad.isNull().alias("ok"), bad.alias("reason"), F.when(bad.isNull(), made).alias("text"))


def cleanup(x) -> Column:
    """Page text: form feeds to paragraph breaks, words joined over hyphens, single newlines to spaces."""
    y = F.replace(_c(x), F.lit("\f"), F.lit("\n\n"))
    y = F.regexp_replace(y, r"(\w)-\s*\n\s*(\w)", "$1$2")
    y = F.regexp_replace(y, r"\n{3,}", "\n\n")
    return F.regexp_replace(y, r"(?<!\n)\n(?!\n)", " ")


def html_escape(x) -> Column:
    y = F.replace(_c(x), F.lit("&"), F.lit("&amp;"))
    y = F.replace(F.replace(y, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(y, F.lit('"'), F.lit("&quot;"))


def indent(x, pad: str) -> Column:
    return F.regexp_replace(_c(x), r"(?m)^", pad)


def tail(x, n: int) -> Column:
    return F.right(_c(x), F.lit(n))


def tail_lines(x, n: int) -> Column:
    lines = F.split(_c(x), "\n")
    return F.when(F.size(lines) > n, F.slice(lines, -n, n)).otherwise(lines)


def percent(x, places: int = 1) -> Column:
    return F.format_string(f"%.{places}f%%", _c(x) * 100)


def render(template, **operands) -> Column:
    """A template with `{name}` places filled."""
    y = _c(template)
    for name, value in operands.items():
        y = F.replace(y, F.lit("{" + name + "}"), _c(value))
    return y


#: fixed values: patterns that mark hardware code
CODE_PATTERNS = (
    r"\b(module|endmodule|package|endpackage|interface|endinterface)\b",
    r"(always|always_comb|always_ff|always_latch)\s*@?",
    r"initial\s+begin",
    r"\b(input|output|inout)\s+(\[\d+:\d+\])?\s*(wire|reg|logic)?\b",
    r"\b(reg|wire|logic|bit|byte|shortint|int|longint|integer|time|real|shortreal|string)\b",
    r"(assign|parameter|localparam)\s+\w+",
    r"\b(struct|union|enum|typedef|class|endclass)\b",
    r"\b(program|endprogram|sequence|endsequence|property|endproperty)\b",
    r"\b(assert|assume|cover|restrict)\b",
    r"(<=|===|!==|\|\||&&)",
    r"\b(generate|endgenerate|for|if|else|case)\b",
    r"(begin|end)\b",
    r"@\s*\(",
    r"\|=>\s*##",
    r"\$past\s*\(",
    r"\$(display|write|monitor|time|finish|stop)\b",
)
#: fixed values: patterns of assertions, two of which are code by themselves
ASSERTION_PATTERNS = (r"assert\s+property\s*\(", r"\$stable\s*\(", r"\|->\s*", r"@\s*\(\s*posedge\s+\w+\s*\)", r"\$error\s*\(")
#: fixed values: patterns of prose
PROSE_PATTERNS = (r"\b(the|and|or|in|to|that|for|is|are|on|with|as|this|these|those)\b", r"[.!?]\s+[A-Z]", r"\b[A-Z][a-z]+\b\s+\b[A-Z][a-z]+\b")


def pattern_hits(x, patterns=CODE_PATTERNS) -> Column:
    hits = F.lit(0)
    for p in patterns:
        hits = hits + _c(x).rlike(p).cast("int")
    return hits


def is_prose(x) -> Column:
    return pattern_hits(x, PROSE_PATTERNS) > 0


def is_code(x) -> Column:
    """Two patterns of assertions, or a pattern of code in a text that is no prose, or two of them in any."""
    n = pattern_hits(x)
    return (pattern_hits(x, ASSERTION_PATTERNS) >= 2) | (n >= 2) | ((n >= 1) & ~is_prose(x))


REPORT_ROW = r"^\[(\d+)\]\s+(\S+)\._assert_(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+([0-9.]+) s$"


def report_row(x) -> Column:
    """Fields of a proof report's row; null for other lines, precondition rows among them."""
    y = F.trim(_c(x))
    part = lambda k: F.regexp_extract(y, REPORT_ROW, k)
    row = F.struct(part(2).alias("module"), part(3).cast("int").alias("number"), part(4).alias("result"), part(5).alias("engine"), part(6).alias("bound"), part(7).cast("double").alias("seconds"))
    return F.when(y.rlike(REPORT_ROW), row)


# ---------------------------------------------------------------- logs and verdicts


def statuses(log, tag: str = "STATUS") -> Column:
    """Map of name to status from a log's lines `TAG name status`; the last of a name counts."""
    rows = F.filter(F.transform(F.split(_c(log), "\n"), lambda v: strip(v)), lambda v: v.rlike(rf"^{tag} \S+ \S+$"))
    parts = F.transform(rows, lambda v: F.split(v, " "))
    names = F.transform(parts, lambda v: v[1])
    last = F.filter(parts, lambda v, i: F.array_position(F.slice(names, i + 2, F.greatest(F.lit(1), F.size(names))), v[1]) == 0)
    return F.map_from_entries(F.transform(last, lambda v: F.struct(v[1], v[2])))


def verdict(found, both: str = "iff", onward: str = "fwd", back: str = "bwd", good: str = "proven") -> Column:
    """Struct (syntax, functionality, func_relaxed) of a status map; all 0 unless every name is there."""
    m = _c(found)
    whole = F.size(F.array_except(F.array(*[F.lit(x) for x in (both, onward, back)]), F.map_keys(m))) == 0
    holds = lambda name: F.coalesce(F.element_at(m, F.lit(name)) == good, F.lit(False))
    strict, loose = whole & holds(both), whole & (holds(both) | holds(onward) | holds(back))
    return F.struct(whole.cast("int").alias("syntax"), strict.cast("int").alias("functionality"), loose.cast("int").alias("func_relaxed"))


def error_summary(log, most: int = 8, else_chars: int = 500) -> Column:
    """The first error lines of a log, else its end."""
    lines = F.filter(F.split(_c(log), "\n"), lambda v: v.rlike(r"^\[?ERROR\b"))
    return F.when(F.size(lines) > 0, F.array_join(F.slice(lines, 1, most), "\n")).otherwise(F.right(_c(log), F.lit(else_chars)))


def equivalent(log) -> Column:
    """Whether a log reports full equivalence and no syntax error."""
    return ~F.contains(_c(log), F.lit("syntax error")) & F.contains(_c(log), F.lit("Full equivalence"))


def truncated(completion, n_tokens, cap: int, close: str = "</think>", finish=None) -> Column:
    """Whether a completion ran into its cap: its finish reason says so (where one is given), else as many tokens, and its reasoning never closed."""
    ran = (_c(n_tokens) >= cap) & ~F.contains(F.coalesce(_c(completion), F.lit("")), F.lit(close))
    return ran if finish is None else F.coalesce(_c(finish) == "length", ran)


def explanations_of(dictionary) -> Column:
    """Map from each entry of a JSON dictionary of assertions to its explanation; entries without one are left out."""
    held = F.from_json(_c(dictionary), "map<string, struct<`Assertion Explaination`: string>>")
    said = F.transform_values(held, lambda k, v: v["Assertion Explaination"])
    return F.map_filter(said, lambda k, v: v.isNotNull())


#: fixed values: operators of plain expressions; every other one counts as temporal
PLAIN_OPERATORS = (
    "==", "!=", "===", "!==", "==?", "!=?", "<", ">", "<=", ">=", "&&", "||", "!", "+", "-", "*", "/", "%", "**",
    "&", "|", "^", "~", "^~", "~^", "~&", "~|", "<<", ">>", "<<<", ">>>", "=", "+=", "-=",
)


def operator_class(label) -> Column:
    return F.when(_c(label).isin(*PLAIN_OPERATORS), "non_temporal").otherwise("temporal")


def question(problem, signals, bench) -> Column:
    """A question with the parts that its row asks for: signals unless it names them, the reset where the bench has one."""
    listed = F.array_join(F.transform(_c(signals), lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", ")
    named = F.contains(_c(problem), F.lit("Use the signals")) | (F.size(_c(signals)) == 0)
    reset = F.when(F.contains(_c(bench), F.lit("tb_reset")), F.lit("The reset is tb_reset.\n")).otherwise("")
    return F.concat(F.lit("Question: "), strip(problem), F.when(named, "").otherwise(F.concat(F.lit(" Use the signals "), listed, F.lit("."))), F.lit("\n"), reset)


#: fixed values: patterns of the simple detectors of code and of questions for code; prose is no veto
SIMPLE_CODE = (r"\b(module|endmodule)\b", r"always\s*@", r"\b(input|output|inout)\b", r"assign\s+\w+", r"reg|wire")
SIMPLE_QUERY = (r"(?i)\b(show|implement|code|write|syntax)\b", r"(?i)\bverilog\b", r"(?i)\b(module|circuit)\b")


def any_pattern(x, patterns) -> Column:
    return pattern_hits(x, patterns) > 0


def simple_code(x) -> Column:
    return any_pattern(x, SIMPLE_CODE)


def asks_for_code(x) -> Column:
    """A question for code by the simple detectors: it names what is wanted, or is code itself."""
    return any_pattern(x, SIMPLE_QUERY) | simple_code(x)


def chat_json(user, assistant, system: str | None = None) -> Column:
    """A chat record as one JSON line."""
    turns = [F.struct(F.lit(role).alias("role"), _c(text).alias("content")) for role, text in (("system", F.lit(system)), ("user", user), ("assistant", assistant)) if role != "system" or system is not None]
    return F.to_json(F.struct(F.array(*turns).alias("messages")))
