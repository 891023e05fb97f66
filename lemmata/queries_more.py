"""Further registered queries: logs and verdicts, string rules, dataflow steps, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lemmata.functions import text as X
from lemmata.operators import blocks, curate, retrieval
from lemmata.operators import temporal as E
from lemmata.plans import generate, sva
from lemmata.queries import _LINES_SQL, _OPS, _OPS_SQL, _PAIRS, _SHAPES_SQL, _SVA, _TRACE_SQL, _assertions, _trace, query
from lemmata.session import cut, table
from lemmata.sources import records


def _rows(spark: SparkSession, sf: str, name: str, **made: str) -> DataFrame:
    return table(spark, sf, name).selectExpr("*", *(f"{sql} as {column}" for column, sql in made.items()))


def _sql(x: str) -> str:
    return x.replace("AS STRING", "AS VARCHAR")


_ID = "l_orderkey * 10 + l_linenumber"

# ---------------------------------------------------------------- logs and verdicts

_LOG = """CASE l_linenumber % 4 WHEN 0 THEN 'run' || chr(10) || 'STATUS fwd proven' || chr(10) || ' STATUS bwd ' || CASE WHEN l_partkey % 2 = 0 THEN 'cex' ELSE 'proven' END || chr(10) || 'STATUS iff ' || CASE WHEN l_partkey % 3 = 0 THEN 'proven' ELSE 'cex' END
 WHEN 1 THEN 'ERROR (E' || CAST(l_suppkey AS STRING) || '): bad' || chr(10) || 'x' || chr(10) || '[ERROR] worse' WHEN 2 THEN 'STATUS fwd proven' || chr(10) || 'Full equivalence' || CASE WHEN l_partkey % 2 = 0 THEN chr(10) || 'a syntax error' ELSE '' END
 ELSE 'STATUS iff cex' || chr(10) || 'STATUS fwd cex' || chr(10) || 'STATUS bwd cex' || chr(10) || 'STATUS iff proven' END"""
_LOG_SQL = f"""g AS (SELECT {_ID} AS idx, {_sql(_LOG)} AS log FROM lineitem),
st AS (SELECT idx, log, list_transform(list_filter(list_transform(string_split(log, chr(10)), lambda l: trim(l)), lambda l: regexp_full_match(l, 'STATUS \\S+ \\S+')), lambda l: l[8:]) AS s FROM g),
vd AS (SELECT idx, log, list_filter(s, lambda l: l LIKE 'fwd %')[-1] = 'fwd proven' AS f, list_filter(s, lambda l: l LIKE 'bwd %')[-1] = 'bwd proven' AS b, list_filter(s, lambda l: l LIKE 'iff %')[-1] = 'iff proven' AS i FROM st)"""


@query(f"""WITH {_LOG_SQL} SELECT idx, CAST(f IS NOT NULL AND b IS NOT NULL AND i IS NOT NULL AS INTEGER) AS syntax, CAST(f IS NOT NULL AND b IS NOT NULL AND coalesce(i, FALSE) AS INTEGER) AS functionality,
 CAST(f IS NOT NULL AND b IS NOT NULL AND i IS NOT NULL AND (f OR b OR i) AS INTEGER) AS func_relaxed FROM vd""")
def log_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf, "lineitem", idx=_ID, log=_LOG).withColumn("found", X.statuses("log"))
    return rows.select("idx", X.verdict("found").alias("v")).select("idx", "v.*")


@query(f"""WITH {_LOG_SQL}, e AS (SELECT idx, log, list_filter(string_split(log, chr(10)), lambda l: l LIKE 'ERROR%' OR l LIKE '[ERROR]%') AS bad FROM g)
SELECT idx, CASE WHEN len(bad) > 0 THEN array_to_string(bad[1:1], chr(10)) ELSE right(log, 20) END AS summary, contains(log, 'Full equivalence') AND NOT contains(log, 'syntax error') AS equivalent FROM e""")
def error_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf, "lineitem", idx=_ID, log=_LOG).select("idx", X.error_summary("log", 1, 20).alias("summary"), X.equivalent("log").alias("equivalent"))


@query(f"""WITH {_LINES_SQL} SELECT idx, length(response) >= 90 AND NOT contains(response, '</think>') AS truncated FROM v""")
def truncation_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _assertions(spark, sf).select("idx", X.truncated("response", F.length("response"), 90).alias("truncated"))


# ---------------------------------------------------------------- string rules


@query(f"""WITH {_LINES_SQL}, w AS (SELECT idx, trim(sva) AS sva FROM v)
SELECT idx, CASE WHEN idx % 2 = 0 THEN trim(regexp_replace(string_split(sva, 'tb_reset)')[-1], '\\)\\s*;.*', '')) ELSE 'x ' || sva END AS body FROM w""")
def guarded_bodies(spark: SparkSession, sf: str) -> DataFrame:
    rows = _assertions(spark, sf).withColumn("t", F.when(F.col("idx") % 2 == 0, F.col("sva")).otherwise(F.concat(F.lit("x "), "sva")))
    return rows.select("idx", X.guarded_body("t").alias("body"))


@query(f"""WITH {_LINES_SQL}, a AS (SELECT idx, replace(regexp_extract(response, '(?s)assert property\\s*\\(.*?\\)\\s*;'), chr(10), ' ') AS got FROM v)
SELECT idx, nullif(got, '') AS found, replace(CASE WHEN got = '' THEN 'say "none"' ELSE got END, '"', chr(92) || '"') AS shown FROM a""")
def whole_assertions(spark: SparkSession, sf: str) -> DataFrame:
    return _assertions(spark, sf).select("idx", X.assertion_of("response").alias("found"), X.assertion_of("response", 'say "none"').alias("shown"))


_USER = """'Intro:' || chr(10) || 'module m(input a); parameter int W' || CAST(p_size AS STRING) || ' = 4; localparam [3:0] K = 1; ' || CASE WHEN p_size % 2 = 0 THEN 'wire tb_reset;' ELSE '' END || ' endmodule' || chr(10) || 'Question: check ' || p_brand || CASE WHEN p_size % 3 = 0 THEN ' Use the signals ''a'' and ''q''.' ELSE '' END || chr(10) || 'Enclose it.' || chr(10) || 'OL NL:  ' || p_name || '  ' || chr(10) || 'more'"""
_USER_SQL = f"u AS (SELECT p_partkey, p_size, p_brand, p_name, p_type, {_sql(_USER)} AS t FROM part)"


@query(f"""WITH {_USER_SQL}, q AS (SELECT *, trim(replace(string_split(t, 'Question:')[1], 'Intro:' || chr(10), ''), ' ' || chr(10)) AS testbench, trim(string_split('Question:' || string_split(t, 'Question:')[2], 'Enclose')[1], ' ' || chr(10)) AS question FROM u)
SELECT p_partkey, testbench, question, trim(string_split(string_split(t, 'OL NL:')[2], chr(10))[1]) AS restated, regexp_extract_all(t, '''([^''\\s]+)''', 1) || ['W' || p_size, 'K'] AS names FROM q""")
def user_turns(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf, "part", t=_USER).withColumn("u", X.user_content("t", "Intro:\n", "Enclose"))
    return rows.select("p_partkey", "u.testbench", "u.question", X.after_label("t").alias("restated"), X.quoted_and_parameters("t", "t").alias("names"))


@query(f"""WITH {_USER_SQL}, s AS (SELECT *, CASE p_size % 4 WHEN 0 THEN ['a', 'b'] WHEN 1 THEN ['clk'] ELSE [] END AS signals FROM u)
SELECT p_partkey, 'Question: ' || p_brand || CASE WHEN p_size % 3 = 0 THEN ' Use the signals x' ELSE '' END || CASE WHEN p_size % 3 = 0 OR len(signals) = 0 THEN '' ELSE ' Use the signals ' || array_to_string(list_transform(signals, lambda x: '''' || x || ''''), ', ') || '.' END || chr(10) || CASE WHEN contains(t, 'tb_reset') THEN 'The reset is tb_reset.' || chr(10) ELSE '' END AS question,
 array_to_string(list_transform(CASE WHEN list_contains(signals, 'clk') THEN signals ELSE signals || ['clk'] END, lambda x: 'logic ' || x || ';'), chr(10)) AS declared, signals || ['W' || p_size, 'K'] AS with_parameters FROM s""")
def question_prompts(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size") % 4
    signals = F.when(size == 0, F.array(F.lit("a"), F.lit("b"))).when(size == 1, F.array(F.lit("clk"))).otherwise(F.array().cast("array<string>"))
    problem = F.concat("p_brand", F.when(F.col("p_size") % 3 == 0, " Use the signals x").otherwise(""))
    rows = _rows(spark, sf, "part", t=_USER).withColumn("signals", signals)
    return rows.select("p_partkey", X.question(problem, "signals", "t").alias("question"), X.declarations("signals").alias("declared"), X.with_parameters("signals", "t").alias("with_parameters"))


_PIECE = """CASE p_size % 4 WHEN 0 THEN 'The expression "a && b" means that ' || p_name || '.' WHEN 1 THEN '"x"  is true when ' || p_name WHEN 2 THEN ' ' || p_name || '. ' ELSE '"y" evaluates to true if and only if {' || p_name || '} and }' END"""


@query(f"""WITH p AS (SELECT p_partkey, p_size, p_name, {_PIECE} AS t FROM part)
SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN '{{' || p_name || '}} and }}' ELSE p_name END AS operand, CASE WHEN p_size % 4 = 3 THEN '{{' || p_name || '}} and }}' END AS json, '(' || p_name || ') ##1 (b)' AS scenario,
 p_name AS book, p_size AS page, CASE WHEN p_size >= 10 THEN printf('%.1f KB', p_size / 10.0) ELSE printf('%.1f B', p_size * 100.0) END AS size FROM p""")
def operand_pieces(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("/books/"), "p_name", F.lit("/page_"), F.col("p_size").cast("string"), F.lit(".pdf"))
    rows = _rows(spark, sf, "part", t=_PIECE).withColumn("at", X.book_and_page(path))
    return rows.select("p_partkey", X.plain_operand("t").alias("operand"), X.json_part("t").alias("json"), X.scenario(F.array("p_name", F.lit("b"))).alias("scenario"), "at.book", F.col("at.page").cast("long").alias("page"), X.bytes_text(F.col("p_size") * 100).alias("size"))


@query(f"""WITH {_LINES_SQL}, b AS (SELECT idx, list_filter(list_transform(regexp_extract_all(response, '(?s)```[A-Za-z]*\n(.*?)```', 1), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS held FROM v)
SELECT idx, CAST(len(held) AS INTEGER) AS n, array_to_string(held, '|') AS held FROM b""")
def fenced_block_lists(spark: SparkSession, sf: str) -> DataFrame:
    held = X.fenced_blocks("response")
    return _assertions(spark, sf).select("idx", F.size(held).alias("n"), F.array_join(held, "|").alias("held"))


#: texts that a detector tells apart, by p_size % 12
_ASKED = """CASE p_size % 12 WHEN 0 THEN 'input a;' WHEN 1 THEN 'always @(x) y;' WHEN 2 THEN 'show me a circuit' WHEN 3 THEN 'WRITE it' WHEN 4 THEN 'assign y' WHEN 5 THEN 'what is a clock?' WHEN 6 THEN 'always x ##2 y'
 WHEN 7 THEN 'endmodule' WHEN 8 THEN 'modules' WHEN 9 THEN 'SystemVerilog' WHEN 10 THEN 'in Verilog' ELSE 'assert it at the posedge' END"""


@query(f"""SELECT p_partkey, p_size % 12 IN (0, 1, 4, 7) AS code, p_size % 12 IN (0, 1, 2, 3, 4, 7, 10) AS asks FROM part""")
def simple_detectors(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf, "part", t=_ASKED).select("p_partkey", X.simple_code("t").alias("code"), X.asks_for_code("t").alias("asks"))


#: lines that code and prose share, by p_size % 10: code patterns, whether prose, whether code
_MIXED = {
    "the module is good": (1, True, False), "wire w": (1, False, True), "if the bit is set": (2, True, True), "it is 5": (0, True, False), "assert property (a |-> b) for the best": (3, True, True),
    "x |-> y @ (posedge clk)": (1, False, True), "Good Words": (0, True, False), "plain words": (0, False, False), "begin x <= y; end": (2, False, True), "say: a |-> b, assert property (c); Yes": (2, False, True),
}
_LINE = "CASE p_size % 10 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_MIXED)) + " END"


@query("WITH m(k, hits, prose, code) AS (VALUES " + ", ".join(f"({i}, {n}, {p}, {c})" for i, (n, p, c) in enumerate(_MIXED.values())) + ") SELECT p_partkey, hits, prose, code, CASE WHEN code THEN 'code' ELSE 'text' END AS store FROM part JOIN m ON k = p_size % 10")
def detected_stores(spark: SparkSession, sf: str) -> DataFrame:
    code = X.is_code("t")
    return _rows(spark, sf, "part", t=_LINE).select("p_partkey", X.pattern_hits("t").alias("hits"), X.is_prose("t").alias("prose"), code.alias("code"), F.when(code, "code").otherwise("text").alias("store"))


@query("""SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN NULL ELSE lower(event_type) || json_extract_string(props, '$.k') END AS picked, map_keys(map_from_entries(list_filter([{'k': event_type, 'v': 1}, {'k': 'k', 'v': 2}], lambda e: contains(e.k, 'c')))) AS kept FROM events""")
def nested_fields(spark: SparkSession, sf: str) -> DataFrame:
    fields = F.from_json("props", "map<string,string>")
    nested = F.transform_values(fields, lambda k, v: F.concat(F.lower("event_type"), v))
    kept = F.map_filter(F.create_map(F.col("event_type"), F.lit(1), F.lit("k"), F.lit(2)), lambda k, v: F.contains(k, F.lit("c")))
    return table(spark, sf, "events").select("event_id", F.element_at(nested, F.lit("k")).alias("picked"), F.map_keys(kept).alias("kept"))


# ---------------------------------------------------------------- aggregates, windows, order


@query(f"""WITH {_LINES_SQL}, s AS (SELECT flag, len(list_distinct(list_filter(string_split(sva, ' '), lambda t: t IN ({", ".join(f"'{o}'" for o in _OPS)})))) AS arity FROM v),
m AS (SELECT max(arity) AS most, avg(arity) AS mean FROM s) SELECT k AS arity, count(s.arity) AS n, round(any_value(mean), 6) AS mean FROM (SELECT unnest(range(0, most + 1)) AS k, mean FROM m) LEFT JOIN s ON s.arity = k GROUP BY k""")
def operator_arity(spark: SparkSession, sf: str) -> DataFrame:
    held = F.array_intersect(F.split("sva", " "), F.array(*[F.lit(o) for o in _OPS]))
    got = curate.arity(_assertions(spark, sf).withColumn("held", held), "held")
    return got.select("arity", "n", F.round("mean", 6).alias("mean"))


@query(f"""WITH {_LINES_SQL} SELECT flag, array_to_string(list_sort(list(DISTINCT t)), ' ') AS operators FROM (SELECT flag, unnest(string_split(sva, ' ')) AS t FROM v) WHERE t IN ({", ".join(f"'{o}'" for o in _OPS)}) GROUP BY flag""")
def operator_union(spark: SparkSession, sf: str) -> DataFrame:
    held = F.array_intersect(F.split("sva", " "), F.array(*[F.lit(o) for o in _OPS]))
    return _assertions(spark, sf).select("flag", F.explode(held).alias("t")).groupBy("flag").agg(F.array_join(F.array_sort(F.collect_set("t")), " ").alias("operators"))


@query(f"""WITH {_LINES_SQL}, {_OPS_SQL}, seen AS (SELECT DISTINCT unnest(string_split(sva, ' ')) AS op FROM v) SELECT seen.op AS op, ops.op IS NOT NULL AS known, CASE WHEN seen.op IN ('!==', '&&', '||', '!') THEN 'non_temporal' ELSE 'temporal' END AS class FROM seen LEFT JOIN ops ON seen.op = ops.op
WHERE regexp_full_match(seen.op, '[^A-Za-z0-9_;]+') AND seen.op <> ''""")
def discovered_operators(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.createDataFrame([(o, True) for o in _OPS], "op string, known boolean")
    seen = _assertions(spark, sf).select(F.explode(F.split("sva", " ")).alias("op")).distinct().where(F.col("op").rlike("^[^A-Za-z0-9_;]+$"))
    return seen.join(F.broadcast(known), "op", "left").select("op", F.coalesce("known", F.lit(False)).alias("known"), X.operator_class("op").alias("class"))


@query("""SELECT count(*) AS records, CAST(sum(l_quantity) AS DOUBLE) AS tokens, round(sum(l_linenumber * 0.5) / count(*), 6) AS seconds_a_record, round(sum(l_quantity) / sum(l_linenumber * 0.5), 6) AS tokens_a_second FROM lineitem""")
def token_throughput(spark: SparkSession, sf: str) -> DataFrame:
    got = curate.throughput(_rows(spark, sf, "lineitem", q="cast(l_quantity as double)", s="cast(l_linenumber * 0.5 as double)"), "q", "s")
    return got.select("records", "tokens", F.round("seconds_a_record", 6).alias("seconds_a_record"), F.round("tokens_a_second", 6).alias("tokens_a_second"))


@query(f"""WITH {_LINES_SQL}, a AS (SELECT count(*) AS n, count(*) FILTER (response LIKE '%assert property%') AS got, count(*) FILTER (response = sva) AS exact, count(*) FILTER (response LIKE '%tb_reset%') AS reset, sum(length(sva)) * 1.0 / sum(length(response)) AS ratio FROM v)
SELECT n, got, exact, reset, round(got * 1.0 / n, 6) AS coverage, round(ratio, 6) AS ratio FROM a""")
def conditional_counts(spark: SparkSession, sf: str) -> DataFrame:
    hit = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    got = hit(F.contains("response", F.lit("assert property")))
    n = F.count(F.lit(1))
    return _assertions(spark, sf).agg(
        n.alias("n"), got.alias("got"), hit(F.col("response") == F.col("sva")).alias("exact"), hit(F.contains("response", F.lit("tb_reset"))).alias("reset"),
        F.round(got / F.nullif(n, F.lit(0)), 6).alias("coverage"), F.round(F.sum(F.length("sva")) / F.nullif(F.sum(F.length("response")), F.lit(0)), 6).alias("ratio"),
    )


@query("""SELECT user_id, event_id, row_number() OVER w AS done, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) // row_number() OVER w AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_rates(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    total = F.sum(F.round(F.col("value") * 100).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    done = F.row_number().over(w).cast("long")
    return table(spark, sf, "events").select("user_id", "event_id", done.alias("done"), F.floor(total / done).alias("rate"))


_WITHOUT = "'module m;' || chr(10) || ' wire a;' || chr(10) || 'endmodule'"
_WITH = f"'module m;' || chr(10) || ' wire a;' || chr(10) || 'x' || chr(10) || {_SVA} || chr(10) || 'last' || chr(10) || 'endmodule'"


@query(f"SELECT {_ID} AS idx, {_sql(_SVA)} || chr(10) || 'last' AS added FROM lineitem")
def added_assertions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf, "lineitem", idx=_ID, a=_WITH, b=_WITHOUT)
    return rows.select("idx", curate.added_lines(X.last_module("a"), X.last_module("b")).alias("added"))


@query("""SELECT method, design || '_' || method || '.sv' AS file, string_agg(line, chr(10) ORDER BY pos, line) AS text FROM (SELECT l_returnflag AS method, 'd' || l_suppkey % 20 AS design, l_orderkey * 100 + l_linenumber * 10 + l_partkey % 10 AS pos, l_shipdate::DATE || '' AS line FROM lineitem) GROUP BY method, design""")
def design_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf, "lineitem", method="l_returnflag", design="'d' || cast(l_suppkey % 20 as string)", pos="l_orderkey * 100 + l_linenumber * 10 + l_partkey % 10", line="cast(cast(l_shipdate as date) as string)")
    return records.design_files(rows, "pos", "line")


@query("""SELECT source, source || chr(10) || string_agg(doc_id || ': ' || CASE WHEN quality = 1 THEN 'good' ELSE '<none>' END, chr(10) ORDER BY doc_id) AS text FROM labels JOIN documents USING (doc_id) GROUP BY source""")
def text_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    line = F.concat(F.col("doc_id").cast("string"), F.lit(": "), F.when(F.col("quality") == 1, "good").otherwise("<none>"))
    return curate.section(rows, "source", "doc_id", line, F.col("source"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE n_name END AS name FROM nation UNION ALL SELECT 1000, 'added'""")
def registry_upsert(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    more = old.where("n_nationkey % 3 = 0").withColumn("name", F.lit("new")).unionByName(spark.createDataFrame([(1000, "added")], old.select(F.col("n_nationkey").cast("long"), "name").schema).withColumn("n_nationkey", F.col("n_nationkey").cast(old.schema["n_nationkey"].dataType)))
    return curate.upsert(old, more, "n_nationkey")


@query("""SELECT c_custkey, 'load ' || c_name || '; prove ' || c_nationkey AS script FROM customer""")
def rendered_scripts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", X.render(F.lit("load {design}; prove {n}"), design=F.col("c_name"), n=F.col("c_nationkey").cast("string")).alias("script"))


@query("""SELECT name, count(*) AS n FROM (SELECT p_name AS name FROM part UNION ALL SELECT s_name FROM supplier UNION ALL SELECT 'extra book') GROUP BY name""")
def many_books(spark: SparkSession, sf: str) -> DataFrame:
    books = table(spark, sf, "part").select(F.col("p_name").alias("name")).unionAll(table(spark, sf, "supplier").select(F.col("s_name").alias("name")))
    return books.unionAll(spark.createDataFrame([("extra book",)], "name string")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders""")
def request_order(spark: SparkSession, sf: str) -> DataFrame:
    return curate.numbered(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("""SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN 'unknown' ELSE event_type END AS status FROM events""")
def status_default(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    known = ev.where("event_id % 2 <> 0").select("event_id", F.col("event_type").alias("status"))
    return ev.select("user_id", "event_id").join(known, "event_id", "left").select("user_id", "event_id", F.coalesce("status", F.lit("unknown")).alias("status"))


@query("""SELECT conv_id, g.turn AS turn, 'p' || g.turn || ': (' || g.text || ') iff (' || c.text || ')' AS pair FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user') g JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant') c USING (conv_id, n)""")
def golden_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    side = lambda role: rows.where(F.col("role") == role).withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    both = side("user").join(side("assistant").select("conv_id", "n", F.col("text").alias("other")), ["conv_id", "n"])
    return both.select("conv_id", "turn", F.concat(F.lit("p"), F.col("turn").cast("string"), F.lit(": ("), "text", F.lit(") iff ("), "other", F.lit(")")).alias("pair"))


_RULES = ((r"\\$[a-z]+", "system"), (r"##\\d", "delay"), (r"\\|[-=]>", "implication"), (r"s_[a-z]+", "strong"))


@query(f"""WITH {_LINES_SQL}, r(rule, name) AS (VALUES {", ".join(f"('{p}', '{n}')" for p, n in _RULES)}) SELECT name, count(*) AS n, count(DISTINCT sva) AS texts FROM v JOIN r ON regexp_matches(sva, rule) GROUP BY name""")
def regex_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(list(_RULES), "rule string, name string")
    got = retrieval.regex_join(_assertions(spark, sf), "sva", rules, "rule")
    return got.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sva").alias("texts"))


# ---------------------------------------------------------------- trees


@query(f"""WITH {_SHAPES_SQL}, k AS (SELECT key, sva, parent_id, string_agg(DISTINCT '' || preorder, ', ' ORDER BY '' || preorder) AS refs FROM nd WHERE parent_id IS NOT NULL GROUP BY 1, 2, 3),
one AS (SELECT DISTINCT nd.sva AS sva, preorder, preorder || '. ' || label || CASE WHEN type = 'operator' THEN ' <- ' || refs || ': ' || code ELSE '' END AS line FROM nd LEFT JOIN k ON nd.key = k.key AND nd.sva = k.sva AND nd.node_id = k.parent_id),
t AS (SELECT sva, string_agg(line, chr(10) ORDER BY preorder) AS numbered FROM one GROUP BY sva) SELECT key, numbered FROM sh JOIN t ON sh.sva = t.sva""")
def tree_numbered(spark: SparkSession, sf: str) -> DataFrame:
    return sva.trees(_assertions(spark, sf), "idx", "sva", ("numbered",)).where("status = 'ok'").select("key", "numbered")


@query(f"""WITH {_SHAPES_SQL}, o AS (SELECT sva, any_value(shape) AS shape, any_value(q) AS q, any_value(r) AS r FROM sh GROUP BY sva)
SELECT sva, CASE shape WHEN 0 THEN 'req_' || r || ',ack_b' WHEN 1 THEN 'a,b' WHEN 2 THEN 'a,b' WHEN 3 THEN 'a,b,c' WHEN 4 THEN 'a,b,p' || q ELSE 'a' END AS signals, shape <> 5 AS operator_root FROM o WHERE shape < 6""")
def tree_signals(spark: SparkSession, sf: str) -> DataFrame:
    texts = _assertions(spark, sf).select("sva").distinct().withColumn("key", F.xxhash64("sva"))
    found = sva.nodes(texts, "key", "sva", ("node_id", "parent_id", "preorder", "type", "label")).where("status = 'ok'")
    roots = found.where("parent_id is null").select("key", (F.col("type") == "operator").alias("operator_root"))
    return texts.join(sva.signals(found), "key").join(roots, "key").select("sva", F.array_join("signals", ",").alias("signals"), "operator_root")


@query(f"""WITH {_SHAPES_SQL}, t AS (SELECT DISTINCT sva, preorder, code FROM nd WHERE label LIKE '##%'), f AS (SELECT sva, arg_min(code, preorder) AS code FROM t GROUP BY sva) SELECT f.sva AS sva, f.code AS code FROM f""")
def tree_first_delay(spark: SparkSession, sf: str) -> DataFrame:
    texts = _assertions(spark, sf).select("sva").distinct().withColumn("key", F.xxhash64("sva"))
    first = sva.first_node(sva.nodes(texts, "key", "sva", ("preorder", "label", "code")), "##")
    return texts.join(first, "key").select("sva", "code")


@query(f"""WITH RECURSIVE {_SHAPES_SQL}, one AS (SELECT DISTINCT sva, node_id, parent_id, code FROM nd),
w AS (SELECT sva, node_id, 'piece of ' || sva AS piece FROM one WHERE parent_id IS NULL UNION ALL SELECT one.sva, one.node_id, md5(w.piece || ' | ' || one.code) FROM one JOIN w ON one.sva = w.sva AND one.parent_id = w.node_id) SELECT sva, CAST(node_id AS INTEGER) AS node_id, piece FROM w""")
def tree_walk_down(spark: SparkSession, sf: str) -> DataFrame:
    texts = _assertions(spark, sf).select("sva").distinct().withColumn("key", F.xxhash64("sva"))
    found = sva.nodes(texts, "key", "sva", ("node_id", "parent_id", "code")).where("status = 'ok'")
    pieces = texts.select("key", F.concat(F.lit("piece of "), "sva").alias("piece"))
    walked = generate.walk_down(found, pieces, lambda piece, code: F.md5(F.concat(piece, F.lit(" | "), code)))
    return texts.join(walked, "key").select("sva", "node_id", "piece")


@query(f"""WITH {_LINES_SQL}, s AS (SELECT CASE WHEN sva LIKE '%|| (b);' THEN 'error: expected ), got the end' ELSE 'ok' END AS status, sva FROM v),
n AS (SELECT status, count(*) AS n FROM s GROUP BY status), x AS (SELECT status, array_to_string(list(sva ORDER BY sva)[1:2], '~') AS examples FROM (SELECT DISTINCT status, sva FROM s) GROUP BY status)
SELECT n.status AS status, n, round(n / (SELECT count(*) FROM s), 6) AS share, examples FROM n JOIN x ON n.status = x.status""")
def parser_report(spark: SparkSession, sf: str) -> DataFrame:
    texts = _assertions(spark, sf).groupBy("sva").agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.xxhash64("sva"))
    got = texts.join(sva.trees(texts, "key", "sva", ("n_nodes",)).select("key", "status"), "key")
    got = cut(got)
    return curate.shares(got, "status", "n").join(curate.least(got, "status", "sva", 2), "status").select("status", "n", F.round("share", 6).alias("share"), F.array_join("least", "~").alias("examples"))


@query(f"""WITH {_LINES_SQL} SELECT DISTINCT idx, 'macro__W' || idx % 3 || ' |-> macro__K' AS plain, '`W' || idx % 3 || ' |-> `K' AS again FROM v""")
def macro_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = _assertions(spark, sf).select("idx", F.concat(F.lit("`W"), (F.col("idx") % 3).cast("string"), F.lit(" |-> `K")).alias("t")).distinct()
    return rows.select("idx", sva.without_macros(F.col("t")).alias("plain"), sva.with_macros(sva.without_macros(F.col("t"))).alias("again"))


# ---------------------------------------------------------------- retrieval and generation

_DIM = 16
_SLOTS = f"list_transform(regexp_extract_all(translate(coalesce({{t}}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+'), lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {_DIM})"
_COUNTS = f"list_transform(range(0, {_DIM}), lambda i: CAST(len(list_filter({{s}}, lambda x: x = i)) AS DOUBLE))"
_UNIT = "list_transform({c}, lambda x: x / greatest(sqrt(list_sum(list_transform({c}, lambda y: y * y))), 1e-9))"
_RETRIEVE = f"""qs AS (SELECT item_id, {_SLOTS.format(t='text')} AS s FROM benchmark), qc AS (SELECT item_id, {_COUNTS.format(s='s')} AS c FROM qs), qv AS (SELECT item_id, {_UNIT.format(c='c')} AS q FROM qc),
cs AS (SELECT c_custkey AS id, c_name AS content, {_SLOTS.format(t="regexp_replace(c_mktsegment || ' ' || c_name, '[0-9#]+', ' ', 'g')")} AS s FROM customer), cc AS (SELECT id, content, {_COUNTS.format(s='s')} AS c FROM cs), cv AS (SELECT id, content, {_UNIT.format(c='c')} AS v FROM cc)"""


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.round(retrieval.norm("embedding"), 6).alias("norm"))


@query(f"""WITH s AS (SELECT doc_id, {_SLOTS.format(t='text')} AS s FROM documents), c AS (SELECT doc_id, {_COUNTS.format(s='s')} AS c FROM s), u AS (SELECT doc_id, {_UNIT.format(c='c')} AS v FROM c) SELECT doc_id, CAST(unnest(range(0, {_DIM})) AS INTEGER) AS dim, round(unnest(v), 6) AS v FROM u""")
def text_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(retrieval.embed(F.col("text"), _DIM)).alias("dim", "v")).select("doc_id", "dim", F.round("v", 6).alias("v"))


@query(f"""WITH {_LINES_SQL}, t AS (SELECT DISTINCT sva, sva LIKE '%|=>%' OR sva LIKE '%##%' AS code FROM v),
h AS (SELECT t.sva AS sva, CASE WHEN code THEN 'code' ELSE 'text' END AS store, op FROM t JOIN ({" UNION ALL ".join(f"SELECT '{o}' AS op" for o in _OPS)}) ON contains(sva, op)),
c AS (SELECT sva, string_agg(store || '/' || op, '; ' ORDER BY op) AS context FROM h GROUP BY sva)
SELECT t.sva AS sva, CASE WHEN code THEN 'code' ELSE 'text' END AS store, 'stub:' || md5(coalesce(context, '') || chr(10) || t.sva) AS answer FROM t LEFT JOIN c ON t.sva = c.sva""")
def routed_answers(spark: SparkSession, sf: str) -> DataFrame:
    rows = _assertions(spark, sf).select("sva").distinct()
    rows = rows.withColumn("store", F.when(F.contains("sva", F.lit("|=>")) | F.contains("sva", F.lit("##")), "code").otherwise("text"))
    ops = spark.createDataFrame([(o,) for o in _OPS], "op string")
    hits = retrieval.contains_join(rows, "sva", ops, "op").select("sva", F.concat_ws("/", "store", "op").alias("content"), F.col("op").alias("rank"))
    prompts = generate.stuff(rows.drop("store"), hits, "sva", "{context}\n{query}", "; ")
    return generate.complete(prompts, "prompt", "answer", generate.Stub()).join(rows, "sva").select("sva", "store", "answer")


_EXPAND = (("operations", "Name the operations of: {sva}"), ("restated", "Restate: {sva} with {operations}"), ("answer", "{restated}; {operations}; write one assertion"))


@query(f"""WITH {_LINES_SQL}, a AS (SELECT DISTINCT sva FROM v), b AS (SELECT sva, 'stub:' || md5('Name the operations of: ' || sva) AS operations FROM a), c AS (SELECT *, 'stub:' || md5('Restate: ' || sva || ' with ' || operations) AS restated FROM b)
SELECT sva, operations, restated, 'stub:' || md5(restated || '; ' || operations || '; write one assertion') AS answer FROM c""")
def staged_generation(spark: SparkSession, sf: str) -> DataFrame:
    return generate.stages(_assertions(spark, sf).select("sva").distinct(), list(_EXPAND), generate.Stub())


@query(f"""WITH {_LINES_SQL}, s(style, a, b) AS (VALUES {", ".join(f"('{k}', '{t.split('{query}')[0]}', '{t.split('{query}')[1]}')".replace(chr(10), "' || chr(10) || '") for k, t in generate.TEMPLATES.items())}),
{_OPS_SQL}, h AS (SELECT DISTINCT sva, op FROM v JOIN ops ON contains(sva, op)), c AS (SELECT sva, string_agg(op, chr(10) || chr(10) ORDER BY op) AS context FROM h GROUP BY sva), t AS (SELECT DISTINCT sva FROM v)
SELECT style, t.sva AS sva, md5(replace(a, '{{context}}', coalesce(context, '')) || t.sva || b) AS prompt FROM s, t LEFT JOIN c ON t.sva = c.sva""")
def prompt_styles(spark: SparkSession, sf: str) -> DataFrame:
    rows = _assertions(spark, sf).select("sva").distinct()
    ops = spark.createDataFrame([(o,) for o in _OPS], "op string")
    rows = cut(rows)
    hits = cut(retrieval.contains_join(rows, "sva", ops, "op").select("sva", F.col("op").alias("content"), F.col("op").alias("rank")))
    out = None
    for style, template in generate.TEMPLATES.items():
        one = generate.stuff(rows, hits, "sva", template).select(F.lit(style).alias("style"), "sva", F.md5("prompt").alias("prompt"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_LINES_SQL}, t AS (SELECT idx, sva, pos, tok FROM (SELECT DISTINCT idx, sva, unnest(range(0, len(string_split(sva, ' ')))) AS pos, unnest(string_split(sva, ' ')) AS tok FROM v)), {_OPS_SQL}
SELECT sva, string_agg(DISTINCT pos || ':' || tok, ' ' ORDER BY pos || ':' || tok) AS context FROM t JOIN ops ON tok = op GROUP BY sva""")
def token_recheck(spark: SparkSession, sf: str) -> DataFrame:
    ops = spark.createDataFrame([(o,) for o in _OPS], "op string")
    each = _assertions(spark, sf).select("sva").distinct().select("sva", F.posexplode(F.split("sva", " ")).alias("pos", "op")).join(F.broadcast(ops), "op")
    return each.groupBy("sva").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "pos", "op"))), " ").alias("context"))


@query(f"""WITH {_SHAPES_SQL}, {_OPS_SQL}, t AS (SELECT sva, any_value(shape) AS shape FROM sh GROUP BY sva), g AS (SELECT sva, string_agg(op, ',' ORDER BY op) AS glossary FROM t JOIN ops ON contains(sva, op) GROUP BY sva),
n AS (SELECT sva, '' || max(preorder) AS nodes FROM nd GROUP BY sva) SELECT t.sva AS sva, shape < 6 AS structured, coalesce(nodes, glossary) AS context FROM t LEFT JOIN n ON t.sva = n.sva LEFT JOIN g ON t.sva = g.sva""")
def tree_or_glossary(spark: SparkSession, sf: str) -> DataFrame:
    texts = _assertions(spark, sf).select("sva").distinct().withColumn("key", F.xxhash64("sva"))
    ops = spark.createDataFrame([(o,) for o in _OPS], "op string")
    glossary = retrieval.contains_join(texts.select("sva"), "sva", ops, "op").groupBy("sva").agg(F.array_join(F.array_sort(F.collect_list("op")), ",").alias("glossary"))
    tree = sva.trees(texts, "key", "sva", ("n_nodes",))
    return texts.join(tree, "key").join(glossary, "sva", "left").select("sva", (F.col("status") == "ok").alias("structured"), F.coalesce(F.col("n_nodes").cast("string"), "glossary").alias("context"))


_OK = "substr(md5({x}), 1, 1) <= '7'"


@query(f"""WITH {_LINES_SQL}, a AS (SELECT DISTINCT sva, sva AS x FROM v), b AS (SELECT *, {_OK.format(x='x')} AS k FROM a), c AS (SELECT sva, CASE WHEN k THEN x ELSE 'stub:' || md5('Correct: ' || x) END AS x, k, 1 + CAST(NOT k AS INTEGER) AS tries FROM b),
d AS (SELECT sva, x, {_OK.format(x='x')} AS k, tries FROM c), e AS (SELECT sva, CASE WHEN k THEN x ELSE 'stub:' || md5('Correct: ' || x) END AS x, tries + CAST(NOT k AS INTEGER) AS tries FROM d) SELECT sva, x, CAST(tries AS INTEGER) AS tries, {_OK.format(x='x')} AS ok FROM e""")
def verified_answers(spark: SparkSession, sf: str) -> DataFrame:
    rows = _assertions(spark, sf).select("sva").distinct().withColumn("x", F.col("sva"))

    def correct(bad: DataFrame, column: str) -> DataFrame:
        return generate.complete(bad.withColumn("_p", F.concat(F.lit("Correct: "), column)).drop(column), "_p", column, generate.Stub()).drop("_p")

    return generate.verify_loop(rows, "x", lambda c: F.substring(F.md5(c), 1, 1) <= "7", correct, 2)


@query(f"""WITH c AS (SELECT doc_id, substr(md5('' || doc_id), 1, 1) <= 'b' AS ok, md5('0:' || doc_id) AS h FROM documents), t AS (SELECT doc_id, ok FROM c ORDER BY h, doc_id LIMIT 100), p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM c WHERE ok AND doc_id NOT IN (SELECT doc_id FROM t)),
f AS (SELECT doc_id AS slot, row_number() OVER (ORDER BY doc_id) AS n FROM t WHERE NOT ok) SELECT doc_id AS slot, doc_id AS resolved, FALSE AS filled FROM t WHERE ok UNION ALL SELECT slot, p.doc_id, TRUE FROM f LEFT JOIN p USING (n)""")
def reasoning_dataset(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id")
    target = curate.sample_n(docs, 100, "doc_id", 0)
    check = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) <= "b"
    good, failed = generate.verified(target, "doc_id", lambda c: check)
    filled = curate.backfill(failed, docs.where(check), target, "doc_id")
    return good.select(F.col("doc_id").alias("slot"), F.col("doc_id").alias("resolved"), F.lit(False).alias("filled")).unionByName(filled.withColumn("filled", F.lit(True)))


@query(f"""WITH {_LINES_SQL} SELECT sva, '{{"messages":[{{"role":"user","content":"check"}},{{"role":"assistant","content":"' || replace(sva, '"', chr(92) || '"') || '"}}]}}' AS value, count(*) AS n FROM v GROUP BY sva""")
def chat_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _assertions(spark, sf).groupBy("sva").agg(F.count(F.lit(1)).alias("n")).select("sva", X.chat_json(F.lit("check"), "sva").alias("value"), "n")


@query("""SELECT source, md5(string_agg(doc_id || '. ' || md5(coalesce(text, '')), chr(10) ORDER BY doc_id)) AS prompt, count(*) AS n FROM documents GROUP BY source""")
def batch_prompts(spark: SparkSession, sf: str) -> DataFrame:
    line = F.struct("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(". "), F.md5(F.coalesce("text", F.lit("")))).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n")
    return table(spark, sf, "documents").groupBy("source").agg(F.md5(joined).alias("prompt"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_LINES_SQL} SELECT sva, 'OL NL: say' || chr(10) || chr(10) || '# Decomposition' || chr(10) || 'd' || chr(10) || chr(10) || '# Merge' || chr(10) || 'm' || chr(10) || chr(10) || '```systemverilog' || chr(10) || sva || chr(10) || '```' AS turn, list_sort(list_filter(list_distinct(regexp_extract_all(sva, '[$A-Za-z_][$\\w'']*')), lambda x: x IN ('req_0', 'ack_b', 'c'))) AS unknown FROM (SELECT DISTINCT sva FROM v)""")
def grounded_turns(spark: SparkSession, sf: str) -> DataFrame:
    design = F.lit("a b p0 p1 p2 p3 p4 p5 p6 p7 p8 p9 p10 req_1 req_2 req_3 req_4 req_5 req_6 posedge clk disable iff tb_reset assert property until and not s_eventually asrt_1 asrt_2 asrt_3 asrt_4 asrt_5 asrt_6 asrt_7")
    rows = _assertions(spark, sf).select("sva").distinct()
    return rows.select("sva", generate.assistant_turn(F.lit("say"), F.lit("d"), F.lit("m"), F.col("sva")).alias("turn"), F.array_sort(generate.grounded(F.col("sva"), design)).alias("unknown"))


@query("""SELECT l_orderkey AS file, l_linenumber * 1000 + l_suppkey AS line, CASE WHEN l_linenumber IN (2, 5) AND l_partkey % 2 = 0 THEN '// bad' WHEN l_linenumber IN (2, 5) THEN 'odd' ELSE 'fine' END AS value FROM (SELECT l_orderkey, l_linenumber, l_suppkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2, 3)""")
def comment_fixpoint(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.min("l_partkey").alias("p"))
    hit = F.col("l_linenumber").isin(2, 5)
    # a line is known by both of its numbers: the sum that is shown may be the same for two lines of a file
    line = F.struct("l_linenumber", "l_suppkey")
    source = rows.select(F.col("l_orderkey").alias("file"), line.alias("line"), F.when(hit & (F.col("p") % 2 == 0), "bad").when(hit, "odd").otherwise("fine").alias("value"))
    report = lambda now: now.where("value = 'bad'").groupBy("file").agg(F.min("line").alias("line"))
    fixed = generate.fix_until_clean(source, report, records.comment_out)
    return fixed.select("file", (F.col("line.l_linenumber") * 1000 + F.col("line.l_suppkey")).alias("line"), "value")


@query(f"""WITH {_TRACE_SQL} SELECT trace_id, bool_and(a = b) AS agree, min(tick) FILTER (a <> b) AS counterexample, bool_and(NOT a OR b) AS a_implies_b, bool_and(NOT b OR a) AS b_implies_a FROM tr GROUP BY trace_id""")
def trace_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return E.agreement(_trace(spark, sf), "a", "b")


@query(f"""WITH {_TRACE_SQL}, s AS (SELECT t.trace_id AS trace_id, t.tick AS start, u.tick AS stop, u.g AS g FROM tr t JOIN tr u ON t.trace_id = u.trace_id AND u.tick = t.tick + 1 WHERE t.a AND u.b) SELECT trace_id, count(*) AS n, bool_and(g) AS claim FROM s GROUP BY trace_id""")
def scenario_claims(spark: SparkSession, sf: str) -> DataFrame:
    t = _trace(spark, sf)
    found = E.concat(E.matches(t, "a"), E.matches(t, "b"), 1, 1)
    ends = found.join(t.select("trace_id", F.col("tick").alias("end"), "g"), ["trace_id", "end"])
    return ends.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.every("g").alias("claim"))


# ---------------------------------------------------------------- page blocks from the documents' lines

_LB = """lb AS (SELECT doc_id, i AS pos, lines[i + 1] AS content FROM (SELECT doc_id, lines, unnest(range(0, len(lines))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)))"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "content"))


@query(f"""WITH {_LB}, f AS (SELECT doc_id, pos, content, CASE WHEN length(content) % 3 = 0 THEN 'Courier-Bold' ELSE 'Times' END AS font FROM lb) SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN font LIKE '%ourier%' OR regexp_full_match(content, '\\s*[0-9]+\\s*') THEN 'code' ELSE 'text' END AS kind FROM f""")
def block_kinds(spark: SparkSession, sf: str) -> DataFrame:
    font = F.when(F.length("content") % 3 == 0, "Courier-Bold").otherwise("Times")
    lines = F.array(F.struct(F.array(F.struct(F.col("content").alias("text"), font.alias("font"))).alias("spans")))
    return _lines(spark, sf).select("doc_id", "pos", blocks.block_type(lines).alias("kind"))


@query(f"""WITH {_LB}, k AS (SELECT *, CASE WHEN length(content) % 2 = 0 THEN 'code' ELSE 'text' END AS kind FROM lb), r AS (SELECT *, CASE WHEN kind = 'code' AND lag(kind) OVER w = 'code' THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM r) SELECT doc_id, CAST(min(pos) AS INTEGER) AS pos, min(kind) AS kind, CAST(max(length(content)) AS DOUBLE) AS right_edge, md5(string_agg(content, chr(10) ORDER BY pos)) AS digest FROM i GROUP BY doc_id, run""")
def code_block_merge(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("content").cast("double")
    rows = _lines(spark, sf).withColumns({"kind": F.when(F.length("content") % 2 == 0, "code").otherwise("text"), "bbox": F.array(F.lit(0.0), F.col("pos").cast("double"), n, F.col("pos") + F.lit(1.0))})
    return blocks.merge_code(rows, ["doc_id"], "pos").select("doc_id", "pos", "kind", F.col("bbox")[2].alias("right_edge"), F.md5("content").alias("digest"))


@query(f"""WITH {_LB}, f AS (SELECT *, (length(content) % 4 = 0) AS ind FROM lb), p AS (SELECT *, lead(ind) OVER w AS nxt, lag(ind) OVER w AS prv, lead(content) OVER w AS more FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(CASE WHEN ind AND nxt IS NOT NULL AND NOT nxt THEN content || ' ' || more ELSE content END) AS digest FROM p WHERE NOT (NOT ind AND coalesce(prv, FALSE))""")
def indented_merge(spark: SparkSession, sf: str) -> DataFrame:
    left = F.when(F.length("content") % 4 == 0, 70.0).otherwise(10.0)
    rows = _lines(spark, sf).withColumns({"kind": F.lit("text"), "n_lines": F.lit(1), "bbox": F.array(left, F.lit(0.0), F.lit(100.0), F.lit(1.0))})
    return blocks.merge_indented(rows, ["doc_id"], "pos").select("doc_id", "pos", F.md5("content").alias("digest"))


@query(f"""WITH {_LB}, f AS (SELECT *, CASE WHEN length(content) % 5 = 0 THEN '```' || content ELSE content END AS c FROM lb), s AS (SELECT *, c LIKE '```%' OR ltrim(c) LIKE '```%' AS fence, sum(CASE WHEN ltrim(c) LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS seen FROM f) SELECT doc_id, CAST(pos AS INTEGER) AS pos, fence OR seen % 2 = 1 AS fenced FROM s""")
def fence_state(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf).withColumn("content", F.when(F.length("content") % 5 == 0, F.concat(F.lit("```"), "content")).otherwise(F.col("content")))
    return blocks.in_fence(rows, ["doc_id"], "pos").select("doc_id", "pos", "fenced")


@query("""WITH t AS (SELECT doc_id, text, length(text) // 2 AS a FROM documents WHERE length(text) > 20) SELECT doc_id, md5(string_split(substr(text, greatest(a - 50, 0) + 1, a - greatest(a - 50, 0)), chr(10) || chr(10))[-1] || substr(text, a + 1, 5) || string_split(substr(text, a + 6, 50), chr(10) || chr(10))[1]) AS digest FROM t""")
def paragraph_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where(F.length("text") > 20).withColumn("a", F.floor(F.length("text") / 2).cast("int"))
    return rows.select("doc_id", F.md5(blocks.paragraph_window("text", "a", F.col("a") + 5, 50)).alias("digest"))


@query("""SELECT p_partkey, 'Read ' || p_brand || ' now.' || chr(10) || chr(10) || 'One two-fold ' || p_name AS cleaned, '  Read' || chr(10) || '  ' || p_brand AS indented, printf('%.1f%%', p_size * 1.0) AS share, p_name AS last_lines FROM part""")
def cleaned_pages(spark: SparkSession, sf: str) -> DataFrame:
    page = F.concat(F.lit("Read\n"), "p_brand", F.lit(" now.\f"), F.lit("One two-fold\n"), "p_name")
    split = F.concat(F.lit("Read\n"), "p_brand")
    return table(spark, sf, "part").select("p_partkey", X.cleanup(page).alias("cleaned"), X.indent(split, "  ").alias("indented"), X.percent(F.col("p_size") / 100).alias("share"), F.array_join(X.tail_lines(page, 1), "|").alias("last_lines"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'T:Set |C:assign y =|T: ' || p_name ELSE 'T:' || p_name END AS parts FROM (SELECT *, 1 AS k FROM part)""")
def mixed_lines(spark: SparkSession, sf: str) -> DataFrame:
    line = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Set assign y = "), "p_name")).otherwise(F.col("p_name"))
    shown = F.array_join(F.transform(blocks.mixed_segments(line), lambda s: F.concat(F.when(s["is_code"], "C:").otherwise("T:"), s["text"])), "|")
    return table(spark, sf, "part").select("p_partkey", shown.alias("parts"))


# ---------------------------------------------------------------- sources over lines


@query("""SELECT count(*) AS n, min('f' || o_orderkey) AS example FROM orders WHERE o_orderkey % 3 <> 0""")
def shard_completeness(spark: SparkSession, sf: str) -> DataFrame:
    index = table(spark, sf, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("name"))
    files = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("name"))
    return records.missing(index, files, "name")
