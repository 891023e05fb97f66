"""The registered queries and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lemmata.functions import text as X
from lemmata.operators import curate, retrieval
from lemmata.operators import temporal as E
from lemmata.plans import generate, sva
from lemmata.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- retrieval


@query("""
WITH q AS (SELECT vec_id AS qid, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT qid, vec_id AS id, list_sum(list_transform(range(1, len(qv) + 1), lambda i: CAST(qv[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE))) AS score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)
SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 4
""")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = rows.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return retrieval.topk(asked, rows, 4).select("qid", "id", "rank", F.round("score", 6).alias("score"))


@query("""
WITH q AS (SELECT vec_id AS qid, embedding AS qv FROM embeddings WHERE vec_id % 100 = 50),
s AS (SELECT qid, vec_id AS id, sqrt(list_sum(list_transform(range(1, len(qv) + 1), lambda i: power(CAST(qv[i] AS DOUBLE) - CAST(embedding[i] AS DOUBLE), 2)))) AS score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM s)
SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 5
""")
def vector_topk_l2(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = rows.where("id % 100 = 50").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return retrieval.topk(asked, rows, 5, "l2").select("qid", "id", "rank", F.round("score", 6).alias("score"))


@query("""
WITH q AS (SELECT vec_id AS qid, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT qid, vec_id AS id, list_sum(list_transform(range(1, len(qv) + 1), lambda i: CAST(qv[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE))) AS score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)
SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 4
""")
def vector_topk_every20(spark: SparkSession, sf: str) -> DataFrame:
    """`vector_topk` asked with every row whose id is divisible by 20."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return retrieval.topk(asked, rows, 4).select("qid", "id", "rank", F.round("score", 6).alias("score"))


@query("""
WITH q AS (SELECT vec_id AS qid, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT qid, vec_id AS id, sqrt(list_sum(list_transform(range(1, len(qv) + 1), lambda i: power(CAST(qv[i] AS DOUBLE) - CAST(embedding[i] AS DOUBLE), 2)))) AS score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM s)
SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 5
""")
def vector_topk_l2_every20(spark: SparkSession, sf: str) -> DataFrame:
    """`vector_topk_l2` asked with every row whose id is divisible by 20."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return retrieval.topk(asked, rows, 5, "l2").select("qid", "id", "rank", F.round("score", 6).alias("score"))


@query("""
WITH e AS (SELECT label, unnest(range(0, len(embedding))) AS dim, unnest(embedding) AS v, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE 1.0 END AS m FROM embeddings)
SELECT label, CAST(dim AS INTEGER) AS dim, round(sum(CAST(v AS DOUBLE) * m) / greatest(sum(m), 1e-9), 6) AS v FROM e GROUP BY label, dim
""")
def mean_pooling(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").withColumn("m", (F.col("vec_id") % 3 != 0).cast("int"))
    return retrieval.mean_pool(rows, "label", "embedding", "m").select("label", F.posexplode("vec").alias("dim", "v")).select("label", "dim", F.round("v", 6).alias("v"))


@query("SELECT count(*) AS n, max(len(embedding)) AS dim, min(len(embedding)) AS least, min(vec_id) AS first_id FROM embeddings")
def vector_index_facts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.size("embedding")
    return table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n"), F.max(n).cast("long").alias("dim"), F.min(n).cast("long").alias("least"), F.min("vec_id").alias("first_id"))


_CHUNK = """
WITH s AS (SELECT doc_id, text, unnest(CASE WHEN length(text) > 0 THEN range(0, CAST(greatest(1, ceil((length(text) - {o}) / CAST({z} - {o} AS DOUBLE))) AS BIGINT)) ELSE [] END) AS chunk FROM documents)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, length(substr(text, chunk * ({z} - {o}) + 1, {z})) AS n, md5(substr(text, chunk * ({z} - {o}) + 1, {z})) AS digest FROM s
"""


def _chunked(spark: SparkSession, sf: str, size: int, overlap: int) -> DataFrame:
    got = retrieval.chunks(table(spark, sf, "documents"), size, overlap)
    return got.select("doc_id", "chunk", F.length("content").cast("long").alias("n"), F.md5("content").alias("digest"))


@query(_CHUNK.format(z=1000, o=200))
def chunks_1000_200(spark: SparkSession, sf: str) -> DataFrame:
    return _chunked(spark, sf, 1000, 200)


@query(_CHUNK.format(z=3000, o=1000))
def chunks_3000_1000(spark: SparkSession, sf: str) -> DataFrame:
    return _chunked(spark, sf, 3000, 1000)


_BLOCKS_SQL = """b AS (SELECT doc_id, i AS block, lines[i + 1] AS content, lines[i + 1] LIKE '%. %' AS flag FROM (SELECT doc_id, lines, unnest(range(0, len(lines))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)))"""


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text is not null")
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("block", "content"))
    return each.withColumn("flag", F.contains("content", F.lit(". ")))


@query(f"""WITH {_BLOCKS_SQL}
SELECT doc_id, CAST(block AS INTEGER) AS block, md5(concat_ws(chr(10), coalesce(lag(content) OVER w, ''), content, coalesce(lead(content) OVER w, ''))) AS digest FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY block)""")
def neighbour_context(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.neighbours(_blocks(spark, sf), ["doc_id"], "block").select("doc_id", "block", F.md5("context").alias("digest"))


@query(f"""WITH {_BLOCKS_SQL},
c AS (SELECT *, CASE WHEN flag IS DISTINCT FROM lag(flag) OVER (PARTITION BY doc_id ORDER BY block) OR row_number() OVER (PARTITION BY doc_id ORDER BY block) = 1 THEN 1 ELSE 0 END AS new FROM b),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY block) AS island FROM c)
SELECT doc_id, CAST(island AS BIGINT) AS island, bool_and(flag) AS flag, count(*) AS n, CAST(min(block) AS INTEGER) AS first_block, md5(string_agg(content, chr(10) ORDER BY block)) AS digest FROM i GROUP BY doc_id, island""")
def merge_islands(spark: SparkSession, sf: str) -> DataFrame:
    got = retrieval.islands(_blocks(spark, sf), ["doc_id"], "block", "flag")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "content"))), lambda x: x["content"]), "\n")
    return got.groupBy("doc_id", "island").agg(F.every("flag").alias("flag"), F.count(F.lit(1)).alias("n"), F.min("block").alias("first_block"), F.md5(joined).alias("digest"))


@query(f"""WITH {_BLOCKS_SQL} SELECT doc_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block) AS r FROM b) WHERE r > 1 GROUP BY doc_id""")
def drop_first_block(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("block")
    return _blocks(spark, sf).withColumn("r", F.row_number().over(w)).where("r > 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


_OPS = ("|->", "|=>", "##", "$rose", "$past", "until", "s_eventually", "always", "s_always", "not")
_OPS_SQL = "ops(op) AS (VALUES " + ", ".join(f"('{o}')" for o in _OPS) + ")"

# ---------------------------------------------------------------- assertions from templates

#: expressions that both engines read alike
_BODY = """CASE l_linenumber % 7 WHEN 0 THEN 'req_' || CAST(l_suppkey % 7 AS STRING) || ' |-> ##2 ack_b' WHEN 1 THEN '(a && !b) !== 1''b1'
 WHEN 2 THEN '$rose(a) |=> $past(b, ' || CAST(l_partkey % 3 + 1 AS STRING) || ')' WHEN 3 THEN 'a ##[1:3] b |-> s_eventually c'
 WHEN 4 THEN '(a until b) and not p' || CAST(l_partkey % 11 AS STRING) WHEN 5 THEN 'a' ELSE 'a || (b' END"""
_SVA = f"""'asrt_' || CAST(l_linenumber AS STRING) || ': assert property (@(posedge clk) disable iff (tb_reset) ' || {_BODY} || ');'"""
_RESPONSE = """CASE l_partkey % 6 WHEN 0 THEN 'pre</think>' || chr(10) || '```systemverilog' || chr(10) || {s} || chr(10) || '```' || chr(10)
 WHEN 1 THEN {s} WHEN 2 THEN '```systemverilog' || chr(10) || 'x' || chr(10) || '```' || chr(10) || 'so' || chr(10) || '```systemverilog' || chr(10) || {s} || chr(10) || '```'
 WHEN 3 THEN 'open</think>' || chr(10) || '```systemverilog' || chr(10) || {s} WHEN 4 THEN '</think>' || chr(10) || '```verilog' || chr(10) || 'assign x = 1;' || chr(10) || '```'
 ELSE '' END"""
_LINES_SQL = f"v AS (SELECT l_orderkey * 10 + l_linenumber AS idx, l_partkey % 2 = 0 AS flag, sva, {_RESPONSE.format(s='sva')} AS response FROM (SELECT *, {_SVA} AS sva FROM lineitem))"


def _assertions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as idx", "l_partkey % 2 = 0 as flag", "l_partkey", f"{_SVA} as sva")
    return rows.selectExpr("idx", "flag", "sva", f"{_RESPONSE.format(s='sva')} as response")


@query(f"""WITH {_LINES_SQL},
f AS (SELECT idx, CASE WHEN strpos(response, '</think>') > 0 THEN trim(regexp_extract(substr(response, strpos(response, '</think>') + 8), '(?s)```[A-Za-z]*\\n(.*?)```', 1), ' ' || chr(10)) END AS body FROM v)
SELECT idx, CASE WHEN body LIKE '%assert property%' THEN body END AS answer FROM f""")
def final_answers(spark: SparkSession, sf: str) -> DataFrame:
    return _assertions(spark, sf).select("idx", X.final_answer("response").alias("answer"))


@query(f"""WITH {_LINES_SQL}
SELECT idx, CASE WHEN response LIKE '%```systemverilog%' THEN trim(string_split(string_split(response, '```systemverilog')[-1], '```')[1], ' ' || chr(10)) END AS last_sva,
 nullif(trim(regexp_extract(response, '(?s)```[A-Za-z]*\\n(.*?)```', 1), ' ' || chr(10)), '') AS first_sva FROM v""")
def fenced_code(spark: SparkSession, sf: str) -> DataFrame:
    return _assertions(spark, sf).select("idx", X.last_fence("response").alias("last_sva"), X.first_fence("response").alias("first_sva"))


@query(f"""WITH {_LINES_SQL}
SELECT idx, trim(rtrim(trim(regexp_replace(regexp_replace(sva, '^\\s*[A-Za-z_]\\w*\\s*:\\s*', ''), '\\s+', ' ', 'g')), ';')) AS normal,
 trim(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(sva, '^\\w+\\s*:\\s*assert', 'assert'), '^assert\\s+property\\s*\\(', ''), '@\\s*\\(\\s*(posedge|negedge)\\s+\\w+\\s*\\)', '', 'g'), 'disable\\s+iff\\s*\\([^)]*\\)', '', 'g'), '\\)\\s*;')[1]) AS body FROM v""")
def normalized_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return _assertions(spark, sf).select("idx", X.normalize("sva").alias("normal"), X.property_body("sva").alias("body"))


@query(f"""WITH {_LINES_SQL},
s AS (SELECT idx, CASE WHEN response NOT LIKE '%```%' THEN 'no_sva' WHEN len(regexp_extract_all(response, 'assert\\s+property')) <> 1 THEN 'multi_property' WHEN sva LIKE '%|| (b);' THEN 'parse_fail' ELSE 'eligible' END AS status FROM v)
SELECT status, count(*) AS n FROM s GROUP BY status""")
def eligibility(spark: SparkSession, sf: str) -> DataFrame:
    rows = _assertions(spark, sf)
    status = (
        F.when(~F.contains("response", F.lit(X.FENCE)), "no_sva").when(X.assertion_count("response") != 1, "multi_property").when(F.endswith("sva", F.lit("|| (b);")), "parse_fail").otherwise("eligible")
    )
    return rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_LINES_SQL},
i AS (SELECT flag, CASE WHEN regexp_matches(sva, '!==\\s*1''b1') THEN 'negated_conj' WHEN regexp_matches(sva, '\\|->|\\|=>') THEN 'implication' ELSE 'other' END AS idiom FROM v),
spine(idiom) AS (VALUES ('negated_conj'), ('implication'), ('other'), ('unseen')),
c AS (SELECT idiom, count(*) AS n FROM i GROUP BY idiom)
SELECT spine.idiom AS idiom, coalesce(n, 0) AS n FROM spine LEFT JOIN c ON spine.idiom = c.idiom""")
def idiom_histogram(spark: SparkSession, sf: str) -> DataFrame:
    spine = spark.createDataFrame([(x,) for x in ("negated_conj", "implication", "other", "unseen")], "idiom string")
    return curate.histogram(_assertions(spark, sf).withColumn("idiom", X.idiom("sva")), "idiom", spine)


@query(f"""WITH {_LINES_SQL},
r AS (SELECT CASE WHEN flag THEN 'truncated' WHEN response NOT LIKE '%```%' THEN 'no_fence' ELSE 'other' END AS reason, idx, sva FROM v),
n AS (SELECT reason, count(*) AS n FROM r GROUP BY reason),
x AS (SELECT reason, array_to_string(list(sva ORDER BY idx, sva), '|') AS examples FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY idx, sva) AS k FROM r) WHERE k <= 3 GROUP BY reason)
SELECT n.reason AS reason, n, examples FROM n JOIN x ON n.reason = x.reason""")
def failure_examples(spark: SparkSession, sf: str) -> DataFrame:
    rows = _assertions(spark, sf).withColumn("reason", X.failure_reason("response", "flag"))
    return curate.examples(rows, "reason", "idx", "sva", 3).select("reason", "n", F.array_join("examples", "|").alias("examples"))


@query(f"""WITH {_LINES_SQL} SELECT sva LIKE '%$past%' AS past, count(*) AS n, count(DISTINCT sva) AS texts FROM v GROUP BY 1 ORDER BY n DESC LIMIT 10""")
def failure_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    rows = _assertions(spark, sf).withColumn("past", F.contains("sva", F.lit("$past")))
    top = curate.taxonomy(rows, "past", 10)
    return top.join(rows.groupBy("past").agg(F.countDistinct("sva").alias("texts")), "past")


@query(f"""WITH {_LINES_SQL}, {_OPS_SQL},
hit AS (SELECT op, idx, sva FROM v JOIN ops ON contains(sva, op))
SELECT op, count(*) AS occurrences, count(DISTINCT idx) AS containing, arg_min(sva, (length(sva), idx, sva)) AS example FROM hit GROUP BY op""")
def operator_census(spark: SparkSession, sf: str) -> DataFrame:
    ops = F.broadcast(spark.createDataFrame([(o,) for o in _OPS], "op string"))
    hits = retrieval.contains_join(_assertions(spark, sf), "sva", ops, "op", keep=["idx", "sva"]).withColumn("pos", F.lit(0))
    return curate.census(hits, "op", "idx", "pos", "sva")


@query(f"""WITH {_LINES_SQL}, {_OPS_SQL}
SELECT op, count(DISTINCT idx) AS containing FROM (SELECT idx, unnest(string_split(sva, ' ')) AS tok FROM v) t JOIN ops ON tok = op GROUP BY op""")
def operator_tokens(spark: SparkSession, sf: str) -> DataFrame:
    ops = F.broadcast(spark.createDataFrame([(o,) for o in _OPS], "op string"))
    return retrieval.contains_join(_assertions(spark, sf), "sva", ops, "op", exact=True).groupBy("op").agg(F.countDistinct("idx").alias("containing"))


@query(f"""WITH {_LINES_SQL}, {_OPS_SQL} SELECT op, coalesce(sum(CASE WHEN contains(sva, op) THEN 1 ELSE 0 END), 0) AS n FROM ops, v GROUP BY op""")
def keyword_census(spark: SparkSession, sf: str) -> DataFrame:
    counted = _assertions(spark, sf).agg(*[F.coalesce(F.sum(F.contains("sva", F.lit(o)).cast("long")), F.lit(0)).alias(f"c{i}") for i, o in enumerate(_OPS)])
    pairs = F.array(*[F.struct(F.lit(o).alias("op"), F.col(f"c{i}").alias("n")) for i, o in enumerate(_OPS)])
    return counted.select(F.explode(pairs).alias("x")).select("x.op", "x.n")


@query(f"""WITH {_LINES_SQL} SELECT idx, array_to_string(list_distinct_ordered, ',') AS signals FROM (
 SELECT idx, list_transform(list_sort(list_transform(map_entries(first_at), lambda e: {{'spot': e.value, 'name': e.key}})), lambda x: x.name) AS list_distinct_ordered FROM (
 SELECT idx, sva, map_from_entries(list({{'k': name, 'v': spot}})) AS first_at FROM (
 SELECT idx, sva, name, min(i) AS spot FROM (SELECT idx, sva, unnest(n) AS name, unnest(range(0, len(n))) AS i FROM (SELECT DISTINCT idx, sva, regexp_extract_all(sva, '([$\\w'']+)', 1) AS n FROM v)) WHERE regexp_full_match(name, '[A-Za-z_]\\w*') GROUP BY idx, sva, name) GROUP BY idx, sva))""")
def signal_lists(spark: SparkSession, sf: str) -> DataFrame:
    return _assertions(spark, sf).select("idx", "sva").distinct().select("idx", F.array_join(X.signal_names("sva"), ",").alias("signals"))


_TURN = """CASE l_linenumber % 5 WHEN 0 THEN 'no fence' WHEN 1 THEN ' why' || CAST(l_suppkey % 9 AS STRING) || chr(10) || chr(10) || '```sv' || chr(10) || 'x' || chr(10) || '```' || chr(10) || 'so' || chr(10) || '```sv' || chr(10) || 'a' || chr(10) || '```' || chr(10) WHEN 2 THEN ' ' || chr(10) || '```sv' || chr(10) || 'a' || chr(10) || '```' WHEN 3 THEN 'why ```sv a' ELSE 'first ```c' || chr(10) || 'b' || chr(10) || '```' || chr(10) || '```sv' || chr(10) || 'a```' END"""


@query(f"""WITH t AS (SELECT {_TURN.replace('AS STRING', 'AS VARCHAR')} AS t FROM lineitem),
p AS (SELECT t, regexp_extract(t, '(?s)^(.*)```sv', 1) AS before, trim('```sv' || string_split(t, '```sv')[-1], ' ' || chr(10)) AS code, contains(t, '```sv') AS has FROM t),
r AS (SELECT *, trim(before, ' ' || chr(10)) AS why FROM p),
j AS (SELECT *, CASE WHEN NOT has THEN 'no_fence' WHEN why = '' THEN 'empty_reasoning' WHEN NOT ends_with(code, '```') THEN 'unclosed' END AS reason FROM r)
SELECT reason IS NULL AS ok, reason, CASE WHEN reason IS NULL THEN '<think>' || chr(10) || why || chr(10) || '</think>' || chr(10) || chr(10) || code END AS turn, count(*) AS n FROM j GROUP BY ALL""")
def think_dataset(spark: SparkSession, sf: str) -> DataFrame:
    made = table(spark, sf, "lineitem").selectExpr(f"{_TURN} as t").select(X.think_turn("t", "sv").alias("x"))
    return made.groupBy("x.ok", "x.reason", F.col("x.text").alias("turn")).agg(F.count(F.lit(1)).alias("n"))


_MODULE = """'module m' || CAST(l_suppkey AS STRING) || '(input a);' || chr(10) || ' wire x;' || chr(10) || 'endmodule' || chr(10) || 'module n' || CAST(l_linenumber AS STRING) || ';' || chr(10) || ' assign y = a;' || chr(10) || 'endmodule' || chr(10)"""


@query(f"""WITH m AS (SELECT l_orderkey * 10 + l_linenumber AS idx, l_suppkey, l_linenumber FROM lineitem)
SELECT idx, 'module n' || l_linenumber || ';' || chr(10) || ' assign y = a;' || chr(10) || 'endmodule' AS last_module, 'm' || l_suppkey AS name,
 'module m' || l_suppkey || '(input a);' || chr(10) || ' wire x;' || chr(10) || 'endmodule' || chr(10) || 'module n' || l_linenumber || ';' || chr(10) || ' assign y = a;' || chr(10) || 'PROBE endmodule' || chr(10) AS marked_last,
 'module m' || l_suppkey || '(input a);' || chr(10) || ' wire x;' || chr(10) || 'PROBE endmodule' || chr(10) || 'module n' || l_linenumber || ';' || chr(10) || ' assign y = a;' || chr(10) || 'endmodule' || chr(10) AS marked_first,
 'module m' || l_suppkey || '(input a);' || chr(10) || ' wire x;' || chr(10) || 'endmodule' || chr(10) || 'module n' || l_linenumber || ';' || chr(10) || ' assign y = a;' || chr(10) AS opened FROM m""")
def module_edits(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as idx", f"{_MODULE} as m")
    return rows.select("idx", X.last_module("m").alias("last_module"), X.module_name("m").alias("name"), X.before_last("m", "endmodule", "PROBE ").alias("marked_last"), X.before_first("m", "endmodule", "PROBE ").alias("marked_first"), X.drop_last_line("m", "endmodule").alias("opened"))


@query("""WITH t AS (SELECT p_partkey, '1. ' || p_name || chr(10) || 'noise' || chr(10) || '2.  ' || p_brand AS t, '(a) ' || p_brand || ' (b) x (a) ' || p_type AS f, CASE p_size % 4 WHEN 0 THEN '[''a'', ''b'']' WHEN 1 THEN 'a, b,' WHEN 2 THEN '' ELSE '["clk"]' END AS s FROM part)
SELECT p_partkey, (SELECT string_agg(p_name2, '|') FROM (SELECT unnest([trim(split_part(split_part(t, chr(10), 1), '. ', 2)), trim(split_part(split_part(t, chr(10), 3), '. ', 2))]) AS p_name2)) AS items,
 trim(string_split(f, '(a) ')[3]) AS field_a, 'x' AS field_b, CASE WHEN s = '' THEN '' WHEN s LIKE '%clk%' THEN 'clk' ELSE 'a|b' END AS signals FROM t""")
def labeled_text(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size") % 4
    rows = table(spark, sf, "part").select(
        "p_partkey",
        F.concat(F.lit("1. "), "p_name", F.lit("\nnoise\n2.  "), "p_brand").alias("t"),
        F.concat(F.lit("(a) "), "p_brand", F.lit(" (b) x (a) "), "p_type").alias("f"),
        F.when(size == 0, "['a', 'b']").when(size == 1, "a, b,").when(size == 2, "").otherwise('["clk"]').alias("s"),
    )
    fields = X.labeled_fields("f")
    return rows.select("p_partkey", F.array_join(X.numbered_items("t"), "|").alias("items"), fields["a"].alias("field_a"), fields["b"].alias("field_b"), F.array_join(X.signal_list("s"), "|").alias("signals"))


@query("""SELECT page_id, length(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped, right(html, 500) AS tail,
 regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links FROM pages""")
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", F.length(X.html_escape("html")).cast("long").alias("escaped"), X.tail("html", 500).alias("tail"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long").alias("links")
    )


@query(f"""WITH {_LINES_SQL}, c AS (SELECT idx, {' + '.join(f"CAST(regexp_matches(sva, '{p}') AS INTEGER)" for p in X.CODE_PATTERNS)} AS n, {' OR '.join(f"regexp_matches(sva, '{p}')" for p in X.PROSE_PATTERNS)} AS prose, {' + '.join(f"CAST(regexp_matches(sva, '{p}') AS INTEGER)" for p in X.ASSERTION_PATTERNS)} AS sure FROM v)
SELECT idx, n AS hits, prose, sure >= 2 OR n >= 2 OR (n >= 1 AND NOT prose) AS code, CASE WHEN sure >= 2 OR n >= 2 OR (n >= 1 AND NOT prose) THEN 'code' ELSE 'text' END AS store FROM c""")
def code_or_prose(spark: SparkSession, sf: str) -> DataFrame:
    code = X.is_code("sva")
    return _assertions(spark, sf).select("idx", X.pattern_hits("sva").alias("hits"), X.is_prose("sva").alias("prose"), code.alias("code"), F.when(code, "code").otherwise("text").alias("store"))


# ---------------------------------------------------------------- reports

_REPORT = """'[' || CAST(l_orderkey AS STRING) || ']  d' || CAST(l_suppkey % 20 AS STRING) || '._assert_' || CAST(l_linenumber AS STRING) || CASE WHEN l_partkey % 5 = 0 THEN ':precondition1' ELSE '' END || '   ' || CASE l_partkey % 3 WHEN 0 THEN 'proven' WHEN 1 THEN 'cex' ELSE 'covered' END || '  Tri  Infinite  ' || CAST(l_linenumber AS STRING) || '.5 s'"""
_REPORT_SQL = "r AS (SELECT l_orderkey, l_linenumber, 'd' || CAST(l_suppkey % 20 AS VARCHAR) AS module, CASE l_partkey % 3 WHEN 0 THEN 'proven' WHEN 1 THEN 'cex' ELSE 'covered' END AS result, l_linenumber + 0.5 AS seconds FROM lineitem WHERE l_partkey % 5 <> 0)"


def _report(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_REPORT).alias("line"))
    return rows.select("l_orderkey", "l_linenumber", X.report_row("line").alias("r")).where("r is not null").select("l_orderkey", "l_linenumber", "r.*")


@query(f"WITH {_REPORT_SQL} SELECT module, result, count(*) AS n, CAST(sum(seconds) AS DOUBLE) AS seconds FROM r GROUP BY module, result")
def proof_reports(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf).groupBy("module", "result").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("seconds"))


@query(f"""WITH {_REPORT_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY l_orderkey, l_linenumber, result) - 1 AS pos FROM r)
SELECT module, CAST(floor((count(*) - 10) / 2.0) AS BIGINT) AS sc, count(*) FILTER (pos >= 10 AND (pos - 10) % 2 = 0 AND result = 'proven') AS fc, count(*) FILTER (pos >= 10 AND (pos - 10) % 2 = 1 AND result = 'proven') AS fm FROM p GROUP BY module""")
def design_metrics(spark: SparkSession, sf: str) -> DataFrame:
    golden = 10
    rows = curate.numbered(_report(spark, sf), "l_orderkey", ("module",), ("l_linenumber", "result")).withColumn("pos", F.col("n") - 1)
    good = (F.col("pos") >= golden) & (F.col("result") == "proven")
    odd = F.pmod(F.col("pos") - golden, F.lit(2))
    return rows.groupBy("module").agg(F.floor((F.count(F.lit(1)) - golden) / 2).alias("sc"), F.count_if(good & (odd == 0)).alias("fc"), F.count_if(good & (odd == 1)).alias("fm"))


@query(f"""WITH {_REPORT_SQL} SELECT module, count(*) FILTER (result = 'proven') AS proven, count(*) FILTER (result = 'cex') AS cex, count(*) FILTER (result = 'covered') AS covered FROM r GROUP BY module""")
def metric_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf).groupBy("module").pivot("result", ["proven", "cex", "covered"]).count().na.fill(0)


@query("""WITH m AS (SELECT l_returnflag AS method, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT method, status, n, (n - first_value(n) OVER w) * 100.0 / first_value(n) OVER w AS gain FROM m WINDOW w AS (PARTITION BY status ORDER BY method)""")
def gain_over_baseline(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    base = F.first("n").over(Window.partitionBy("status").orderBy("method"))
    return m.withColumn("gain", (F.col("n") - base) * F.lit(100.0) / base)


@query("""SELECT source, count(*) AS n, coalesce(sum(quality), 0)::BIGINT AS n_quality, sum(quality) * 1.0 / count(*) AS rate_quality, coalesce(sum(toxic), 0)::BIGINT AS n_toxic, sum(toxic) * 1.0 / count(*) AS rate_toxic
FROM labels JOIN documents USING (doc_id) GROUP BY source""")
def metric_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return curate.rates(rows, ["quality", "toxic"], ["source"])


@query("""SELECT doc_id, greatest(quality, toxic) AS relaxed, CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END AS strict FROM labels""")
def strict_and_relaxed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select("doc_id", F.greatest("quality", "toxic").alias("relaxed"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("strict"))


# ---------------------------------------------------------------- curation joins


@query("SELECT doc_id, source FROM (SELECT doc_id, source FROM documents ORDER BY md5('0:' || doc_id), doc_id LIMIT 200)")
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    return curate.sample_n(table(spark, sf, "documents").select("doc_id", "source"), 200, "doc_id", 0)


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    return curate.resume(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id")


@query("""WITH f AS (SELECT doc_id AS slot, row_number() OVER (ORDER BY doc_id) AS n FROM labels WHERE quality = 0),
p AS (SELECT doc_id AS resolved, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT slot, resolved FROM f LEFT JOIN p USING (n)""")
def backfill_slots(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    return curate.backfill(labels.where("quality = 0"), table(spark, sf, "documents"), labels, "doc_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def checkpoint_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return curate.last_wins(table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("""WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS n FROM part), b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier)
SELECT p_partkey, s_suppkey FROM a LEFT JOIN b USING (n)""")
def positional_zip(spark: SparkSession, sf: str) -> DataFrame:
    a = curate.numbered(table(spark, sf, "part").select("p_partkey"), "p_partkey")
    b = curate.numbered(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey")
    return a.join(b, "n", "left").select("p_partkey", "s_suppkey")


@query("""SELECT coalesce(a.user_id, b.user_id) AS user_id, a.n AS clicks, b.n AS buys FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) a
FULL OUTER JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) b ON a.user_id = b.user_id""")
def side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    part = lambda kind, name: ev.where(F.col("event_type") == kind).groupBy("user_id").agg(F.count(F.lit(1)).alias(name))
    return part("click", "clicks").join(part("purchase", "buys"), "user_id", "full")


@query("""SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS chat, count(*) AS n FROM conversations GROUP BY conv_id""")
def chat_records(spark: SparkSession, sf: str) -> DataFrame:
    each = F.struct("turn", F.concat("role", F.lit(": "), "text").alias("t"))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["t"]), "\n").alias("chat"), F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("lang", "source").distinct()


@query("SELECT o_custkey AS user_key FROM orders WHERE o_totalprice > 100000 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn("user_key", F.col("o_custkey"))
    return orders.where("o_totalprice > 100000").select("user_key").subtract(orders.where("o_orderstatus = 'F'").select("user_key"))


# ---------------------------------------------------------------- temporal operators

_TRACE_SQL = """tr AS (SELECT user_id AS trace_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tick, event_type IN ('click', 'view') AS a, event_type IN ('purchase', 'click') AS b,
 event_type <> 'error' AS g, event_type = 'signup' AS r, CAST(floor(value) AS BIGINT) % 4 AS d FROM events)"""


def _trace(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("trace_id"), (F.row_number().over(w) - 1).cast("long").alias("tick"), kind.isin("click", "view").alias("a"), kind.isin("purchase", "click").alias("b"), (kind != "error").alias("g"), (kind == "signup").alias("r"), (F.floor("value") % 4).alias("d")
    )


@query(f"""WITH {_TRACE_SQL} SELECT trace_id, tick, a AS sampled, a AND NOT coalesce(lag(a) OVER w, FALSE) AS rose, NOT a AND coalesce(lag(a) OVER w, FALSE) AS fell,
 d = coalesce(lag(d) OVER w, 0) AS stable, d <> coalesce(lag(d) OVER w, 0) AS changed, lag(d, 2, 0) OVER w AS past2 FROM tr WINDOW w AS (PARTITION BY trace_id ORDER BY tick)""")
def sampled_values(spark: SparkSession, sf: str) -> DataFrame:
    return _trace(spark, sf).select("trace_id", "tick", E.sampled("a").alias("sampled"), E.rose("a").alias("rose"), E.fell("a").alias("fell"), E.stable("d", 0).alias("stable"), E.changed("d", 0).alias("changed"), E.past("d", 2, 0).alias("past2"))


@query(f"""WITH {_TRACE_SQL} SELECT t.trace_id, t.tick, coalesce((SELECT list(u.d ORDER BY u.tick DESC)[2] FROM tr u WHERE u.trace_id = t.trace_id AND u.tick < t.tick AND u.g), 0) AS past FROM tr t""")
def gated_past(spark: SparkSession, sf: str) -> DataFrame:
    return E.past_gated(_trace(spark, sf), "d", 2, "g", "past", 0).select("trace_id", "tick", F.coalesce("past", F.lit(0)).alias("past"))


_PAIRS = "x AS (SELECT t.trace_id, t.tick, u.tick - t.tick AS k, u.a AS a, u.b AS b FROM tr t JOIN tr u ON t.trace_id = u.trace_id AND u.tick >= t.tick)"


@query(f"""WITH {_TRACE_SQL}, {_PAIRS} SELECT trace_id, tick, bool_and(a) AS always_p, bool_or(a) AS eventually_p, coalesce(bool_and(a) FILTER (k BETWEEN 2 AND 4), TRUE) AS always_24,
 coalesce(bool_and(a) FILTER (k BETWEEN 2 AND 4), TRUE) AND count(*) FILTER (k BETWEEN 2 AND 4) = 3 AS s_always_24, coalesce(bool_or(a) FILTER (k BETWEEN 2 AND 4), FALSE) OR count(*) FILTER (k BETWEEN 2 AND 4) < 3 AS eventually_24,
 coalesce(bool_or(a) FILTER (k BETWEEN 2 AND 4), FALSE) AS s_eventually_24, coalesce(bool_and(a) FILTER (k = 1), TRUE) AS nexttime_1, coalesce(bool_and(a) FILTER (k = 1), FALSE) AS s_nexttime_1,
 coalesce(bool_and(a) FILTER (k = 3), TRUE) AS nexttime_3, coalesce(bool_and(a) FILTER (k = 3), FALSE) AS s_nexttime_3 FROM x GROUP BY trace_id, tick""")
def bounded_properties(spark: SparkSession, sf: str) -> DataFrame:
    return _trace(spark, sf).select(
        "trace_id", "tick", E.always("a").alias("always_p"), E.eventually("a").alias("eventually_p"), E.always_range("a", 2, 4).alias("always_24"), E.always_range("a", 2, 4, True).alias("s_always_24"), E.eventually_range("a", 2, 4).alias("eventually_24"),
        E.eventually_range("a", 2, 4, True).alias("s_eventually_24"), E.nexttime("a").alias("nexttime_1"), E.nexttime("a", 1, True).alias("s_nexttime_1"), E.nexttime("a", 3).alias("nexttime_3"), E.nexttime("a", 3, True).alias("s_nexttime_3"),
    )


@query(f"""WITH {_TRACE_SQL}, {_PAIRS}, m AS (SELECT trace_id, tick, min(k) FILTER (NOT a) AS nf, min(k) FILTER (b) AS nq FROM x GROUP BY trace_id, tick)
SELECT trace_id, tick, CASE WHEN nq IS NULL THEN nf IS NULL ELSE nf IS NULL OR nf >= nq END AS until_p, CASE WHEN nq IS NULL THEN FALSE ELSE nf IS NULL OR nf >= nq END AS s_until_p,
 CASE WHEN nq IS NULL THEN nf IS NULL ELSE nf IS NULL OR nf > nq END AS until_with_p, CASE WHEN nq IS NULL THEN FALSE ELSE nf IS NULL OR nf > nq END AS s_until_with_p FROM m""")
def until_family(spark: SparkSession, sf: str) -> DataFrame:
    return _trace(spark, sf).select("trace_id", "tick", E.until("a", "b").alias("until_p"), E.until("a", "b", True).alias("s_until_p"), E.until("a", "b", False, True).alias("until_with_p"), E.until("a", "b", True, True).alias("s_until_with_p"))


@query(f"""WITH {_TRACE_SQL} SELECT trace_id, tick, NOT a OR b AS implies_p, a = b AS iff_p, a AND b AS and_p, a OR b AS or_p FROM tr""")
def property_connectives(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _trace(spark, sf).select("trace_id", "tick", E.implies(a, b).alias("implies_p"), E.iff(a, b).alias("iff_p"), (a & b).alias("and_p"), (a | b).alias("or_p"))


def _delay(m: int, n: int) -> str:
    return f"s AS (SELECT DISTINCT t.trace_id, t.tick AS start, u.tick AS stop FROM tr t JOIN tr u ON t.trace_id = u.trace_id AND u.tick BETWEEN t.tick + {m} AND t.tick + {n} WHERE t.a AND u.b)"


@query(f'WITH {_TRACE_SQL}, {_delay(1, 3)} SELECT trace_id, start, stop AS "end" FROM s')
def sequence_delay(spark: SparkSession, sf: str) -> DataFrame:
    t = _trace(spark, sf)
    return E.concat(E.matches(t, "a"), E.matches(t, "b"), 1, 3)


@query(f"""WITH {_TRACE_SQL}, {_delay(1, 3)}, j AS (SELECT s.trace_id, start, u.a AS p0, v.a AS p1 FROM s JOIN tr u ON s.trace_id = u.trace_id AND u.tick = stop LEFT JOIN tr v ON s.trace_id = v.trace_id AND v.tick = stop + 1),
m AS (SELECT trace_id, start, bool_and(p0) AS o, bool_and(coalesce(p1, TRUE)) AS n, bool_or(p0) AS f, bool_or(coalesce(p1, FALSE)) AS fn FROM j GROUP BY 1, 2)
SELECT tr.trace_id, tick, coalesce(o, TRUE) AS overlapped, coalesce(n, TRUE) AS next_cycle, coalesce(f, FALSE) AS followed, coalesce(fn, FALSE) AS followed_next, m.start IS NOT NULL AS strong_s FROM tr LEFT JOIN m ON tr.trace_id = m.trace_id AND tick = m.start""")
def suffix_implication(spark: SparkSession, sf: str) -> DataFrame:
    t = _trace(spark, sf)
    s = E.concat(E.matches(t, "a"), E.matches(t, "b"), 1, 3)
    out = t
    for name, shift, followed in (("overlapped", 0, False), ("next_cycle", 1, False), ("followed", 0, True), ("followed_next", 1, True)):
        out = E.suffix(out, s, "a", name, shift, followed)
    return E.strong(out, s, "strong_s").select("trace_id", "tick", "overlapped", "next_cycle", "followed", "followed_next", "strong_s")


_RUNS = """p AS (SELECT t.trace_id, t.tick AS start, u.tick AS stop, u.tick - t.tick + 1 AS n FROM tr t JOIN tr u ON t.trace_id = u.trace_id AND u.tick >= t.tick WHERE NOT EXISTS (SELECT 1 FROM tr v WHERE v.trace_id = t.trace_id AND v.tick BETWEEN t.tick AND u.tick AND NOT v.a))"""


@query(f'WITH {_TRACE_SQL}, {_RUNS} SELECT trace_id, start, stop AS "end", n BETWEEN 2 AND 3 AS two_three, n >= 1 AS plus FROM p')
def sequence_repetition(spark: SparkSession, sf: str) -> DataFrame:
    t = _trace(spark, sf)
    some = E.repeat(t, "a", 2, 3).withColumn("two_three", F.lit(True))
    joined = E.repeat(t, "a", 1).join(some, ["trace_id", "start", "end"], "left")
    return joined.select("trace_id", "start", "end", F.coalesce("two_three", F.lit(False)).alias("two_three"), F.lit(True).alias("plus"))


_GOTO = """h AS (SELECT t.trace_id, t.tick AS start, u.tick AS hit, row_number() OVER (PARTITION BY t.trace_id, t.tick ORDER BY u.tick) AS k, lead(u.tick) OVER (PARTITION BY t.trace_id, t.tick ORDER BY u.tick) AS nxt FROM tr t JOIN tr u ON t.trace_id = u.trace_id AND u.tick >= t.tick WHERE u.b)"""


@query(f'WITH {_TRACE_SQL}, {_GOTO} SELECT trace_id, start, hit AS "end" FROM h WHERE k BETWEEN 2 AND 3')
def sequence_goto(spark: SparkSession, sf: str) -> DataFrame:
    return E.goto(_trace(spark, sf), "b", 2, 3)


@query(f"""WITH {_TRACE_SQL}, {_GOTO}, z AS (SELECT trace_id, max(tick) AS last FROM tr GROUP BY 1) SELECT DISTINCT h.trace_id, start, unnest(range(hit, coalesce(nxt - 1, last) + 1)) AS "end" FROM h JOIN z ON h.trace_id = z.trace_id WHERE k BETWEEN 2 AND 3""")
def sequence_nonconsecutive(spark: SparkSession, sf: str) -> DataFrame:
    return E.goto(_trace(spark, sf), "b", 2, 3, nonconsecutive=True)


@query(f"""WITH {_TRACE_SQL}, {_delay(1, 3)}, {_GOTO}, g2 AS (SELECT trace_id, start, hit AS stop FROM h WHERE k BETWEEN 1 AND 2),
i AS (SELECT s.trace_id, s.start, s.stop FROM s JOIN g2 ON s.trace_id = g2.trace_id AND s.start = g2.start AND s.stop = g2.stop),
f AS (SELECT trace_id, start, min(stop) AS stop FROM s GROUP BY 1, 2),
th AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM tr v WHERE v.trace_id = s.trace_id AND v.tick BETWEEN start AND stop AND NOT v.g)),
wi AS (SELECT DISTINCT s.* FROM s JOIN g2 ON s.trace_id = g2.trace_id AND g2.start >= s.start AND g2.stop <= s.stop),
di AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM tr v WHERE v.trace_id = s.trace_id AND v.tick BETWEEN start AND stop AND v.r)),
un AS (SELECT DISTINCT t.trace_id, t.tick AS start, u.tick AS stop FROM tr t JOIN tr u ON t.trace_id = u.trace_id AND u.tick >= t.tick + 1 WHERE t.a AND u.b)
SELECT 'intersect' AS op, count(*) AS n, CAST(sum(start * 31 + stop) AS BIGINT) AS mark FROM i UNION ALL SELECT 'first_match', count(*), CAST(sum(start * 31 + stop) AS BIGINT) FROM f UNION ALL SELECT 'throughout', count(*), CAST(sum(start * 31 + stop) AS BIGINT) FROM th
UNION ALL SELECT 'within', count(*), CAST(sum(start * 31 + stop) AS BIGINT) FROM wi UNION ALL SELECT 'disable_iff', count(*), CAST(sum(start * 31 + stop) AS BIGINT) FROM di UNION ALL SELECT 'delay_unbounded', count(*), CAST(sum(start * 31 + stop) AS BIGINT) FROM un""")
def sequence_algebra(spark: SparkSession, sf: str) -> DataFrame:
    t = _trace(spark, sf)
    s, g = E.concat(E.matches(t, "a"), E.matches(t, "b"), 1, 3), E.goto(t, "b", 1, 2)
    sets = {"intersect": E.intersect(s, g), "first_match": E.first_match(s), "throughout": E.throughout(t, "g", s), "within": E.within(g, s), "disable_iff": E.disable_iff(t, s, "r"), "delay_unbounded": E.concat_unbounded(E.matches(t, "a"), E.matches(t, "b"), 1)}
    out = None
    for name, found in sets.items():
        row = found.agg(F.lit(name).alias("op"), F.count(F.lit(1)).alias("n"), F.sum(F.col("start") * 31 + F.col("end")).alias("mark"))
        out = row if out is None else out.unionAll(row)
    return out


# ---------------------------------------------------------------- trees


@query(f"""WITH {_LINES_SQL} SELECT CASE WHEN sva LIKE '%|| (b);' THEN 'error' ELSE 'ok' END AS status, count(*) AS n FROM v GROUP BY 1""")
def parser_coverage(spark: SparkSession, sf: str) -> DataFrame:
    got = sva.trees(_assertions(spark, sf), "idx", "sva")
    return got.groupBy(F.substring_index("status", ":", 1).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_LINES_SQL}, o AS (SELECT CASE idx % 10 % 7 WHEN 0 THEN ['|->', '##2'] WHEN 1 THEN ['!==', '&&', '!'] WHEN 2 THEN ['|=>', '$rose', '$past'] WHEN 3 THEN ['|->', '##[1:3]', 's_eventually'] WHEN 4 THEN ['and', 'until', 'not'] ELSE [] END AS ops FROM v)
SELECT label, count(*) AS n FROM (SELECT unnest(ops) AS label FROM o) GROUP BY label""")
def tree_operators(spark: SparkSession, sf: str) -> DataFrame:
    texts = _assertions(spark, sf).groupBy("sva").agg(F.count(F.lit(1)).alias("n"))
    got = sva.nodes(texts.withColumn("one", F.lit(1)), "n", "sva", ("type", "label"))
    return got.where("type = 'operator'").groupBy("label").agg(F.sum("key").alias("n"))


#: nodes of the seven assertion shapes: shape, node_id, parent_id, child_pos, preorder, type, label, code; R, P and Q stand for a row's numbers
_NODE_ROWS = """(0, 4, NULL, 0, 1, 'operator', '|->', 'req_R |-> (##2 ack_b)'), (0, 1, 4, 0, 2, 'signal', 'req_R', 'req_R'), (0, 3, 4, 1, 3, 'operator', '##2', '##2 ack_b'), (0, 2, 3, 0, 4, 'signal', 'ack_b', 'ack_b'),
(1, 6, NULL, 0, 1, 'operator', '!==', '(a && !b) !== 1''b1'), (1, 4, 6, 0, 2, 'operator', '&&', 'a && !b'), (1, 1, 4, 0, 3, 'signal', 'a', 'a'), (1, 3, 4, 1, 4, 'operator', '!', '!b'), (1, 2, 3, 0, 5, 'signal', 'b', 'b'), (1, 5, 6, 1, 6, 'signal', '1''b1', '1''b1'),
(2, 6, NULL, 0, 1, 'operator', '|=>', '$rose(a) |=> $past(b, P)'), (2, 2, 6, 0, 2, 'operator', '$rose', '$rose(a)'), (2, 1, 2, 0, 3, 'signal', 'a', 'a'), (2, 5, 6, 1, 4, 'operator', '$past', '$past(b, P)'), (2, 3, 5, 0, 5, 'signal', 'b', 'b'), (2, 4, 5, 1, 6, 'signal', 'P', 'P'),
(3, 6, NULL, 0, 1, 'operator', '|->', '(a ##[1:3] b) |-> (s_eventually c)'), (3, 3, 6, 0, 2, 'operator', '##[1:3]', 'a ##[1:3] b'), (3, 1, 3, 0, 3, 'signal', 'a', 'a'), (3, 2, 3, 1, 4, 'signal', 'b', 'b'), (3, 5, 6, 1, 5, 'operator', 's_eventually', 's_eventually c'), (3, 4, 5, 0, 6, 'signal', 'c', 'c'),
(4, 6, NULL, 0, 1, 'operator', 'and', '(a until b) and (not pQ)'), (4, 3, 6, 0, 2, 'operator', 'until', 'a until b'), (4, 1, 3, 0, 3, 'signal', 'a', 'a'), (4, 2, 3, 1, 4, 'signal', 'b', 'b'), (4, 5, 6, 1, 5, 'operator', 'not', 'not pQ'), (4, 4, 5, 0, 6, 'signal', 'pQ', 'pQ'),
(5, 1, NULL, 0, 1, 'signal', 'a', 'a')"""
_FILL = lambda x: f"replace(replace(replace({x}, 'req_R', 'req_' || r), 'b, P', 'b, ' || p), 'pQ', 'p' || q)"
_SHAPES_SQL = f"""nt(shape, node_id, parent_id, child_pos, preorder, type, label, code) AS (VALUES {_NODE_ROWS}),
sh AS (SELECT l_orderkey * 10 + l_linenumber AS key, {_SVA.replace('AS STRING', 'AS VARCHAR')} AS sva, l_linenumber % 7 AS shape, l_suppkey % 7 AS r, l_partkey % 3 + 1 AS p, l_partkey % 11 AS q FROM lineitem),
nd AS (SELECT key, sva, sh.shape AS shape, node_id, parent_id, child_pos, preorder, type, CASE label WHEN 'req_R' THEN 'req_' || r WHEN 'P' THEN '' || p WHEN 'pQ' THEN 'p' || q ELSE label END AS label, CASE code WHEN 'P' THEN '' || p ELSE {_FILL('code')} END AS code FROM sh JOIN nt ON sh.shape = nt.shape)"""


@query(f"""WITH {_SHAPES_SQL}
SELECT key, 'ok' AS status, CAST(node_id AS INTEGER) AS node_id, CAST(parent_id AS INTEGER) AS parent_id, CAST(child_pos AS INTEGER) AS child_pos, CAST(preorder AS INTEGER) AS preorder, type, label, code FROM nd
UNION ALL SELECT key, 'error: expected ), got the end', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM sh WHERE shape = 6""")
def tree_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return sva.nodes(_assertions(spark, sf), "idx", "sva")


_MEANINGS = """m(shape, explanation, outline) AS (VALUES (0, 'whenever req_R, 2 cycles later ack_b in the same cycle', '|->/├─ req_R/└─ ##2/   └─ ack_b'), (1, 'a and b is false is not identical to 1''b1', '!==/├─ &&/│  ├─ a/│  └─ !/│     └─ b/└─ 1''b1'),
(2, 'whenever a rises, b of P cycles before in the next cycle', '|=>/├─ $rose/│  └─ a/└─ $past/   ├─ b/   └─ P'), (3, 'whenever a, then 1 to 3 cycles later b, eventually c in the same cycle', '|->/├─ ##[1:3]/│  ├─ a/│  └─ b/└─ s_eventually/   └─ c'),
(4, 'both a until b and it is not the case that pQ', 'and/├─ until/│  ├─ a/│  └─ b/└─ not/   └─ pQ'), (5, 'a', 'a'))"""


@query(f"""WITH {_SHAPES_SQL}, {_MEANINGS},
sd AS (SELECT sva, any_value(shape) AS shape, any_value(r) AS r, any_value(p) AS p, any_value(q) AS q FROM sh GROUP BY sva),
ns AS (SELECT DISTINCT sva, shape, node_id, parent_id, child_pos, preorder, type, label FROM nd),
t AS (SELECT *, max(preorder) OVER (PARTITION BY sva) - preorder + 1 AS k, 'T' || (max(preorder) OVER (PARTITION BY sva) - preorder + 1) AS name FROM ns),
kids AS (SELECT sva, parent_id, list(name ORDER BY child_pos) AS names FROM t WHERE parent_id IS NOT NULL GROUP BY 1, 2),
steps AS (SELECT t.sva AS sva, string_agg(name || ' = ' || CASE WHEN names IS NULL THEN label WHEN len(names) = 2 THEN names[1] || ' ' || label || ' ' || names[2] ELSE label || '(' || array_to_string(names, ', ') || ')' END, '; ' ORDER BY k) AS merge, count(*) AS n FROM t LEFT JOIN kids ON t.sva = kids.sva AND t.node_id = kids.parent_id GROUP BY t.sva),
lines AS (SELECT sva, string_agg('  n' || node_id || ' [label="' || label || '", shape=' || CASE type WHEN 'operator' THEN 'box' ELSE 'ellipse' END || '];', chr(10) ORDER BY preorder) AS a, string_agg('  n' || parent_id || ' -> n' || node_id || ';', chr(10) ORDER BY preorder) FILTER (parent_id IS NOT NULL) AS b FROM ns GROUP BY sva),
each AS (SELECT sd.sva AS sva, CAST(n AS INTEGER) AS n_nodes, {_FILL("replace(explanation, 'of P', 'of ' || p)")} AS explanation, replace({_FILL('outline')}, '─ P', '─ ' || p) AS outline_flat, merge,
 'digraph sva {{' || chr(10) || a || CASE WHEN b IS NULL THEN '' ELSE chr(10) || b END || chr(10) || '}}' AS dot FROM sd JOIN m ON sd.shape = m.shape JOIN steps ON sd.sva = steps.sva JOIN lines ON sd.sva = lines.sva)
SELECT key, 'ok' AS status, 'posedge clk' AS clock, 'tb_reset' AS disable, n_nodes, explanation, outline_flat, merge, dot FROM sh JOIN each ON sh.sva = each.sva
UNION ALL SELECT key, 'error: expected ), got the end', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM sh WHERE shape = 6""")
def tree_explanations(spark: SparkSession, sf: str) -> DataFrame:
    got = sva.trees(_assertions(spark, sf), "idx", "sva", ("clock", "disable", "n_nodes", "explanation", "outline", "merge", "dot"))
    return got.withColumn("outline_flat", F.replace("outline", F.lit("\n"), F.lit("/"))).drop("outline")


# ---------------------------------------------------------------- generation dataflow


@query(f"""WITH {_LINES_SQL}, d AS (SELECT DISTINCT sva FROM v) SELECT idx, 'stub:' || md5('Explain: ' || v.sva) AS completion FROM v""")
def completed_prompts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _assertions(spark, sf).withColumn("prompt", F.concat(F.lit("Explain: "), "sva"))
    return generate.complete(rows, "prompt", "completion", generate.Stub()).select("idx", "completion")


@query(f"""WITH {_LINES_SQL}, {_OPS_SQL}, h AS (SELECT DISTINCT sva, op FROM v JOIN ops ON contains(sva, op)),
c AS (SELECT sva, string_agg(op, '; ' ORDER BY op) AS context FROM h GROUP BY sva) SELECT DISTINCT v.sva AS sva, 'Context:' || chr(10) || coalesce(context, '') || chr(10) || 'Property: ' || v.sva AS prompt FROM v LEFT JOIN c ON v.sva = c.sva""")
def retrieval_prompts(spark: SparkSession, sf: str) -> DataFrame:
    ops = F.broadcast(spark.createDataFrame([(o,) for o in _OPS], "op string"))
    rows = _assertions(spark, sf).select("sva").distinct()
    hits = retrieval.contains_join(rows, "sva", ops, "op").select("sva", F.col("op").alias("content"), F.col("op").alias("rank"))
    return generate.stuff(rows, hits, "sva", "Context:\n{context}\nProperty: {query}", "; ")


@query("SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS NULL OR ts >= p + INTERVAL 30 MINUTE GROUP BY user_id")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).count().groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))


from lemmata import queries_blocks, queries_datasets, queries_generation, queries_lines, queries_more, queries_operators, queries_pages, queries_patterns, queries_report, queries_retrieval, queries_sequences  # noqa: E402, F401  (register their queries here)
