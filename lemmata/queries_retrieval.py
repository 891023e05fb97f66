"""Registered queries on retrieval by vectors into prompts, routed stores, chunk vectors, and scores by golden counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.operators import curate, retrieval, split
from lemmata.plans import generate
from lemmata.queries import _REPORT_SQL, _report, query
from lemmata.queries_more import _COUNTS, _DIM, _SLOTS, _UNIT
from lemmata.queries_pages import _chunk_sql
from lemmata.session import cut, table


def _vectors(name: str, source: str, key: str, text: str, more: str = "") -> str:
    """CTEs that end in `name` (key, further columns, v): the hashed vectors of a column of texts."""
    return f"""{name}_s AS (SELECT {key}{more}, {_SLOTS.format(t=text)} AS s FROM {source}), {name}_c AS (SELECT * EXCLUDE s, {_COUNTS.format(s='s')} AS c FROM {name}_s), {name} AS (SELECT * EXCLUDE c, {_UNIT.format(c='c')} AS v FROM {name}_c)"""


_DOT = "list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i]))"
_VECTORS = f"{_vectors('q', 'benchmark', 'item_id', 'text', ', text')}, {_vectors('d', 'documents', 'doc_id', 'text', ', lang, text')}"


def _stores(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    store = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", F.coalesce("text", F.lit("")).alias("content"))
    return table(spark, sf, "benchmark").select("item_id", "text"), store


@query(f"""WITH {_VECTORS}, r AS (SELECT item_id, q.text AS asked, coalesce(d.text, '') AS content, row_number() OVER (PARTITION BY item_id ORDER BY {_DOT} DESC, doc_id) AS rank FROM q, d),
p AS (SELECT item_id, any_value(asked) AS asked, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS context FROM r WHERE rank <= 3 GROUP BY item_id)
SELECT item_id, md5(context || chr(10) || 'Write one assertion for: ' || asked) AS prompt, 'stub:' || md5(context || chr(10) || 'Write one assertion for: ' || asked) AS completion FROM p""")
def retrieved_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The chain: nearest documents of an item by vector, stuffed into the prompt, completed."""
    asked, store = _stores(spark, sf)
    found = cut(generate.retrieve(asked, store, "item_id", 3, _DIM))
    texts = asked.join(found, "item_id").select(F.col("text").alias("query"), "rank", "content")
    done = generate.complete(generate.stuff(asked.select(F.col("text").alias("query")).distinct(), texts, "query", generate.TEMPLATES["plain"]), "prompt", "completion", generate.Stub())
    return asked.join(done, F.col("text") == F.col("query")).select("item_id", F.md5("prompt").alias("prompt"), "completion")


_ROUTE = "CASE length(q.text) % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'fr' END"


@query(f"""WITH {_VECTORS}, r AS (SELECT item_id, d.lang AS store, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY {_DOT} DESC, doc_id) AS rank FROM q JOIN d ON d.lang = {_ROUTE})
SELECT item_id, store, CAST(rank AS INTEGER) AS rank, md5(coalesce(text, '')) AS content FROM r JOIN documents USING (doc_id) WHERE rank <= 3""")
def routed_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """Each item asks the store that it is routed to, for its three nearest."""
    asked, store = _stores(spark, sf)
    routed = asked.withColumn("store", F.expr(_ROUTE.replace("q.text", "text")))
    found = generate.routed(routed, {x: store.where(F.col("lang") == x).drop("lang") for x in ("en", "de", "fr")}, "item_id", 3)
    return found.select("item_id", "store", "rank", F.md5("content").alias("content"))


@query(_chunk_sql(3000, 1000).rsplit("SELECT doc_id, CAST(row_number()", 1)[0] + f""", ch AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk, content FROM t WHERE content <> ''), {_vectors('x', 'ch', 'doc_id', 'content', ', chunk')}
SELECT doc_id, chunk, CAST(unnest(range(0, {_DIM})) AS INTEGER) AS dim, round(unnest(v), 6) AS v FROM x""")
def chunk_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks with their vectors, what an index is built from."""
    docs = table(spark, sf, "documents").select("doc_id", F.translate("text", "\n", " ").alias("text"))
    chunks = split.recursive_chunks(docs, 3000, 1000)
    return chunks.select("doc_id", "chunk", F.posexplode(retrieval.embed(F.col("content"), _DIM)).alias("dim", "v")).select("doc_id", "chunk", "dim", F.round("v", 6).alias("v"))


#: a dictionary of each module: assertions, and keys that are none
_DICTIONARY = """'{"Assertion 1": {}, ' || CASE WHEN s_suppkey % 2 = 0 THEN '"Assertion 2": 5, "leaves": ["a"], ' ELSE '' END || CASE WHEN s_suppkey % 3 = 0 THEN '"other": 1, "Assertion 3": null, ' ELSE '' END || '"files": []}'"""


@query("SELECT s_suppkey, 1 + CAST(s_suppkey % 2 = 0 AS INTEGER) + CAST(s_suppkey % 3 = 0 AS INTEGER) AS golden FROM supplier")
def golden_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").selectExpr("s_suppkey", f"{_DICTIONARY} as d").select("s_suppkey", curate.golden_counts("d").alias("golden"))


@query(f"""WITH {_REPORT_SQL}, g AS (SELECT module, length(module) AS golden FROM (SELECT DISTINCT module FROM r) WHERE module <> (SELECT min(module) FROM r)),
p AS (SELECT r.*, coalesce(golden, 0) AS golden, row_number() OVER (PARTITION BY module ORDER BY l_orderkey, l_linenumber, result) - 1 - coalesce(golden, 0) AS pos FROM r LEFT JOIN g USING (module))
SELECT module, CAST(any_value(golden) AS BIGINT) AS golden, CAST(floor((count(*) - any_value(golden)) / 2.0) AS BIGINT) AS sc, count(*) FILTER (pos >= 0 AND pos % 2 = 0 AND result = 'proven') AS fc, count(*) FILTER (pos >= 0 AND pos % 2 = 1 AND result = 'proven') AS fm FROM p GROUP BY module""")
def scores_by_golden(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of designs whose golden counts differ; one design has none."""
    report = cut(_report(spark, sf))
    modules = report.select("module").distinct()
    least = modules.agg(F.min("module").alias("least"))
    golden = modules.join(F.broadcast(least), F.col("module") != F.col("least")).select("module", F.length("module").cast("long").alias("golden"))
    return curate.design_scores(report, golden, "module", "l_orderkey", ("l_linenumber", "result"))
