"""Registered queries on chunks by separators and on code fences over page lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.operators import fences, split
from lemmata.queries import query
from lemmata.session import table


def _chunk_sql(size: int, overlap: int, source: str = "(SELECT doc_id, text FROM documents)") -> str:
    """The greedy merge by pieces between spaces, from prefix sums: where a chunk ends, and where the next one begins."""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), ' '), ' '), lambda x, i: CASE WHEN i = 1 THEN x ELSE ' ' || x END), lambda x: x <> '') AS ps FROM {source} WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, length(ps[i]) AS n FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM d)),
p AS (SELECT doc_id, i, n, sum(n) OVER o AS upto, sum(n) OVER o - n AS before, lead(n) OVER o AS then FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT s.doc_id, s.i AS s, x.i AS e, greatest(x.upto - {overlap}, x.upto + x.then - {size}) AS least, x.then IS NULL AS last FROM p s ASOF JOIN p x ON s.doc_id = x.doc_id AND s.before + {size} >= x.upto),
nx AS (SELECT e.doc_id, e.s, e.e, e.last, y.i AS nxt FROM e ASOF LEFT JOIN p y ON e.doc_id = y.doc_id AND e.least <= y.before),
c AS (SELECT doc_id, 0 AS k, s, e, last, CASE WHEN NOT last THEN coalesce(nxt, e + 1) END AS nxt FROM nx WHERE s = 1
 UNION ALL SELECT nx.doc_id, k + 1, nx.s, nx.e, nx.last, CASE WHEN NOT nx.last THEN coalesce(nx.nxt, nx.e + 1) END FROM c JOIN nx ON c.doc_id = nx.doc_id AND c.nxt = nx.s WHERE c.nxt IS NOT NULL),
t AS (SELECT c.doc_id, k, regexp_replace(array_to_string(ps[s:e], ''), '^\\s+|\\s+$', '', 'g') AS content FROM c JOIN d ON c.doc_id = d.doc_id)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk, length(content) AS n, md5(content) AS digest FROM t WHERE content <> ''"""


def _chunks(spark: SparkSession, sf: str, size: int, overlap: int) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.translate("text", "\n", " ").alias("text"))
    return split.recursive_chunks(docs, size, overlap).select("doc_id", "chunk", F.length("content").cast("long").alias("n"), F.md5("content").alias("digest"))


@query(_chunk_sql(1000, 200))
def recursive_chunks_1000_200(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf, 1000, 200)


@query(_chunk_sql(3000, 1000))
def recursive_chunks_3000_1000(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf, 3000, 1000)


@query(f"""SELECT c.doc_id AS page_id, url, chunk, n, digest FROM ({_chunk_sql(1000, 200, "(SELECT page_id AS doc_id, html AS text FROM pages)")}) c JOIN pages ON c.doc_id = page_id""")
def page_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Each page on its own, its chunks with what tells where they are from."""
    pages = table(spark, sf, "pages").select("page_id", "url", F.translate("html", "\n", " ").alias("text"))
    return split.recursive_chunks(pages, 1000, 200).select("page_id", "url", "chunk", F.length("content").cast("long").alias("n"), F.md5("content").alias("digest"))


#: lines of pages: whether one opens a block, looks like code, ends a block
_KINDS = {"wire w": (1, 1, 0), "plain words": (0, 0, 0), "the module is good": (0, 1, 0), "endmodule": (1, 1, 1), "x <= y;": (1, 1, 0), "Good Words": (0, 0, 0), "f(a);": (0, 0, 1), "text": (0, 0, 0)}
_PAGE = "repeat(' ', cast(event_id % 4 * 2 as int)) || CASE (event_id * 7 + user_id) % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_KINDS)) + " END"


@query(
    "WITH RECURSIVE k(kind, opens, looks, ends) AS (VALUES " + ", ".join(f"({i}, {o}, {c}, {e})" for i, (o, c, e) in enumerate(_KINDS.values())) + """),
l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id % 4 * 2 AS indent, opens, looks, ends FROM events JOIN k ON kind = (event_id * 7 + user_id) % 8),
m AS (SELECT user_id, event_id, n, CASE WHEN opens = 1 THEN 'open' ELSE 'outside' END AS state, CASE WHEN opens = 1 THEN indent ELSE -1 END AS held FROM l WHERE n = 1
 UNION ALL SELECT l.user_id, l.event_id, l.n, CASE WHEN held < 0 THEN CASE WHEN opens = 1 THEN 'open' ELSE 'outside' END WHEN ends = 1 OR (indent < held AND looks = 0) THEN 'close' ELSE 'inside' END,
  CASE WHEN held < 0 THEN CASE WHEN opens = 1 THEN indent ELSE -1 END WHEN ends = 1 OR (indent < held AND looks = 0) THEN -1 ELSE held END FROM m JOIN l ON m.user_id = l.user_id AND l.n = m.n + 1)
SELECT user_id, event_id, state FROM m"""
)
def page_fences(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "events").selectExpr("user_id", "event_id", f"{_PAGE} as content")
    return fences.fence_state(lines, ["user_id"], "event_id").select("user_id", "event_id", "state")
