"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.llm import ann, binary, decontam, exact, jaccard, lines, mixing, pii, token_counts, tokenize, toxicity, trie, urls, whiten
from lemmata.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(table(spark, sf_dir, "documents")))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)).drop("longest")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_counts(table(spark, sf_dir, "documents"), tokenize.vocabulary_path())


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), entropy=0.95, repeats=4.0)
    return mixed.select("doc_id", "source", "n_tokens", F.round("weight", 6).alias("weight"), "uses")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), n=5, percent=80)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.read_back(binary.write_ids(table(spark, sf_dir, "documents"), tokenize.vocabulary_path(), end_id=2))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(*trie.regrown(table(spark, sf_dir, "conversations"), every=5, heads=9))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"), k=16)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.classes(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_pii, op2_ann, op3_url_filter, op4_decontamination, op5_token_counts, op6_mixing, op7_jaccard_join, op8_toxicity, op9_token_ids, op10_line_dedup,
        op11_prefix_trie, op12_whitening, op13_exact_dedup,
    )
}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op4_decontamination": f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
ks AS (SELECT DISTINCT k FROM win),
dw AS (
  SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
),
hit AS (SELECT DISTINCT doc_id, i, dw.k AS k, item_id FROM dw JOIN win ON dw.g = win.g AND dw.k = win.k),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
""",
    "op6_mixing": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mark FROM documents
),
size AS (SELECT greatest(1, CAST(ceil(count(*) / {mixing.BLOCK_DOCS}.0) AS BIGINT)) AS nb, CAST(sum(n) AS DOUBLE) AS total FROM d),
dealt AS (SELECT d.*, CAST('0x' || substr(mark, 1, 8) AS BIGINT) % nb AS block FROM d, size),
s AS (SELECT source, sum(n) AS tokens FROM d GROUP BY source),
q AS (SELECT source, tokens, ln(tokens / total) AS q FROM s, size WHERE tokens > 0),
ent(step, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
  FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid,
          (SELECT ln(sum(exp((lo + hi) / 2 * q.q))) - (lo + hi) / 2 * sum(exp((lo + hi) / 2 * q.q) * q.q) / sum(exp((lo + hi) / 2 * q.q)) FROM q) >= 0.95 * (SELECT ln(count(*)) FROM q) AS ok
        FROM ent WHERE step < {mixing.HALVINGS})
),
rep(step, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
  FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid,
          (SELECT max(exp(((lo + hi) / 2 - 1) * q.q)) / sum(exp((lo + hi) / 2 * q.q)) FROM q) > 4.0 AS ok
        FROM rep WHERE step < {mixing.HALVINGS})
),
e AS (
  SELECT greatest((SELECT (lo + hi) / 2 FROM ent WHERE step = {mixing.HALVINGS}),
                  (SELECT CASE WHEN hi <= power(2.0, -{mixing.HALVINGS}) THEN 0.0 ELSE (lo + hi) / 2 END FROM rep WHERE step = {mixing.HALVINGS})) AS e
),
w AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN power(tokens / total, e) ELSE 0.0 END AS p FROM s, size, e),
quota AS (SELECT source, tokens, p / (SELECT sum(p) FROM w) AS weight, p / (SELECT sum(p) FROM w) * total AS quota FROM w, size),
parts AS (SELECT *, CASE WHEN tokens > 0 THEN floor(quota / tokens + 1e-9) ELSE 1 END AS whole FROM quota),
b AS (SELECT source, block, sum(n) AS bt FROM dealt GROUP BY source, block),
placed AS (SELECT source, block, sum(bt) OVER (PARTITION BY source ORDER BY md5('7:block:' || block), block) - bt AS before FROM b),
run AS (SELECT dealt.*, sum(n) OVER (PARTITION BY source, block ORDER BY mark, doc_id RANGE UNBOUNDED PRECEDING) AS upto FROM dealt)
SELECT doc_id, run.source AS source, n AS n_tokens, round(weight, 6) AS weight,
  CAST(CASE WHEN tokens = 0 THEN 1 ELSE whole + CASE WHEN upto <= greatest(0.0, quota - whole * tokens) + 1e-6 - before THEN 1 ELSE 0 END END AS INTEGER) AS uses
FROM run JOIN placed ON run.source IS NOT DISTINCT FROM placed.source AND run.block = placed.block
JOIN parts ON run.source IS NOT DISTINCT FROM parts.source
""",
    "op11_prefix_trie": """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS sig
  FROM conversations WHERE conv_id IS NOT NULL
),
own AS (
  SELECT conv_id, list(sig ORDER BY turn NULLS FIRST, sig) AS sigs, list(octet_length(encode(text)) ORDER BY turn NULLS FIRST, sig) AS bytes,
    list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1),
      lambda i: [ascii(substr(CAST(conv_id AS VARCHAR), i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) AS crc
  FROM t GROUP BY conv_id
),
r AS (
  SELECT o.conv_id, list_concat(coalesce(b.sigs[1:xor(o.crc, 4294967295) % 9], []), o.sigs[xor(o.crc, 4294967295) % 9 + 1:]) AS sigs,
    list_concat(coalesce(b.bytes[1:xor(o.crc, 4294967295) % 9], []), o.bytes[xor(o.crc, 4294967295) % 9 + 1:]) AS bytes
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5
),
p AS (SELECT conv_id, d, array_to_string(sigs[1:d], '.') AS node, array_to_string(sigs[1:d - 1], '.') AS parent, sigs[1:d] AS path, bytes[d] AS n_bytes, len(sigs) AS n
      FROM (SELECT *, unnest(range(0, len(sigs) + 1)) AS d FROM r)),
nodes AS (
  SELECT node, d AS depth, any_value(CASE WHEN d > 0 THEN parent END) AS parent, any_value(path) AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * coalesce(any_value(n_bytes), 0) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = n), '')) AS ends_sha256
  FROM p GROUP BY node, d
),
kids AS (SELECT parent, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
up AS (SELECT array_to_string(path[1:a], '.') AS node, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
       FROM (SELECT path, saved, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, unnest(range(0, depth + 1)) AS a FROM nodes LEFT JOIN kids ON kids.parent = nodes.node)
       GROUP BY 1)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN up ON up.node = n.node LEFT JOIN nodes q ON q.node = n.parent LEFT JOIN kids ON kids.parent = n.node
""",
    "op13_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
}
