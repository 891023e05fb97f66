"""Registered queries on datasets that are built with verification and backfill."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.operators import curate
from lemmata.plans import generate, orchestrate
from lemmata.queries import query
from lemmata.session import shared_folder, table

#: slots of the sample, and rounds that the SQL spells out (two or three are needed)
_SLOTS, _ROUNDS = 100, 10
_OK = "substr(md5({x}), 1, 1) <= '7'"


def _rounds() -> str:
    out = ["r0 AS (SELECT doc_id AS slot, doc_id AS idx FROM t)"]
    for i in range(1, _ROUNDS + 1):
        used = " + ".join(["0", *(f"(SELECT count(*) FROM o{k})" for k in range(1, i))])
        out.append(f"o{i} AS (SELECT slot, row_number() OVER (ORDER BY slot) AS n FROM r{i - 1} JOIN d ON idx = doc_id WHERE said IS NULL)")
        out.append(f"r{i} AS (SELECT slot, free.doc_id AS idx FROM o{i} JOIN free ON k = n + {used})")
    return ", ".join(out)


@query(f"""WITH x AS (SELECT doc_id, coalesce(text, '') AS text, 'stub:' || md5('Restate: ' || coalesce(text, '')) AS x0 FROM documents),
y AS (SELECT *, 'stub:' || md5('Correct: ' || x0 || ' (starts with ' || substr(md5(x0), 1, 1) || ')') AS x1 FROM x), z AS (SELECT *, 'stub:' || md5('Correct: ' || x1 || ' (starts with ' || substr(md5(x1), 1, 1) || ')') AS x2 FROM y),
d AS (SELECT doc_id, text, CASE WHEN {_OK.format(x="x0")} THEN x0 WHEN {_OK.format(x="x1")} THEN x1 WHEN {_OK.format(x="x2")} THEN x2 END AS said FROM z),
t AS (SELECT doc_id FROM d ORDER BY md5('0:' || doc_id), doc_id LIMIT {_SLOTS}), free AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM d WHERE doc_id NOT IN (SELECT doc_id FROM t)), {_rounds()},
done AS ({" UNION ALL ".join(f"SELECT slot, idx, {i + 1} AS tries FROM r{i}" for i in range(_ROUNDS + 1))})
SELECT slot, idx AS resolved, CAST(tries AS BIGINT) AS tries, md5('OL NL: ' || said || chr(10) || chr(10) || '# Decomposition' || chr(10) || length(text) || chr(10) || chr(10) || '# Merge' || chr(10) || 'm' || chr(10) || chr(10) || '```systemverilog' || chr(10) || text || chr(10) || '```') AS digest FROM done JOIN d ON idx = doc_id WHERE said IS NOT NULL""")
def reasoning_turns(spark: SparkSession, sf: str) -> DataFrame:
    """A sample's slots, each with the turn of its own text or, where that never passes the check, of the next unused one."""
    pool = table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), "text")
    targets = curate.sample_n(pool.select("idx"), _SLOTS, "idx", 0)
    first = lambda c: F.substring(F.md5(c), 1, 1)
    size = F.length(F.coalesce("text", F.lit(""))).cast("string")
    work = orchestrate.restated_turns("text", generate.Stub(), lambda c: first(c) <= "7", lambda c: F.concat(F.lit("starts with "), first(c)), decomposition=size, merge=F.lit("m"))
    done = orchestrate.fill_slots(pool, targets, work, f"{shared_folder(spark)}/turns-{uuid4().hex}")
    return done.select("slot", "resolved", "tries", F.md5("content").alias("digest"))
