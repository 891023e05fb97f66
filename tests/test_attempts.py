"""Live attempts against the batch answer: late ticks, idle traces, and a restart in between."""

import random
from datetime import datetime, timedelta

import pytest

from lemmata.operators import automaton as A
from lemmata.streaming import attempts

SCHEMA = "trace_id long, tick long, ts timestamp, a boolean, b boolean, r boolean"
BEGAN = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, attempts.PROVIDER)
    yield spark
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def run(spark, folder, s):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = attempts.outcomes(stream, s, "10 seconds", "30 seconds", "r").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None and not q.isActive


def test_stream_equals_batch_over_a_restart(rocks, tmp_path):
    r = random.Random(3)
    rows = {t: [(t, i, BEGAN + timedelta(seconds=i), r.random() < 0.5, r.random() < 0.5, r.random() < 0.05) for i in range(r.choice([3, 12, 20]))] for t in range(6)}
    s = A.delay(A.delay(A.tick("a"), A.tick("b"), 1, 3), A.tick("a"), 2)

    def put(some):
        rocks.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    early = [x for t in rows for x in rows[t] if x[1] < 10]
    r.shuffle(early)  # within the watermark, in any order
    put(early[: len(early) // 2])
    put(early[len(early) // 2 :])
    run(rocks, tmp_path, s)
    put([x for t in rows for x in rows[t] if x[1] >= 10])
    put([(99, 0, BEGAN + timedelta(seconds=200), False, False, False)])  # time goes on, the traces are idle
    put([(99, 1, BEGAN + timedelta(seconds=201), False, False, False)])
    run(rocks, tmp_path, s)
    got = sorted((x["trace_id"], x["tick"], x["outcome"]) for x in rocks.read.parquet(str(tmp_path / "out")).where("trace_id <> 99").collect())
    batch = A.outcome(rocks.createDataFrame([x for t in rows for x in rows[t]], SCHEMA), s, "how", "r")
    assert got == sorted((x["trace_id"], x["tick"], x["how"]) for x in batch.collect())
    assert {x[2] for x in got} >= {A.MATCH, A.FAIL, A.LIVE}


def test_state_store_is_asked_for(spark):
    with pytest.raises(RuntimeError, match="RocksDB"):
        attempts.outcomes(spark.readStream.format("rate").load().selectExpr("value as trace_id", "value as tick", "timestamp as ts", "true as a"), A.tick("a"))
