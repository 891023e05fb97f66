"""Slots are filled in order, failures backfilled once each, and a stopped run goes on without repeating or losing a row."""

import pytest
from pyspark.sql import functions as F

from lemmata.plans import generate, orchestrate


def expected(pool, targets, good):
    """The rounds, told plainly: open slots in order take the next untried records in order."""
    tried, filled, tries = set(targets), {}, dict.fromkeys(targets, 0)
    candidates = {s: s for s in targets}
    while candidates:
        for s, i in candidates.items():
            tries[s] += 1
            if good(i):
                filled[s] = i
        free = iter(sorted(i for i in pool if i not in tried))
        candidates = {s: i for s, i in zip(sorted(s for s in targets if s not in filled), free, strict=False)}
        tried |= set(candidates.values())
    return {s: (filled.get(s), tries[s]) for s in targets}


@pytest.fixture(scope="module")
def pool(spark):
    return spark.range(60).select(F.col("id").alias("idx"), F.concat(F.lit("t"), "id").alias("text")).repartition(3)


def good(i):
    return i % 3 == 0


def work(seen):
    def run(rows):
        seen.append(sorted((r["slot"], r["idx"]) for r in rows.collect()))
        return rows.select("slot", "idx", F.when(F.col("idx") % 3 == 0, F.col("text")).alias("content"))

    return run


def result(df):
    return {r["slot"]: (r["resolved"], r["tries"]) for r in df.collect()}


def test_rounds_and_backfill(spark, pool, tmp_path):
    targets, seen = [1, 3, 4, 5, 7, 20], []
    df = spark.createDataFrame([(i,) for i in targets], "idx int")
    got = orchestrate.fill_slots(pool, df, work(seen), str(tmp_path / "run"))
    assert result(got) == expected(range(60), targets, good)
    assert all(r["content"] == f"t{r['resolved']}" for r in got.collect())
    tried = [i for round_ in seen for _, i in round_]
    assert len(tried) == len(set(tried))


def test_a_stopped_run_goes_on(spark, pool, tmp_path):
    targets, seen, folder = [1, 4, 7, 10], [], str(tmp_path / "run")
    df = spark.createDataFrame([(i,) for i in targets], "idx int")
    part = orchestrate.fill_slots(pool, df, work(seen), folder, most=1)
    assert result(part) == dict.fromkeys(targets, (None, 1))

    def dies(rows):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        orchestrate.fill_slots(pool, df, dies, folder)
    (tmp_path / "run" / "round=1").mkdir()  # a round that was begun and never committed
    got = orchestrate.fill_slots(pool, df, work(seen), folder)
    assert result(got) == expected(range(60), targets, good)
    tried = [i for round_ in seen for _, i in round_]
    assert len(tried) == len(set(tried))
    n = len(seen)
    assert result(orchestrate.fill_slots(pool, df, work(seen), folder)) == result(got) and len(seen) == n


def test_a_used_up_pool_leaves_slots_open(spark, tmp_path):
    pool = spark.createDataFrame([(i, "x") for i in (1, 2, 4, 5, 6)], "idx int, text string")
    got = orchestrate.fill_slots(pool, pool.where("idx < 4").select("idx"), work([]), str(tmp_path / "run"))
    assert result(got) == expected([1, 2, 4, 5, 6], [1, 2], good)
    assert result(got)[2][0] is None


def test_restated_turns_are_told_why(spark, tmp_path):

    class Says(generate.Stub):
        def __call__(self, prompts):
            return [p.split(": ", 1)[1] + "!" for p in prompts]

    pool = spark.createDataFrame([(1, "ab"), (2, "a"), (3, None)], "idx int, text string")
    doing = orchestrate.restated_turns("text", Says(), lambda c: F.length(c) >= 9, lambda c: F.concat(F.lit("n"), F.length(c).cast("string")), rounds=1)
    got = {r["slot"]: r["content"] for r in orchestrate.fill_slots(pool, pool.select("idx"), doing, str(tmp_path / "r")).collect()}
    assert got[1] == "OL NL: ab! (n3)!\n\n# Decomposition\n\n\n# Merge\n\n\n```systemverilog\nab\n```"
    assert got[2] is None and got[3] is None
