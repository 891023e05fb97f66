"""SparkSession factory and the few session-wide helpers."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: bytes of one Arrow batch between the JVM and a Python worker, where the session names none of its own
BATCH_BYTES = 8 << 20
ROOT = str(Path(__file__).resolve().parent.parent)


def build_session(app: str = "lemmata", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the operators are tested under; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package even when the driver found it through sys.path alone, and bound their batches."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if limit not in dict(spark.sparkContext.getConf().getAll()):
        spark.conf.set(limit, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH", ""), os.environ.get("PYTHONPATH", "")) if p]
    if ROOT not in os.pathsep.join(paths).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's, else one of this machine in local mode."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isEmpty() and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lemmata-") if known.isEmpty() else known.get()
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the cluster's checkpoint folder and go on from there (lineage ends)."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
