"""Session helpers: settings the operators rely on, and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Neither the settings page nor explain() may show key material.
    "spark.redaction.regex": "(?i)secret|password|token|vaultKey|access[.]?key",
    "spark.sql.redaction.string.regex": "0x[0-9A-Fa-f]{64,}|X'[0-9A-Fa-f]{64,}'",
}


INPUT_PARTITIONS = "spark.tokengraph.inputPartitions"


def local_session(cores: str = "8", app: str = "tokengraph", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, use the session you are given."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    base = {**SETTINGS, "spark.sql.shuffle.partitions": cores, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", INPUT_PARTITIONS: cores}
    for k, v in {**base, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``; a local one only in local mode."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="tokengraph-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()



def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Repartition an input to the number in ``spark.tokengraph.inputPartitions``, whatever its size.

    Span search is heavy per byte, and a small file is often one row group, which is one task. ``local_session`` sets the
    number to the cores; leave it unset on a cluster, where texts have enough splits and should not be shuffled. Then only
    an input with ``rows`` is dealt, to tasks of about that many rows: a narrow table from which many rows are made, whose
    few splits would otherwise hold a share of those rows that grows with the table.
    """
    n = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    if n:
        return df.repartition(int(n))
    parts = -(-df.count() // rows) if rows else 1
    return df.repartition(parts) if parts > 1 else df


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder, so that later jobs do not recompute its inputs.

    Unlike a cached or checkpointed RDD the table survives executors, keeps column pruning and tells the planner its
    size, which is what decides between a broadcast and a shuffle join.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
