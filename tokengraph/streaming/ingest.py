"""Files that keep arriving: ingestion micro-batches and job state, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tokengraph.functions import constants as K
from tokengraph.functions.hashing import TokenKey
from tokengraph.plans import flows
from tokengraph.sources.live import LiveStore

JOB_SCHEMA = "job_id string, seq bigint, filename string, status string, stage string, progress_pct int, error string, ts timestamp"


def document_stream(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) for every new text file below ``path``."""
    return (
        spark.readStream.option("recursiveFileLookup", True).schema("value string").text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )


def run_ingestion(
    source: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Apply ``transform`` to each micro-batch and write it under its batch id.

    A batch replayed after a failure overwrites its own folder, and the checkpoint names each file once, so every
    document is stored exactly once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_store_ingestion(
    source: DataFrame, store: LiveStore, key: TokenKey, vault_key: bytes, checkpoint: str, edge_limit: int | None = K.EDGE_LIMIT, available_now: bool = True
) -> StreamingQuery:
    """The whole ingestion per micro-batch of (path, content): vault, graph, registry and log, published under its batch id.

    The store's pointer names the last batch, so one that is replayed after a failure is either finished or skipped.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        flows.ingest_batch(store, batch, key, vault_key, batch_id, edge_limit)

    writer = source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def progress(done: int, total: int) -> int:
    """Percent shown while sentences are tokenized."""
    return 35 + int(done / total * 35)


def job_states(events: DataFrame) -> DataFrame:
    """Latest state per job, batch or stream (update/complete mode): one small aggregate buffer per job."""
    cols = ["filename", "status", "stage", "progress_pct", "error", "ts"]
    return (
        events.groupBy("job_id")
        .agg(F.min("ts").alias("created_at"), F.max(F.struct("seq", *cols)).alias("_l"))
        .select("job_id", "created_at", *[F.col(f"_l.{c}").alias("updated_at" if c == "ts" else c) for c in cols])
    )


def list_jobs(states: DataFrame) -> DataFrame:
    return states.orderBy(F.col("created_at").desc(), "job_id")


def get_job(states: DataFrame, job_id: str) -> DataFrame:
    return states.filter(F.col("job_id") == job_id)
