"""State of ingestion jobs, kept per job by a stateful operator with timers."""

from __future__ import annotations

import sys

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

# Spark asks the operator for its state variables in a process that knows nothing of the driver's import path.
register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Percent shown at each stage; tokenizing moves from its base by its share of the sentences.
STAGES = {"queued": 0, "parsing": 15, "detecting_pii": 35, "tokenizing": 35, "building_graph": 80, "completed": 100, "failed": 100}
TOKENIZING_SHARE = 35
FINAL = ("completed", "failed")

EVENTS = "job_id string, seq bigint, filename string, stage string, done bigint, total bigint, error string, ts timestamp"
STATES = "job_id string, filename string, status string, stage string, progress_pct int, error string, created_at timestamp, updated_at timestamp, step bigint"
# Inside the operator times are microseconds: rows and state values do not agree on time zones of timestamps.
_KEPT = "seq long, filename string, stage string, progress_pct int, error string, created_at long, updated_at long, deadline long, step long"
_CHANGE = "job_id string, filename string, status string, stage string, progress_pct int, error string, created_at long, updated_at long, step long"


def percent(stage: str, done: int | None, total: int | None) -> int:
    if stage == "tokenizing" and total:
        return STAGES[stage] + int((done or 0) / total * TOKENIZING_SHARE)
    return STAGES[stage]


def status_of(stage: str) -> str:
    return stage if stage in ("queued", *FINAL) else "processing"


class JobTracker(StatefulProcessor):
    """The latest event of a job by ``seq`` is its state; a job that says nothing for ``timeout`` seconds has failed.

    Events may come out of order or twice: one that is not newer than the state only moves ``created_at`` back. A job that
    timed out and then reports again is taken up again. A row is emitted for every batch or timer that changes a job;
    ``step`` counts them.
    """

    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", _KEPT)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        old = Row(*_NAMES)(*self.state.get()) if self.state.exists() else None
        now = {n: old[n] for n in _NAMES} if old else dict.fromkeys(_NAMES) | {"seq": -1, "step": 0}
        for r in rows:
            if now["created_at"] is None or r["us"] < now["created_at"]:
                now["created_at"] = r["us"]
            now["filename"] = now["filename"] or r["filename"]
            if r["seq"] > now["seq"]:
                now |= {"seq": r["seq"], "stage": r["stage"], "progress_pct": percent(r["stage"], r["done"], r["total"]), "error": r["error"], "updated_at": r["us"]}
        if old:
            if all(now[n] == old[n] for n in _NAMES):
                return
            if old["deadline"] is not None:
                self.handle.deleteTimer(old["deadline"])
        now["deadline"] = None
        if now["stage"] not in FINAL:
            now["deadline"] = now["updated_at"] // 1000 + self.timeout * 1000
            self.handle.registerTimer(now["deadline"])
        yield self._keep(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if not self.state.exists():
            return
        now = dict(zip(_NAMES, self.state.get()))
        if now["stage"] in FINAL or now["deadline"] != expiredTimerInfo.getExpiryTimeInMs():
            return
        now |= {"stage": "failed", "progress_pct": STAGES["failed"], "error": f"no progress for {self.timeout} seconds", "deadline": None}
        yield self._keep(key, now)

    def _keep(self, key, now: dict) -> Row:
        now["step"] += 1
        self.state.update(tuple(now[n] for n in _NAMES))
        return Row(job_id=key[0], filename=now["filename"], status=status_of(now["stage"]), stage=now["stage"], progress_pct=now["progress_pct"], error=now["error"], created_at=now["created_at"], updated_at=now["updated_at"], step=now["step"])

    def close(self) -> None:
        pass


_NAMES = [c.split(" ")[0] for c in _KEPT.split(", ")]


def track(events: DataFrame, timeout: int, delay: str) -> DataFrame:
    """Changes of job states (``STATES``) from a stream of ``EVENTS``; events older than ``delay`` behind the newest are late."""
    timed = events.withColumn("us", F.unix_micros("ts")).withWatermark("ts", delay)
    changes = timed.groupBy("job_id").transformWithState(statefulProcessor=JobTracker(timeout), outputStructType=_CHANGE, outputMode="Update", timeMode="EventTime")
    return changes.withColumns({c: F.timestamp_micros(c) for c in ("created_at", "updated_at")})


def run_tracking(events: DataFrame, out: str, checkpoint: str, timeout: int, delay: str, available_now: bool = True) -> StreamingQuery:
    """Write the changes of each micro-batch under its batch id; a replayed batch overwrites its own folder."""
    spark = events.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # timers need it; the query takes the setting as it starts
    try:
        writer = track(events, timeout, delay).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def job_table(spark: SparkSession, out: str) -> DataFrame:
    """The last state of every job, from the changes written so far."""
    changes = spark.read.schema(STATES).parquet(out)
    cols = [c for c in changes.columns if c not in ("job_id", "step", "batch_id")]
    return changes.groupBy("job_id").agg(F.max_by(F.struct(*cols), "step").alias("s")).select("job_id", "s.*")
