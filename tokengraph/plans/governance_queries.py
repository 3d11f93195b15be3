"""Queries over flows, the audit chain and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokengraph.functions import constants as K
from tokengraph.operators import audit as AU
from tokengraph.operators import guard
from tokengraph.plans import derive as D
from tokengraph.plans import sql as S
from tokengraph.plans.graph_queries import _scratch
from tokengraph.plans import text_queries  # noqa: F401  (its SQL is used again below)
from tokengraph.plans.registry import ORACLES, query
from tokengraph.session import cut
from tokengraph.sources import stores
from tokengraph.streaming import ingest

_ZONES = ["local_trusted", "local_untrusted", "external"]
_KINDS = ["raw_pii", "tokenized", "vault_lookup", "metrics"]
_SEG = 100


@query(
    "flow_policy",
    f"SELECT source, destination, data_type, CASE data_type WHEN 'raw_pii' THEN destination = 'local_trusted' WHEN 'vault_lookup' THEN source = 'local_trusted' ELSE true END AS allowed, count(*) AS n FROM "
    f"(SELECT {S.values_list(_ZONES)}[user_id % 3 + 1] AS source, {S.values_list(_ZONES)}[event_id % 3 + 1] AS destination, {S.values_list(_KINDS)}[event_id % 4 + 1] AS data_type FROM events) GROUP BY ALL",
)
def flow_policy(spark, sf):
    """Every event as a data flow between zones."""
    flows = D.table(spark, sf, "events").select(
        D._pick(_ZONES, F.col("user_id")).alias("source"), D._pick(_ZONES, F.col("event_id")).alias("destination"), D._pick(_KINDS, F.col("event_id")).alias("data_type")
    )
    return flows.withColumn("allowed", guard.flow_allowed(F.col("source"), F.col("destination"), F.col("data_type"))).groupBy(
        "source", "destination", "data_type", "allowed"
    ).agg(F.count("*").alias("n"))


S.CTE["chain"] = (
    ["audit"],
    f"""SELECT seq, 'GENESIS' AS prev_hash, sha256(h || 'GENESIS' || t) AS entry_hash FROM parts WHERE seq % {_SEG} = 0
      UNION ALL SELECT p.seq, c.entry_hash, sha256(p.h || c.entry_hash || p.t) FROM chain c JOIN parts p ON p.seq = c.seq + 1 WHERE p.seq % {_SEG} <> 0""",
)
S.CTE["parts"] = (["audit"], """SELECT seq, '{"details": ' || details || ', "event_type": "' || event_type || '", "prev_hash": "' AS h, '", "timestamp": "' || ts || '"}' AS t FROM audit""")
S.CTE["chain"] = (["parts"], S.CTE["chain"][1])


def _chained(spark, sf):
    return AU.chain_entries(D.audit_events(spark, sf), _SEG)


def _log(spark, sf):
    """The chained log as stored JSON lines, read back."""
    path = _scratch(spark, "audit", sf)
    events = D.audit_events(spark, sf)
    full = events.join(_chained(spark, sf).select("seq", "prev_hash", "entry_hash"), "seq")
    full.select("seq", "ts", "event_type", "details", "prev_hash", "entry_hash").write.mode("overwrite").json(path)
    return stores.read_audit(spark, path)


@query("audit_chain", S.sql(["chain"], "SELECT seq, prev_hash, entry_hash FROM chain"))
def audit_chain(spark, sf):
    return _chained(spark, sf).select("seq", "prev_hash", "entry_hash")


@query(
    "audit_seal",
    S.sql(
        ["chain"],
        "SELECT count(*) AS n, (SELECT end_hash FROM l3 WHERE rn = 1) AS root FROM chain",
        f"""ends AS (SELECT seq // {_SEG} AS s, arg_max(entry_hash, seq) AS end_hash FROM chain GROUP BY 1),
        w1 AS (SELECT s, sha256('GENESIS|' || end_hash) AS h FROM ends WHERE s % {_SEG} = 0
          UNION ALL SELECT e.s, sha256(w1.h || '|' || e.end_hash) FROM w1 JOIN ends e ON e.s = w1.s + 1 WHERE e.s % {_SEG} <> 0),
        up AS (SELECT s // {_SEG} AS s, arg_max(h, s) AS end_hash FROM w1 GROUP BY 1),
        w2 AS (SELECT s, sha256('GENESIS|' || end_hash) AS h FROM up WHERE s % {_SEG} = 0
          UNION ALL SELECT e.s, sha256(w2.h || '|' || e.end_hash) FROM w2 JOIN up e ON e.s = w2.s + 1 WHERE e.s % {_SEG} <> 0),
        l3 AS (SELECT CASE WHEN (SELECT count(*) FROM up) > 1 THEN (SELECT arg_max(h, s) FROM w2) ELSE (SELECT max(end_hash) FROM up) END AS end_hash, 1 AS rn)""",
    ),
)
def audit_seal(spark, sf):
    """One root over the whole log."""
    top = D.table(spark, sf, "events").agg(F.max("event_id")).first()[0]
    return AU.seal(_chained(spark, sf), top, _SEG).select("n", F.col("end_hash").alias("root"))


@query(
    "audit_verify",
    S.sql(["audit"], f"SELECT seq, NOT (seq % 997 = 1) AND NOT (seq % 997 = 2 AND seq % {_SEG} <> 0) AS chain_valid, NOT (seq % 997 = 1 OR seq % 997 = 500) AS content_valid FROM audit"),
)
def audit_verify(spark, sf):
    """A log with tampered entries: changed hashes break the link after them, changed details their own content."""
    seq = F.col("seq")
    log = D.audit_events(spark, sf).join(_chained(spark, sf).select("seq", "prev_hash", "entry_hash"), "seq")
    bad = (
        log.withColumn("prev_hash", F.when(seq % 997 == 1, "forged").otherwise(F.col("prev_hash")))
        .withColumn("entry_hash", F.when(seq % 997 == 1, "forged").otherwise(F.col("entry_hash")))
        .withColumn("details", F.when(seq % 997 == 500, '{"action": "none"}').otherwise(F.col("details")))
    )
    return AU.verify_contents(AU.verify_links(bad, _SEG)).select("seq", "chain_valid", "content_valid")


_EVENTS = "(SELECT count(*) FROM events)"
_KEPT = {
    "intact": f"{_EVENTS}", "removed segment": f"{_EVENTS} - {_SEG}", "exchanged segments": f"{_EVENTS}", "cut tail": f"{_EVENTS} - 7", "repeated entry": f"{_EVENTS} + 1",
}


@query("audit_status", " UNION ALL ".join(f"SELECT '{k}' AS log, ({n})::BIGINT AS entries, {str(k == 'intact').lower()} AS valid" for k, n in _KEPT.items()))
def audit_status(spark, sf):
    """The stored log and four ways to tamper with it that leave every link inside a segment as it was."""
    log = _log(spark, sf)
    root = cut(AU.root_of(log, _SEG))  # one row, compared with each log
    top = log.agg(F.max("seq")).first()[0]
    seq, part = F.col("seq"), F.floor(F.col("seq") / _SEG)
    other = F.when(part == 1, seq + _SEG).when(part == 2, seq - _SEG).otherwise(seq)
    logs = {
        "intact": log, "removed segment": log.filter(part != 3), "exchanged segments": log.withColumn("seq", other),
        "cut tail": log.filter(seq <= top - 7), "repeated entry": log.unionByName(log.filter(seq == 5)),
    }
    out = None
    for name, one in logs.items():
        row = AU.log_status(one, root, _SEG).select(F.lit(name).alias("log"), "entries", "valid")
        out = row if out is None else out.unionByName(row)
    return out


@query("audit_append", S.sql(["chain"], "SELECT seq, prev_hash, entry_hash FROM chain"))
def audit_append(spark, sf):
    """A third of the events is stored, the rest is appended; the log is as if it had been chained at once."""
    events = D.audit_events(spark, sf)
    cut_at = events.agg(F.floor(F.max("seq") / 3)).first()[0]
    path = _scratch(spark, "appended", sf)
    AU.append_events(stores.read_audit(spark, _empty(spark, path, events)), events.filter(F.col("seq") < cut_at), _SEG).write.mode("append").json(path)
    rest = events.filter(F.col("seq") >= cut_at).withColumn("seq", F.col("seq") - cut_at)
    AU.append_events(stores.read_audit(spark, path), rest, _SEG).write.mode("append").json(path)
    return stores.read_audit(spark, path).select("seq", "prev_hash", "entry_hash")


def _empty(spark, path, events):
    """An audit folder without entries yet."""
    events.limit(0).select("seq").write.json(path)
    return path


@query("roundtrip_audit", S.sql(["chain"], "SELECT a.seq, ts, event_type, details, prev_hash, entry_hash FROM audit a JOIN chain USING (seq)"))
def roundtrip_audit(spark, sf):
    return _log(spark, sf)


@query("audit_tail", S.sql(["chain"], "SELECT seq, event_type, entry_hash FROM audit JOIN chain USING (seq) ORDER BY seq DESC LIMIT 50"))
def audit_tail(spark, sf):
    log = D.audit_events(spark, sf).join(_chained(spark, sf).select("seq", "prev_hash", "entry_hash"), "seq")
    return AU.tail(log, 50).select("seq", "event_type", "entry_hash")


@query("audit_search", S.sql(["chain"], "SELECT seq, event_type, details FROM audit JOIN chain USING (seq) WHERE contains(lower(event_type), 'click') OR contains(lower(details), 'click') OR contains(lower(entry_hash), 'click')"))
def audit_search(spark, sf):
    log = D.audit_events(spark, sf).join(_chained(spark, sf).select("seq", "prev_hash", "entry_hash"), "seq")
    return AU.search(log, "CLICK").select("seq", "event_type", "details")


# --- streams --------------------------------------------------------------------------------------------------------
_STAGES = [("queued", "queued", 0), ("processing", "parsing", 15), ("processing", "detecting_pii", 35), ("completed", "completed", 100)]


def _job_events(events):
    stage = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in _STAGES])
    s = F.element_at(stage, (F.col("event_id") % 4 + 1).cast("int"))
    return events.select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit(".md")).alias("filename"),
        s["a"].alias("status"),
        s["b"].alias("stage"),
        s["c"].alias("progress_pct"),
        F.lit(None).cast("string").alias("error"),
        F.col("ts"),
    )


_JOBS = (
    "SELECT 'job-' || user_id AS job_id, 'f' || user_id || '.md' AS filename, arg_max(['queued', 'processing', 'processing', 'completed'][event_id % 4 + 1], event_id) AS status, "
    "arg_max(['queued', 'parsing', 'detecting_pii', 'completed'][event_id % 4 + 1], event_id) AS stage, arg_max([0, 15, 35, 100][event_id % 4 + 1], event_id)::BIGINT AS progress_pct FROM events GROUP BY user_id"
)


@query("job_states", _JOBS)
def job_states(spark, sf):
    return ingest.job_states(_job_events(D.table(spark, sf, "events"))).select("job_id", "filename", "status", "stage", F.col("progress_pct").cast("bigint").alias("progress_pct"))


@query("job_list", "SELECT 'job-' || user_id AS job_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') AS created FROM events GROUP BY user_id ORDER BY created DESC, job_id")
def job_list(spark, sf):
    """All jobs, newest first."""
    jobs = ingest.list_jobs(ingest.job_states(_job_events(D.table(spark, sf, "events"))))
    return jobs.select("job_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created"))


@query("stream_jobs", _JOBS)
def stream_jobs(spark, sf):
    """Job state kept by a streaming aggregate over the event files."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    states = ingest.job_states(_job_events(source)).select("job_id", "filename", "status", "stage", F.col("progress_pct").cast("bigint").alias("progress_pct"))
    out = _scratch(spark, "jobs", sf)

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/state")

    run = _unique(out)
    q = states.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/state")


# Seven events in a row are a job: one of four stops after its fifth event, one of four fails. A day without news is a time-out.
_LOTS = """jev AS (SELECT event_id // 7 AS j, event_id % 7 AS step, event_id, ts FROM events)"""
_JOB_STAGES = ["queued", "parsing", "tokenizing", "tokenizing", "tokenizing", "building_graph", "completed"]
_DAY = 86400
_PROGRESS = f"""WITH {_LOTS},
  told AS (SELECT *, CASE WHEN step = 6 AND j % 4 = 2 THEN 'failed' ELSE {S.values_list(_JOB_STAGES)}[step + 1] END AS stage FROM jev WHERE NOT (j % 4 = 3 AND step > 4)),
  last AS (SELECT j, arg_max(stage, event_id) AS stage, arg_max(step, event_id) AS step, max(ts) AS ts, min(ts) AS created FROM told GROUP BY 1),
  timed AS (SELECT *, stage NOT IN ('completed', 'failed') AND epoch_ms(ts) + 2000 * {_DAY} <= (SELECT epoch_ms(max(ts)) FROM told) AS late FROM last)
  SELECT 'job-' || j AS job_id, CASE WHEN late THEN 'failed' WHEN stage IN ('queued', 'completed', 'failed') THEN stage ELSE 'processing' END AS status, CASE WHEN late THEN 'failed' ELSE stage END AS stage,
    CASE WHEN late THEN 100 WHEN stage = 'tokenizing' THEN 35 + ((step - 1) * 35) // 7 WHEN stage = 'queued' THEN 0 WHEN stage = 'parsing' THEN 15 WHEN stage = 'building_graph' THEN 80 ELSE 100 END::BIGINT AS progress_pct,
    CASE WHEN late THEN 'no progress for {_DAY} seconds' WHEN stage = 'failed' THEN 'broken header' END AS error, strftime(created, '%Y-%m-%dT%H:%M:%S.%f') AS created FROM timed"""


@query("job_progress", _PROGRESS)
def job_progress(spark, sf):
    """Jobs whose events come in two lots, out of order around the cut, some twice; stalled ones time out."""
    from tokengraph.streaming import jobs

    e = D.table(spark, sf, "events").select(F.col("event_id"), F.col("ts").cast("timestamp").alias("ts"))
    job, step = F.floor(F.col("event_id") / 7), F.col("event_id") % 7
    stage = F.when((step == 6) & (job % 4 == 2), "failed").otherwise(F.element_at(F.array(*[F.lit(x) for x in _JOB_STAGES]), (step + 1).cast("int")))
    told = e.filter(~((job % 4 == 3) & (step > 4))).select(
        F.concat(F.lit("job-"), job.cast("string")).alias("job_id"), F.col("event_id").alias("seq"), F.concat(F.lit("f"), job.cast("string"), F.lit(".md")).alias("filename"), stage.alias("stage"),
        (step - 1).cast("bigint").alias("done"), F.lit(7).cast("bigint").alias("total"), F.when(stage == "failed", "broken header").alias("error"), "ts",
    )
    ends = e.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    middle = ends["low"] + (ends["high"] - ends["low"]) * 0.6
    near = F.abs(F.unix_seconds("ts") - F.unix_seconds(F.lit(middle))) < _DAY // 2
    swapped = near & (F.col("seq") % 7).isin(2, 5)  # these come early or late, within the delay
    first = (F.col("ts") <= F.lit(middle)) != swapped
    base = _unique(_scratch(spark, "job-events", sf))
    again = told.filter(first & (F.col("seq") % 5 == 0))
    for lot in (told.filter(first), told.filter(~first).unionByName(again)):
        lot.write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(jobs.EVENTS).parquet(f"{base}/in")
        jobs.run_tracking(source, f"{base}/out", f"{base}/checkpoint", _DAY, "1 day").awaitTermination()
    table = jobs.job_table(spark, f"{base}/out")
    return table.select("job_id", "status", "stage", F.col("progress_pct").cast("bigint").alias("progress_pct"), "error", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created"))


def _unique(base: str) -> str:
    import uuid

    return f"{base}/{uuid.uuid4().hex}"



@query("stream_ingest", ORACLES["tokenize_text"])
def stream_ingest(spark, sf):
    """Documents arriving as files: each micro-batch is detected, tokenized and stored under its batch id."""
    from tokengraph.operators import detect as DT
    from tokengraph.operators import tokens

    base = _unique(_scratch(spark, "ingest", sf))
    D.seeded_text(spark, sf).write.parquet(f"{base}/in")
    source = spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", 100).parquet(f"{base}/in")

    def work(batch):
        return tokens.tokenize(DT.detect(batch), D.KEY).select("doc_id", "tokenized")

    q = ingest.run_ingestion(source, work, f"{base}/out", f"{base}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("doc_id", F.md5("tokenized").alias("text_hash"), F.length("tokenized").cast("bigint").alias("n"))
