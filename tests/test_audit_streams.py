"""Audit chain, registry, stores, streams."""

import hashlib
import json

from pyspark.sql import functions as F

from tokengraph.operators import audit as AU
from tokengraph.operators import registry as REG
from tokengraph.sources import delimited, stores
from tokengraph.streaming import ingest


def events(spark, n):
    return spark.range(n).select(
        F.col("id").alias("seq"), F.lit("QUERY_SENT").alias("event_type"),
        F.concat(F.lit('{"n": '), F.col("id").cast("string"), F.lit("}")).alias("details"), F.lit("2026-01-01T00:00:00").alias("ts"),
    )


def test_chain_equals_canonical_json_hash(spark):
    rows = {r.seq: r for r in AU.chain_entries(events(spark, 25), segment=10).collect()}
    prev = "GENESIS"
    for i in range(25):
        if i % 10 == 0:
            prev = "GENESIS"
        entry = {"timestamp": "2026-01-01T00:00:00", "event_type": "QUERY_SENT", "details": {"n": i}, "prev_hash": prev}
        want = hashlib.sha256(json.dumps(entry, sort_keys=True).encode()).hexdigest()
        assert (rows[i].prev_hash, rows[i].entry_hash) == (prev, want)
        prev = want


def test_verification_and_seal_notice_changes(spark, tmp_path):
    ev = events(spark, 250)
    log = ev.join(AU.chain_entries(ev, 10).select("seq", "prev_hash", "entry_hash"), "seq")
    stores.append_audit(log, str(tmp_path / "audit"))
    back = stores.read_audit(spark, str(tmp_path / "audit"))
    ok = AU.chain_status(AU.verify_contents(AU.verify_links(back, 10))).first()
    assert (ok.entries, ok.valid) == (250, True)
    bent = back.withColumn("details", F.when(F.col("seq") == 17, '{"n": 0}').otherwise(F.col("details")))
    assert not AU.chain_status(AU.verify_contents(AU.verify_links(bent, 10))).first().valid
    cut_out = back.filter("seq <> 17")
    assert not AU.chain_status(AU.verify_links(cut_out, 10)).first().valid
    root = AU.seal(AU.chain_entries(ev, 10), 249, 10).collect()
    assert len(root) == 1 and root[0].n == 250
    other = AU.seal(AU.chain_entries(ev.withColumn("ts", F.when(F.col("seq") == 3, "x").otherwise(F.col("ts"))), 10), 249, 10).first()
    assert other.end_hash != root[0].end_hash
    assert [r.seq for r in AU.tail(back, 3).collect()] == [247, 248, 249]
    assert AU.search(back, '"N": 17}').count() == 1
    assert not AU.chain_status(AU.verify_links(back.limit(0), 10)).first().valid


def test_registry_last_write_wins(spark):
    meta = spark.createDataFrame([("d", "old", "PUBLIC", "HR", "a", None, 1), ("d", "new", "PUBLIC", "HR", "a", None, 2)], "doc_id string, title string, classification string, department string, author string, created date, ord int")
    counts = spark.createDataFrame([("d", 6)], "doc_id string, entity_count bigint")
    trip = spark.createDataFrame([("d", 3)], "doc_id string, triple_count bigint")
    reg = REG.register(meta, counts, trip)
    row = REG.get_document(reg, "d").first()
    assert (row.title, row.entity_count, row.triple_count) == ("new", 6, 3)
    assert tuple(REG.kpis(reg).first()) == (1, 6, 3, 1)
    assert REG.upsert_registry(reg, reg.withColumn("title", F.lit("x"))).first().title == "x"


def test_versions_switch_together(spark, tmp_path):
    base = str(tmp_path / "store")
    stores.publish({"a": spark.range(1), "b": spark.range(2)}, base, 1)
    stores.publish({"a": spark.range(5), "b": spark.range(6)}, base, 2)
    assert stores.current_version(spark, base) == 2
    assert stores.load(spark, base, "a").count() == 5 and stores.load(spark, base, "b", 1).count() == 2


def test_files_are_ingested_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.md").write_text("one two")
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    work = lambda b: b.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.size(F.split("content", " ")).alias("words"))
    ingest.run_ingestion(ingest.document_stream(spark, str(inbox)), work, out, mark).awaitTermination()
    (inbox / "b.md").write_text("three")
    ingest.run_ingestion(ingest.document_stream(spark, str(inbox)), work, out, mark).awaitTermination()
    got = sorted((r.file, r.words) for r in spark.read.parquet(out).collect())
    assert got == [("a.md", 2), ("b.md", 1)]


def test_job_progress_and_latest_state(spark):
    assert [ingest.progress(i, 4) for i in range(4)] == [35, 43, 52, 61]
    ev = spark.createDataFrame(
        [("j", 1, "f", "queued", "queued", 0, None, "2026-01-01 00:00:00"), ("j", 3, "f", "failed", "failed", 100, "boom", "2026-01-01 00:02:00"), ("j", 2, "f", "processing", "parsing", 15, None, "2026-01-01 00:01:00")],
        "job_id string, seq bigint, filename string, status string, stage string, progress_pct int, error string, ts string",
    ).withColumn("ts", F.to_timestamp("ts"))
    row = ingest.get_job(ingest.list_jobs(ingest.job_states(ev)), "j").first()
    assert (row.status, row.progress_pct, row.error) == ("failed", 100, "boom") and row.created_at < row.updated_at


def test_document_delete_event(spark):
    counts = spark.createDataFrame([("edges_removed", 2), ("nodes_removed", 3)], "metric string, value bigint")
    row = REG.deletion_event(counts).first()
    assert row.event_type == "DOCUMENT_DELETED" and json.loads(row.details) == {"edges_removed": 2, "nodes_removed": 3}


def test_tables_without_data_rows_are_rejected(spark):
    files = spark.createDataFrame([("a.csv",), ("b.csv",), ("c.csv",)], "path string")
    lines = spark.createDataFrame([("a.csv", "h"), ("a.csv", "1"), ("b.csv", "h"), ("b.csv", "  ")], "path string, value string")
    assert sorted(r.path for r in delimited.empty_tables(files, lines).collect()) == ["b.csv", "c.csv"]


def test_log_status_exchanges_hashes_once(spark):
    """Of the stored texts nothing is exchanged, and of the hashes one copy; every kind of tampering still shows."""
    events = spark.range(25).select(
        F.col("id").alias("seq"), F.lit("t").alias("ts"), F.lit("ALERT").alias("event_type"), F.concat(F.lit('{"n": '), F.col("id").cast("string"), F.lit("}")).alias("details")
    )
    rows = events.join(AU.chain_entries(events, 4).select("seq", "prev_hash", "entry_hash"), "seq").collect()
    log = spark.createDataFrame(rows, "seq bigint, ts string, event_type string, details string, prev_hash string, entry_hash string")
    dealt = [x for x in AU.checked_segments(log, 4)._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
    assert len(dealt) == 1
    plan = AU.checked_segments(log, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    root = AU.root_of(log, 4)
    seq = F.col("seq")
    logs = {
        "same": (log, 25, True), "hash": (log.withColumn("entry_hash", F.when(seq == 9, "forged").otherwise(F.col("entry_hash"))), 25, False),
        "link": (log.withColumn("prev_hash", F.when(seq == 8, "forged").otherwise(F.col("prev_hash"))), 25, False), "gap": (log.filter(seq != 6), 24, False),
        "text": (log.withColumn("details", F.when(seq == 3, "{}").otherwise(F.col("details"))), 25, False), "tail": (log.filter(seq < 20), 20, False),
        "twice": (log.unionByName(log.filter(seq == 24)), 26, False), "empty": (log.limit(0), 0, False),
    }
    for name, (one, n, valid) in logs.items():
        assert AU.log_status(one, root, 4).collect() == [(n, valid)], name
