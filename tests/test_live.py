"""Batches merged into bucketed stores."""

import pytest
from pyspark.sql import functions as F

from test_flows import AES, ALL, KEY, files
from test_tables import HEADER, TABLE
from tokengraph.functions.ordered import number_rows
from tokengraph.operators import audit as AU
from tokengraph.operators import graph as G
from tokengraph.operators import vault as V
from tokengraph.plans import flows
from tokengraph.sources.live import TABLES, LiveStore

FULL = HEADER.replace("    - PERSON\n    - SSN\n", ALL)


def doc(i, body):
    return FULL.replace("PAY-77", f"D-{i:02d}") + "\n" + body + "\n"


PEOPLE = ["Wendel Arkwright", "Ngaio Petrosyan", "Hollis Wren", "Tamsin Oyelaran", "Ottilie Brandvold"]
DOCS = [doc(i, f"{PEOPLE[i % 5]} (SSN: 907-31-55{i % 5}8) earns $9{i % 5},600/year.\n\nHe reports to {PEOPLE[(i + 1) % 5]}.") for i in range(8)] + [FULL.replace("PAY-77", "D-90") + TABLE]


def rows(store, name, version=None):
    df = store.read(name, version=version)
    if name == "vault":
        df = V.unseal(df, AES)
    drop = [c for c in ("payload", "created_at", "accessed_at", "ts", "prev_hash", "entry_hash", "ord") if c in df.columns]
    return sorted(map(repr, df.drop(*drop).collect()))


def test_batches_equal_one_ingestion_and_replays_change_nothing(spark, tmp_path):
    one, many = LiveStore(spark, str(tmp_path / "one"), 8), LiveStore(spark, str(tmp_path / "many"), 8)
    flows.ingest_batch(one, files(spark, *DOCS), KEY, AES, 0)
    for batch, part in enumerate((DOCS[:3], DOCS[3:4], DOCS[4:])):
        assert flows.ingest_batch(many, files(spark, *part), KEY, AES, batch) is not None
    assert many.pointer() == (3, 2)
    for name in TABLES:
        assert rows(one, name) == rows(many, name), name
    before = many.buckets_of()
    assert flows.ingest_batch(many, files(spark, *DOCS[4:]), KEY, AES, 2) is None
    assert many.pointer() == (3, 2) and many.buckets_of() == before

    # Degrees are those of the edges, and the log is one valid chain.
    counted = {r["id"]: r["degree"] for r in G.degrees(many.read("edges")).collect()}
    assert {r["id"]: r["degree"] for r in many.read("degrees").collect()} == counted
    log = many.read("audit")
    assert sorted(r["seq"] for r in log.collect()) == list(range(len(DOCS)))
    assert AU.chain_status(AU.verify_contents(AU.verify_links(log))).first().valid

    # Documents leave all stores; what is left equals an ingestion without them.
    gone = spark.createDataFrame([("D-90",), ("D-03",)], "doc_id string")
    counts = {r["metric"]: r["value"] for r in flows.delete_from_store(many, gone).collect()}
    assert counts["documents_removed"] == 2 and counts["edges_removed"] > 0 and counts["nodes_removed"] > 0
    assert many.read("edges").join(gone, "doc_id").count() == 0
    ends = many.read("edges").select(F.explode(F.array("source", "target")).alias("id")).distinct()
    assert ends.join(many.read("nodes"), "id", "left_anti").count() == 0
    assert many.read("nodes").join(ends, "id", "left_anti").join(many.read("node_docs"), "id", "left_anti").count() == 0
    assert many.read("audit").orderBy(F.col("seq").desc()).first()["event_type"] == "DOCUMENT_DELETED"
    assert AU.chain_status(AU.verify_contents(AU.verify_links(many.read("audit")))).first().valid
    assert rows(many, "edges", version=3) != rows(many, "edges")  # an earlier version can still be read


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = LiveStore(spark, str(tmp_path), 64)
    flows.ingest_batch(store, files(spark, *DOCS[:5]), KEY, AES, 0)
    held = store.buckets_of()
    flows.ingest_batch(store, files(spark, doc(50, "Quill Zander has SSN 955-12-7777.")), KEY, AES, 1)
    now = store.buckets_of()
    fresh = {k for k, v in now.items() if v == 2}
    assert all(now[k] == v for k, v in held.items() if k not in fresh)
    assert 0 < len({b for n, b in fresh if n == "vault"}) <= 2 and len({b for n, b in fresh if n == "edges"}) == 1


def test_breaker_counts_stored_edges(spark, tmp_path):
    store = LiveStore(spark, str(tmp_path), 4)
    several = lambda i, n: doc(i, " ".join(f"Wendel Arkwright reports to place {i}x{j}." for j in range(n)))
    flows.ingest_batch(store, files(spark, several(1, 6)), KEY, AES, 0, edge_limit=10)
    with pytest.raises(ValueError, match="reached 10 edges"):
        flows.ingest_batch(store, files(spark, several(2, 6)), KEY, AES, 1, edge_limit=10)
    assert store.pointer() == (1, 0)
    flows.ingest_batch(store, files(spark, several(3, 4)), KEY, AES, 1, edge_limit=10)
    with pytest.raises(ValueError, match="contamination"):
        flows.ingest_batch(store, files(spark, several(4, 1)), KEY, AES, 2, edge_limit=10)


def test_breaker_with_stored_degrees_equals_a_plain_count(spark):
    import random

    r = random.Random(5)
    pairs = [(i, f"n{r.randrange(6)}", f"n{r.randrange(12)}") for i in range(90)]
    edges = spark.createDataFrame(pairs, "ord int, source string, target string").repartition(7)
    for limit, cutoff in ((5, 40), (20, 45), (60, 30), (8, 0)):
        stored = G.add_degrees(spark.createDataFrame([], "id string, degree bigint"), edges.filter(F.col("ord") < cutoff))
        got = sorted((x["id"], x["ord"], x["edges_before"]) for x in G.breaker_violations(edges.filter(F.col("ord") >= cutoff), limit, stored, shares=3).collect())
        seen, want = {}, {}
        for i, a, b in pairs:
            if i >= cutoff and seen.get(a, 0) >= limit:
                want.setdefault(a, (a, i, seen[a]))
            for n in (a, b):
                seen[n] = seen.get(n, 0) + 1
        assert got == sorted(want.values())


def test_numbers_follow_the_order(spark):
    data = [(i % 3 if i % 2 else None, (i * 37) % 101) for i in range(300)]
    df = spark.createDataFrame(data, "k int, v int").repartition(6)
    alone = sorted((x["n"], x["v"]) for x in number_rows(df.select("v"), ["v"], "n").collect())
    assert [n for n, _ in alone] == list(range(300)) and [v for _, v in alone] == sorted(v for _, v in data)
    got = number_rows(df, ["v"], "n", ["k"]).collect()
    for k in (None, 0, 1, 2):
        mine = sorted((x["n"], x["v"]) for x in got if x["k"] == k)
        assert [n for n, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for a, v in data if a == k)
    assert number_rows(df.limit(0), ["v"], "n").count() == 0


def test_jobs_time_out_resume_and_take_events_in_any_order(spark, tmp_path):
    from tokengraph.streaming import jobs

    assert [jobs.percent("tokenizing", i, 10) for i in (0, 3, 10)] == [35, 45, 70] and jobs.percent("tokenizing", 1, 0) == 35

    def event(job, seq, stage, minute, done=None, total=None, error=None):
        return (job, seq, f"{job}.md", stage, done, total, error, f"2026-01-01 {minute // 60:02d}:{minute % 60:02d}:00")

    lots = [
        [event("a", 3, "tokenizing", 30, 4, 10), event("a", 1, "queued", 10), event("b", 1, "queued", 5), event("c", 9, "completed", 9), event("clock", 1, "queued", 60)],
        [event("a", 2, "parsing", 20), event("c", 8, "building_graph", 8), event("d", 1, "queued", 62), event("d", 1, "queued", 62), event("clock", 2, "parsing", 160)],
        [event("b", 2, "parsing", 210), event("d", 2, "failed", 211, error="broken"), event("clock", 3, "completed", 400)],
    ]
    seen = []
    for lot in lots:
        rows = spark.createDataFrame(lot, jobs.EVENTS.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(jobs.EVENTS).parquet(str(tmp_path / "in"))
        jobs.run_tracking(source, str(tmp_path / "out"), str(tmp_path / "checkpoint"), 3600, "1 hour").awaitTermination()
        seen.append({r["job_id"]: r for r in jobs.job_table(spark, str(tmp_path / "out")).collect()})
    assert (seen[0]["a"]["stage"], seen[0]["a"]["progress_pct"], seen[0]["a"]["status"]) == ("tokenizing", 49, "processing")
    assert seen[0]["c"]["status"] == seen[1]["c"]["status"] == "completed"
    # The second lot moves the watermark to 1:40: a (0:30 and an hour) and b have failed, d (1:02) has not.
    assert {j: seen[1][j]["status"] for j in "abd"} == {"a": "failed", "b": "failed", "d": "queued"}
    assert seen[1]["a"]["error"] == "no progress for 3600 seconds" and seen[1]["a"]["progress_pct"] == 100
    # b reports again, and then says nothing until the clock is far ahead.
    assert (seen[2]["d"]["status"], seen[2]["d"]["error"]) == ("failed", "broken")
    assert (seen[2]["b"]["status"], seen[2]["b"]["updated_at"].hour, seen[2]["clock"]["status"]) == ("failed", 3, "completed")
