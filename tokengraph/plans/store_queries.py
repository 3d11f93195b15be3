"""Queries over stores that batches, streams and deletions change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokengraph.operators import graph as G
from tokengraph.operators import vault as V
from tokengraph.plans import derive as D
from tokengraph.plans import flows
from tokengraph.plans import sql as S
from tokengraph.plans import table_queries  # noqa: F401  (its SQL building blocks are used here)
from tokengraph.plans.graph_queries import _scratch
from tokengraph.plans.registry import query
from tokengraph.sources.live import LiveStore
from tokengraph.streaming import ingest

# --- what the staff files hold, as SQL ------------------------------------------------------------------------------
# Files with an even number arrive first (batch 0), the others later (batch 1).
S.CTE["fstaff"] = (["staff"], f"SELECT *, k // {D.PER_DOCUMENT} AS n, 'STF-' || {S.padded(f'k // {D.PER_DOCUMENT}', 7)} AS d, (k // {D.PER_DOCUMENT}) % 2 AS batch FROM staff")
S.CTE["fents"] = (
    ["fstaff"],
    f"""SELECT *, {S.token_from('t', 'dig')} AS token FROM (SELECT *, {S.digest('t', 'v')} AS dig FROM (
      SELECT batch, d, k, 0 AS s, 0 AS p, 'PERSON' AS t, name AS v FROM fstaff
      UNION ALL SELECT batch, d, k, 0, 1, 'PERSON', department FROM fstaff WHERE contains(department, ' ')
      UNION ALL SELECT batch, d, k, 0, 2, 'US_SSN', ssn FROM fstaff
      UNION ALL SELECT batch, d, k, 1, 0, 'SALARY', salary FROM fstaff
      UNION ALL SELECT batch, d, k, 1, 1, 'PERSON', manager FROM fstaff WHERE manager IS NOT NULL
      UNION ALL SELECT batch, d, k, 2, 0, 'PERSON', 'Orchard Hill' FROM fstaff WHERE k % 2 = 0
      UNION ALL SELECT batch, d, k, 2, 0, 'EMAIL_ADDRESS', email FROM fstaff WHERE k % 2 = 1
      UNION ALL SELECT batch, d, k, 2, 1, 'PERSON', name FROM fstaff WHERE k % 2 = 1))""",
)
S.CTE["ftriples"] = (["triples", "fstaff"], "SELECT f.batch, f.d, f.k, sent_idx, row_number() OVER (PARTITION BY sent_idx ORDER BY predicate) AS i, subject, predicate, object FROM triples JOIN fstaff f ON f.k = sent_idx // 3")
S.CTE["fvault"] = (["fents"], "SELECT token, v AS value, d FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY batch, d, k, s, p) AS r FROM fents) WHERE r = 1")
S.CTE["fedges"] = (["ftriples"], "SELECT subject AS source, predicate, object AS target, d FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate, object ORDER BY batch, d, sent_idx) AS r FROM ftriples) WHERE r = 1")
S.CTE["freg"] = (
    ["fents", "ftriples"],
    """SELECT d, n, batch, e, coalesce(c, 0) AS c FROM (SELECT d, min(n) AS n, min(batch) AS batch FROM fstaff GROUP BY 1)
      JOIN (SELECT d, count(*) AS e FROM fents GROUP BY 1) USING (d) LEFT JOIN (SELECT d, count(*) AS c FROM ftriples GROUP BY 1) USING (d)""",
)
S.CTE["fends"] = (["fedges"], "SELECT source AS id FROM fedges UNION ALL SELECT target FROM fedges")
_STORES = """SELECT 'vault' AS kind, token AS a, value AS b, d AS c, 0::BIGINT AS n FROM fvault
  UNION ALL SELECT 'reference', token, '', d, 0 FROM (SELECT DISTINCT token, d FROM fents)
  UNION ALL SELECT 'edge', source, predicate || ' ' || target, d, 0 FROM fedges
  UNION ALL SELECT 'node', id, '', '', count(*) FROM fends GROUP BY id
  UNION ALL SELECT 'node document', id, '', d, 0 FROM (SELECT subject AS id, d FROM ftriples UNION SELECT object, d FROM ftriples)
  UNION ALL SELECT 'document', d, 'Staff ' || n, c::VARCHAR, e FROM freg
  UNION ALL SELECT 'event', 'DOCUMENT_INGESTED', '{"doc_id": "' || d || '", "entities_detected": ' || e || ', "title": "Staff ' || n || '", "triples_extracted": ' || c || '}', '', row_number() OVER (ORDER BY batch, d) - 1 FROM freg"""


def contents(store: LiveStore) -> DataFrame:
    """Everything in the stores as (kind, a, b, c, n)."""
    none, zero = F.lit("").alias("b"), F.lit(0).cast("bigint").alias("n")
    vault = V.unseal(store.read("vault"), D.AES_KEY)
    nodes = store.read("nodes").select("id").join(store.read("degrees"), "id", "left")
    parts = [
        vault.select(F.lit("vault").alias("kind"), F.col("token").alias("a"), F.col("value").alias("b"), F.col("first_doc_id").alias("c"), zero),
        store.read("references").select(F.lit("reference"), "token", none, "doc_id", zero),
        store.read("edges").select(F.lit("edge"), "source", F.concat_ws(" ", "predicate", "target"), "doc_id", zero),
        nodes.select(F.lit("node"), "id", none, F.lit(""), F.coalesce("degree", F.lit(0))),
        store.read("node_docs").select(F.lit("node document"), "id", none, "doc_id", zero),
        store.read("registry").select(F.lit("document"), "doc_id", "title", F.col("triple_count").cast("string"), "entity_count"),
        store.read("audit").select(F.lit("event"), "event_type", "details", F.lit(""), "seq"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _streamed(spark, sf) -> LiveStore:
    """Staff files that arrive in two lots, each one micro-batch; then the second batch is run again."""
    base = _scratch(spark, "live", sf)
    docs = D.staff_documents(spark, sf)
    store = LiveStore(spark, f"{base}/store", 16)
    for lot in (0, 1):
        # One file per document, in a folder of its own.
        arrived = docs.filter(F.col("n") % 2 == lot).select("doc_id", "content").repartition("doc_id")
        arrived.write.mode("append").partitionBy("doc_id").text(f"{base}/in")
        ingest.run_store_ingestion(ingest.document_stream(spark, f"{base}/in"), store, D.KEY, D.AES_KEY, f"{base}/checkpoint").awaitTermination()
    flows.ingest_batch(store, docs.filter("n % 2 = 1").select("path", "content"), D.KEY, D.AES_KEY, 1)
    return store


@query("stream_ingest_stores", S.sql(["fvault", "fends", "freg"], _STORES))
def stream_ingest_stores(spark, sf):
    """Arriving files through the whole ingestion: all stores equal one ingestion of all files, also after a replay."""
    return contents(_streamed(spark, sf))


# Deleting every third document. Tokens go with the document that stored them first, nodes with their last edge and document.
_KEPT_STORES = """keptedges AS MATERIALIZED (SELECT * FROM fedges WHERE d NOT IN (SELECT d FROM gone)),
  keptdocs AS MATERIALIZED (SELECT subject AS id, d FROM ftriples WHERE d NOT IN (SELECT d FROM gone) UNION SELECT object, d FROM ftriples WHERE d NOT IN (SELECT d FROM gone)),
  keptends AS MATERIALIZED (SELECT source AS id FROM keptedges UNION ALL SELECT target FROM keptedges)"""


@query(
    "store_delete",
    S.sql(
        ["fvault", "fends", "freg"],
        """SELECT 'vault' AS kind, token AS a, value AS b, d AS c, 0::BIGINT AS n FROM fvault WHERE d NOT IN (SELECT d FROM gone)
  UNION ALL SELECT 'reference', token, '', d, 0 FROM (SELECT DISTINCT token, d FROM fents) WHERE d NOT IN (SELECT d FROM gone)
  UNION ALL SELECT 'edge', source, predicate || ' ' || target, d, 0 FROM keptedges
  UNION ALL SELECT 'node', id, '', '', sum(c) FROM (SELECT id, 1::BIGINT AS c FROM keptends UNION ALL SELECT DISTINCT id, 0 FROM keptdocs) GROUP BY id
  UNION ALL SELECT 'node document', id, '', d, 0 FROM keptdocs
  UNION ALL SELECT 'document', d, 'Staff ' || n, c::VARCHAR, e FROM freg WHERE d NOT IN (SELECT d FROM gone)""",
        "gone AS (SELECT DISTINCT d FROM fstaff WHERE n % 3 = 1), " + _KEPT_STORES,
    ),
)
def store_delete(spark, sf):
    """Documents taken out of the stores again, by the buckets that hold something of them."""
    store = _streamed(spark, sf)
    flows.delete_from_store(store, D.staff_documents(spark, sf).filter("n % 3 = 1").select("doc_id"))
    return contents(store).filter("kind <> 'event'")


_LIMIT = 12


@query(
    "degree_breaker_stored",
    S.sql(
        ["edges"],
        f"""SELECT id, min(ord) AS ord, arg_min(before, ord) AS edges_before FROM (
          SELECT id, ord, is_subject, count(*) OVER (PARTITION BY id ORDER BY late, ord RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY id, late, ord) AS before, late FROM (
            SELECT source AS id, ord, true AS is_subject, ord % 2 AS late FROM edges UNION ALL SELECT target, ord, false, ord % 2 FROM edges))
        WHERE is_subject AND late = 1 AND before >= {_LIMIT} GROUP BY 1""",
    ),
)
def degree_breaker_stored(spark, sf):
    """Half of the edges are stored as degrees; the others come after them and are counted on top."""
    edges = G.edges_from(D.staff_facts(spark, sf))
    stored = G.add_degrees(spark.createDataFrame([], "id string, degree bigint"), edges.filter("ord % 2 = 0"))
    return G.breaker_violations(edges.filter("ord % 2 = 1"), _LIMIT, stored)


# --- delimited tables -----------------------------------------------------------------------------------------------
# One semicolon table per hundred people; a third of the notes runs over a line end, a third holds quotes.
_NOTES = "CASE k % 3 WHEN 0 THEN 'seen twice,' || chr(10) || 'last on day ' || k WHEN 1 THEN 'quiet \"one\"; still here' ELSE '' END"
S.CTE["csvfacts"] = (
    ["fstaff"],
    f"""SELECT n, row_number() OVER (PARTITION BY n ORDER BY k, c) - 1 AS sent_idx, text, ents FROM (
      SELECT n, k, 1 AS c, {S.token(S.q('PERSON'), 'name')} || ' earns ' || {S.token(S.q('SALARY'), 'salary')} || '.' AS text, 2 AS ents FROM fstaff
      UNION ALL SELECT n, k, 2, {S.token(S.q('PERSON'), 'name')} || ' has email ' || {S.token(S.q('EMAIL_ADDRESS'), 'email')} || '.', 2 FROM fstaff
      UNION ALL SELECT n, k, 3, {S.token(S.q('PERSON'), 'name')} || ' reports to ' || {S.token(S.q('PERSON'), 'manager')} || '.', 2 FROM fstaff WHERE manager IS NOT NULL
      UNION ALL SELECT n, k, 4, {S.token(S.q('PERSON'), 'name')} || ' has notes ' || {_NOTES} || '.', 1 FROM fstaff WHERE k % 3 <> 2)""",
)


@query(
    "csv_ingest",
    S.sql(["csvfacts"], "SELECT 'sentence' AS kind, text, sent_idx AS n FROM csvfacts UNION ALL SELECT 'file', count(*)::VARCHAR, sum(ents)::BIGINT FROM csvfacts GROUP BY csvfacts.n"),
)
def csv_ingest(spark, sf):
    """Many tables read in one job, their columns typed, every fact worded, tokenized and counted."""
    path = _scratch(spark, "tables", sf)
    k = F.col("k")
    notes = F.when(k % 3 == 0, F.concat(F.lit("seen twice,\nlast on day "), k.cast("string"))).when(k % 3 == 1, 'quiet "one"; still here').otherwise("")
    rows = D.staff(spark, sf).select(
        F.floor(k / D.PER_DOCUMENT).alias("n"), "k", F.col("name").alias("Employee"), F.col("salary").alias("Salary"), F.col("email").alias("Email"), F.col("manager").alias("Manager"), notes.alias("Notes")
    )
    written = rows.repartition("n").sortWithinPartitions("n", "k").drop("k").write.partitionBy("n")
    written.options(header=True, sep=";", quote='"', escape='"', emptyValue="", nullValue="").csv(path)
    done = flows.ingest_documents(flows.prepare_tables(spark, path), D.KEY, D.AES_KEY, None)
    sentences = done.sentences.select(F.lit("sentence").alias("kind"), "text", F.col("sent_idx").alias("n"))
    sizes = done.sentences.groupBy("doc_id").agg(F.count("*").cast("string").alias("text"))
    return sentences.unionByName(sizes.join(done.registry, "doc_id").select(F.lit("file").alias("kind"), "text", F.col("entity_count").alias("n")))
