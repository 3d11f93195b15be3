"""Document registry, totals, and deletion over all stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokengraph.operators import graph as G
from tokengraph.operators import vault as V


def register(meta: DataFrame, entity_counts: DataFrame, triple_counts: DataFrame) -> DataFrame:
    """One row per document, last write wins: ``meta`` has doc_id, title, classification, department, author, created, ord."""
    cols = ["title", "classification", "department", "author", "created"]
    last = meta.groupBy("doc_id").agg(F.max(F.struct("ord", *cols)).alias("_m")).select("doc_id", *[f"_m.{c}" for c in cols])
    return (
        last.join(entity_counts, "doc_id", "left")
        .join(triple_counts, "doc_id", "left")
        .withColumn("entity_count", F.coalesce("entity_count", F.lit(0)).cast("bigint"))
        .withColumn("triple_count", F.coalesce("triple_count", F.lit(0)).cast("bigint"))
    )


def upsert_registry(registry: DataFrame, fresh: DataFrame) -> DataFrame:
    """Replace rows of re-ingested documents."""
    return registry.join(fresh.select("doc_id"), "doc_id", "left_anti").unionByName(fresh)


def get_document(registry: DataFrame, doc_id: str) -> DataFrame:
    return registry.filter(F.col("doc_id") == doc_id)


def kpis(registry: DataFrame) -> DataFrame:
    return registry.agg(
        F.count("*").alias("documents"),
        F.coalesce(F.sum("entity_count"), F.lit(0)).alias("entities"),
        F.coalesce(F.sum("triple_count"), F.lit(0)).alias("triples"),
        F.count_distinct("department").alias("departments"),
    )


def system_counts(registry: DataFrame, nodes: DataFrame, edges: DataFrame, vault: DataFrame) -> DataFrame:
    """(metric, value) for documents, nodes, edges and tokens."""
    out = None
    for name, df in (("documents", registry), ("graph_nodes", nodes), ("graph_edges", edges), ("vault_tokens", vault)):
        one = df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def delete_documents(
    registry: DataFrame,
    edges: DataFrame,
    nodes: DataFrame,
    node_docs: DataFrame,
    vault: DataFrame,
    doc_ids: DataFrame,
    owner: str = "first",
    refs: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """New versions of every store and the counts for the audit row; publish them together."""
    kept_edges, kept_nodes, kept_docs = G.remove_documents(edges, nodes, node_docs, doc_ids)
    kept_vault = V.purge(vault, doc_ids, refs, owner)
    kept_registry = registry.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")
    parts = [
        ("edges_removed", edges, kept_edges),
        ("nodes_removed", nodes, kept_nodes),
        ("tokens_purged", vault, kept_vault),
        ("documents_removed", registry, kept_registry),
    ]
    counts = None
    for name, before, after in parts:
        for df, sign in ((before, 1), (after, -1)):
            one = df.agg((F.count("*") * sign).alias("n")).select(F.lit(name).alias("metric"), "n")
            counts = one if counts is None else counts.unionByName(one)
    return {
        "registry": kept_registry,
        "edges": kept_edges,
        "nodes": kept_nodes,
        "node_docs": kept_docs,
        "vault": kept_vault,
        "counts": counts.groupBy("metric").agg(F.sum("n").alias("value")),
    }


def deletion_event(counts: DataFrame) -> DataFrame:
    """One DOCUMENT_DELETED audit row (event_type, details) from the counts of ``delete_documents``."""
    # Four metrics at most, so the list is small. Keys are sorted, with spaces after separators: the form that is hashed.
    pair = F.concat(F.lit('"'), "metric", F.lit('": '), F.col("value").cast("string"))
    details = F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(pair)), ", "), F.lit("}"))
    return counts.agg(details.alias("details")).select(F.lit("DOCUMENT_DELETED").alias("event_type"), "details")
