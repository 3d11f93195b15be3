"""Stored tables: versioned publish and read, graph and vault files, JSON-lines audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = "id string, entity_type string, namespace string, classification string, label string"
EDGE_SCHEMA = "source string, target string, predicate string, source_sentence string, doc_id string, namespace string"
AUDIT_SCHEMA = "seq bigint, ts string, event_type string, details string, prev_hash string, entry_hash string"


def publish(tables: dict[str, DataFrame], base: str, version: int) -> None:
    """Write all tables of a version, then the pointer. A retry overwrites the same folders; readers see the pointer."""
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{base}/v={version}/{name}")
    pointer = spark.createDataFrame([(version,)], "version bigint")
    pointer.coalesce(1).write.mode("append").json(f"{base}/_versions")


def current_version(spark: SparkSession, base: str) -> int:
    return spark.read.schema("version bigint").json(f"{base}/_versions").agg(F.max("version")).first()[0]


def load(spark: SparkSession, base: str, name: str, version: int | None = None) -> DataFrame:
    v = current_version(spark, base) if version is None else version
    return spark.read.parquet(f"{base}/v={v}/{name}")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node-link export: one JSON object per node and per edge."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/links")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(NODE_SCHEMA).json(f"{path}/nodes"), spark.read.schema(EDGE_SCHEMA).json(f"{path}/links")


def append_audit(entries: DataFrame, path: str) -> None:
    entries.select("seq", "ts", "event_type", "details", "prev_hash", "entry_hash").write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).json(path)
