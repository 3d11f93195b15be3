"""Stores that batches are merged into: rows in buckets, only touched buckets written anew, one pointer for all tables.

A commit writes the touched buckets of every table below its version, then the list of buckets with the version that
holds each, then the pointer, which names the batch. Readers go by the pointer, so they see all tables of a batch or
none; a batch that is run again after a crash writes the same folders, and one that the pointer already names is skipped.
Buckets come from a hash of the row's key, so no key makes one large; their number bounds the list.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokengraph.functions.hashing import token_text

ORD = "struct<batch:bigint,doc_id:string,sent_idx:bigint,triple_idx:int>"
ENTRIES_PER_BUCKET = 1_000_000


@dataclass(frozen=True)
class LiveTable:
    """Columns of a table and the value whose hash picks a row's bucket; ``dealt=False``: the value is the bucket."""

    ddl: str
    key: Callable[[], Column]
    dealt: bool = True


TABLES = {
    # Every lengthened form of a token lies beside the plain one, so a clash is seen in one bucket.
    "vault": LiveTable(
        "token string, payload binary, entity_type string, hmac_digest string, first_doc_id string, created_at timestamp, accessed_at timestamp",
        lambda: token_text(F.col("entity_type"), F.col("hmac_digest")),
    ),
    "references": LiveTable("token string, doc_id string", lambda: F.concat_ws("\u0001", "token", "doc_id")),
    "edges": LiveTable(
        f"source string, target string, predicate string, source_sentence string, doc_id string, namespace string, classification string, ord {ORD}",
        lambda: F.concat_ws("\u0001", "source", "target", "predicate"),
    ),
    "nodes": LiveTable("id string, namespace string, classification string, entity_type string, label string", lambda: F.col("id")),
    "node_docs": LiveTable("id string, doc_id string", lambda: F.concat_ws("\u0001", "id", "doc_id")),
    "degrees": LiveTable("id string, degree bigint", lambda: F.col("id")),
    "registry": LiveTable(
        "doc_id string, title string, classification string, department string, author string, created date, entity_count bigint, triple_count bigint",
        lambda: F.col("doc_id"),
    ),
    "rejects": LiveTable("path string, reasons array<string>, batch bigint", lambda: F.col("path")),
    "audit": LiveTable(
        "seq bigint, ts string, event_type string, details string, prev_hash string, entry_hash string",
        lambda: F.floor(F.col("seq") / ENTRIES_PER_BUCKET).cast("int"),
        dealt=False,
    ),
}


class LiveStore:
    """Tables below ``base``, a folder that all executors reach."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = 64):
        self.spark, self.base, self.buckets = spark, base.rstrip("/"), buckets

    def pointer(self) -> tuple[int, int]:
        """(version, batch) of the last commit; (0, -1) before the first."""
        if not self._there(f"{self.base}/_versions"):
            return 0, -1
        last = self.spark.read.schema("version bigint, batch bigint").json(f"{self.base}/_versions")
        found = last.agg(F.max(F.struct("version", "batch")).alias("p")).first()["p"]
        return (found["version"], found["batch"]) if found else (0, -1)

    def _there(self, path: str) -> bool:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def buckets_of(self, version: int | None = None) -> dict[tuple[str, int], int]:
        """(table, bucket) -> version that holds it: tables x buckets entries."""
        version = self.pointer()[0] if version is None else version
        if version == 0:
            return {}
        rows = self.spark.read.schema("name string, bucket int, version bigint").parquet(f"{self.base}/_buckets/v={version}").collect()
        return {(r["name"], r["bucket"]): r["version"] for r in rows}

    def bucket(self, name: str) -> Column:
        t = TABLES[name]
        return F.pmod(F.xxhash64(t.key()), F.lit(self.buckets)).cast("int") if t.dealt else t.key()

    def touched(self, name: str, rows: DataFrame) -> list[int]:
        """Buckets that ``rows`` (with the key columns of the table) fall into."""
        return sorted(r[0] for r in rows.select(self.bucket(name).alias("b")).distinct().collect())

    def read(self, name: str, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """A table, or some of its buckets, as of a version; nothing else is listed or opened."""
        held = self.buckets_of(version)
        paths = [f"{self.base}/{name}/v={v}/bucket={b}" for (n, b), v in sorted(held.items()) if n == name and (buckets is None or b in set(buckets))]
        reader = self.spark.read.schema(TABLES[name].ddl)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name].ddl)

    def commit(self, batch: int, changed: dict[str, tuple[DataFrame, list[int]]]) -> int:
        """Publish the whole new content of the touched buckets (rows, buckets) of some tables; returns the version."""
        version = self.pointer()[0] + 1
        held = self.buckets_of(version - 1)
        for name, (rows, buckets) in changed.items():
            path = f"{self.base}/{name}/v={version}"
            columns = [f.name for f in self.spark.createDataFrame([], TABLES[name].ddl).schema]
            rows.select(*columns, self.bucket(name).alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
            written = self.spark.read.schema(f"{TABLES[name].ddl}, bucket int").parquet(path).select("bucket").distinct().collect()
            held = {k: v for k, v in held.items() if k[0] != name or k[1] not in buckets}
            held |= {(name, r["bucket"]): version for r in written}
        listed = [(n, b, v) for (n, b), v in held.items()]
        self.spark.createDataFrame(listed, "name string, bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.base}/_buckets/v={version}")
        self.spark.createDataFrame([(version, batch)], "version bigint, batch bigint").coalesce(1).write.mode("append").json(f"{self.base}/_versions")
        return version
