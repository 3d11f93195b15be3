"""Text scans and flow rules that decide what may leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokengraph.functions import constants as K


def injection_violations(text: Column) -> Column:
    """Labels of all injection patterns found, in pattern order."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?U)" + p), F.lit(label)) for p, label in K.INJECTION_PATTERNS]))


def scan_injections(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``violations``, ``is_safe`` and ``sanitized_text`` (empty when unsafe)."""
    scanned = df.withColumn("violations", injection_violations(F.col(text)))
    safe = F.size("violations") == 0
    return scanned.withColumn("is_safe", safe).withColumn("sanitized_text", F.when(safe, F.col(text)).otherwise(""))


def leak_warnings(text: Column) -> Column:
    """Warnings for personal data in an answer."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?U)" + p), F.lit(label)) for p, label in K.LEAK_PATTERNS]))


def unsafe_queries(lines: DataFrame, query_id: str = "query_id", line: str = "line") -> DataFrame:
    """(query_id, violations) for queries whose context holds an injection.

    Context lines start with ``- ``, so no pattern can run over a line end and a context is scanned line by line; the
    label set of a query has at most one entry per pattern.
    """
    hits = lines.select(query_id, F.explode_outer(injection_violations(F.col(line))).alias("label"))
    return (
        hits.filter(F.col("label").isNotNull())
        .groupBy(query_id)
        .agg(F.array_sort(F.collect_set("label")).alias("violations"))
    )


def block_queries(queries: DataFrame, unsafe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(allowed queries, INJECTION_BLOCKED audit rows)."""
    allowed = queries.join(unsafe, "query_id", "left_anti")
    blocked = queries.join(unsafe, "query_id").select(
        F.lit("INJECTION_BLOCKED").alias("event_type"),
        F.to_json(F.struct(F.col("query_text").alias("query"), "violations")).alias("details"),
        "query_id",
    )
    return allowed, blocked


def flow_allowed(source: Column, destination: Column, data_type: Column) -> Column:
    """Raw personal data only into the trusted zone, vault look-ups only out of it, anything else anywhere."""
    return (
        F.when(data_type == "raw_pii", destination == "local_trusted")
        .when(data_type == "vault_lookup", source == "local_trusted")
        .otherwise(F.lit(True))
    )
