"""The encrypted token -> value table and text reconstruction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokengraph.functions.hashing import VAULT_KEY_CONF
from tokengraph.operators.tokens import find_tokens
from tokengraph.functions import constants as K


def vault_key(spark: SparkSession) -> bytes:
    """32-byte AES key from the session settings (64 hex digits)."""
    raw = spark.conf.get(VAULT_KEY_CONF, None)
    if not raw:
        raise ValueError(f"set {VAULT_KEY_CONF} to 64 hex digits")
    return bytes.fromhex(raw)


def encrypt(value: Column, key: bytes) -> Column:
    """AES-256-GCM with a fresh 96-bit nonce: nonce, ciphertext and tag in one binary value."""
    return F.aes_encrypt(F.encode(value, "UTF-8"), F.lit(bytearray(key)), F.lit("GCM"))


def decrypt(payload: Column, key: bytes) -> Column:
    """Plain text, or null when the key is wrong or the payload was changed."""
    return F.decode(F.try_aes_decrypt(payload, F.lit(bytearray(key)), F.lit("GCM")), "UTF-8")


def upsert(entities: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per token: first type, digest and document by ``ord``; the longest value, the earlier one on a tie.

    ``entities``: token, entity_type, value, hmac_digest, doc_id, ord (a number or an ordering struct). Only aggregates with a fixed-size buffer are
    used, so a token that holds a large share of the rows shrinks to one row per map task before the shuffle.
    ``existing`` rows (same shape as the result) come before all new ones, so they stay the first writer.
    """
    cols = ["token", "entity_type", "value", "hmac_digest", "doc_id", "ord"]
    rows = entities.select(*cols, F.lit(1).alias("age"))
    if existing is not None:
        old = existing.select(
            "token", "entity_type", "value", "hmac_digest", F.col("first_doc_id").alias("doc_id"),
            F.lit(None).cast(entities.schema["ord"].dataType).alias("ord"), F.lit(0).alias("age"),
        )
        rows = old.unionByName(rows)
    first = F.min(F.struct("age", "ord", "entity_type", "hmac_digest", "doc_id"))
    longest = F.min(F.struct((-F.length("value")).alias("n"), "age", "ord", "value"))
    return (
        rows.groupBy("token")
        .agg(first.alias("f"), longest.alias("l"))
        .select(
            "token",
            F.col("f.entity_type").alias("entity_type"),
            F.col("l.value").alias("value"),
            F.col("f.hmac_digest").alias("hmac_digest"),
            F.col("f.doc_id").alias("first_doc_id"),
        )
    )


def references(entities: DataFrame) -> DataFrame:
    """Which document uses which token."""
    return entities.select("token", "doc_id").distinct()


def seal(plain: DataFrame, key: bytes) -> DataFrame:
    """Stored form: the value only as ciphertext, with creation and access times."""
    return plain.select(
        "token",
        encrypt(F.col("value"), key).alias("payload"),
        "entity_type",
        "hmac_digest",
        "first_doc_id",
        F.current_timestamp().alias("created_at"),
        F.lit(None).cast("timestamp").alias("accessed_at"),
    )


def unseal(stored: DataFrame, key: bytes) -> DataFrame:
    return stored.select(
        "token", decrypt(F.col("payload"), key).alias("value"), "entity_type", "hmac_digest", "first_doc_id"
    )


def merge(stored: DataFrame, entities: DataFrame, key: bytes) -> DataFrame:
    """New stored version: first writer's provenance and creation time stay, a longer value is re-encrypted."""
    fresh = upsert(entities, unseal(stored, key))
    keep = stored.select("token", F.col("payload").alias("_p"), F.col("created_at").alias("_c"), "accessed_at")
    old_value = decrypt(F.col("_p"), key)
    return fresh.join(keep, "token", "left").select(
        "token",
        F.when(old_value == F.col("value"), F.col("_p")).otherwise(encrypt(F.col("value"), key)).alias("payload"),
        "entity_type",
        "hmac_digest",
        "first_doc_id",
        F.coalesce("_c", F.current_timestamp()).alias("created_at"),
        "accessed_at",
    )


def lookup(tokens: DataFrame, stored: DataFrame, key: bytes) -> DataFrame:
    """(token, value) for the distinct tokens that exist."""
    return (
        tokens.select("token").distinct().join(stored.select("token", "payload"), "token")
        .select("token", decrypt(F.col("payload"), key).alias("value"))
    )


def access_events(tokens: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows to append to the access log; ``stamp_access`` folds them in."""
    return tokens.select("token").distinct().join(stored.select("token"), "token", "left_semi").withColumn(
        "accessed_at", F.current_timestamp()
    )


def stamp_access(stored: DataFrame, events: DataFrame) -> DataFrame:
    last = events.groupBy("token").agg(F.max("accessed_at").alias("_last"))
    return stored.join(last, "token", "left").withColumn("accessed_at", F.greatest("accessed_at", "_last")).drop("_last")


def count_tokens(vault: DataFrame) -> DataFrame:
    return vault.agg(F.count("*").alias("tokens"))


def purge(vault: DataFrame, doc_ids: DataFrame, refs: DataFrame | None = None, owner: str = "first") -> DataFrame:
    """Drop tokens of deleted documents.

    ``owner="first"``: a token goes with the document that stored it first. ``owner="any"``: a token goes only when
    no remaining document refers to it (``refs``: token, doc_id).
    """
    gone = doc_ids.select("doc_id").distinct()
    if owner == "first":
        return vault.join(gone, vault["first_doc_id"] == gone["doc_id"], "left_anti")
    if owner == "any":
        if refs is None:
            raise ValueError("owner='any' needs refs")
        touched = refs.join(gone, "doc_id", "left_semi").select("token").distinct()
        kept = refs.join(gone, "doc_id", "left_anti").select("token").distinct()
        return vault.join(touched.join(kept, "token", "left_anti"), "token", "left_anti")
    raise ValueError(f"unknown owner rule {owner!r}")


def clear(vault: DataFrame) -> DataFrame:
    return vault.limit(0)


def reconstruct(
    df: DataFrame, values: DataFrame, id_col: str, text: str = "text", out: str = "reconstructed"
) -> DataFrame:
    """Swap known tokens back to values in one pass; unknown tokens stay. Adds ``out`` and ``n_reconstructed``.

    ``values``: token, value. Each text asks for its distinct tokens only, a hot token is a skewed key on the large
    side that adaptive execution splits, and what returns per text is bounded by the text itself. A value that looks
    like a token is not expanded again.
    """
    asked = df.select(id_col, F.explode_outer(F.array_distinct(find_tokens(F.col(text)))).alias("token"))
    found = (
        asked.filter(F.col("token").isNotNull())
        .join(values.select("token", "value"), "token")
        .groupBy(id_col)
        .agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("_map"))
    )
    marked = F.regexp_replace(F.col(text), f"({K.TOKEN_PATTERN})", "\u0001$1\u0001")
    swapped = F.array_join(
        F.transform(F.split(marked, "\u0001"), lambda p: F.coalesce(F.try_element_at(F.col("_map"), p), p)), ""
    )
    joined = df.join(found, id_col, "left")
    return (
        joined.withColumn(out, F.when(F.col("_map").isNull(), F.col(text)).otherwise(swapped))
        .withColumn("n_reconstructed", F.coalesce(F.size("_map"), F.lit(0)).cast("bigint"))
        .withColumn("n_reconstructed", F.when(F.col("_map").isNull(), F.lit(0)).otherwise(F.col("n_reconstructed")))
        .drop("_map")
    )
