"""Keyed tokens: entity -> token, text rewriting, collision repair, redaction policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokengraph.functions import constants as K
from tokengraph.functions.hashing import TokenKey, entity_digest, normal_type, token_text
from tokengraph.functions.text import replace_spans

TOKEN_TYPE_PATTERN = "^⟦[A-Z0-9]{2}_([A-Z_]+)_[A-Z0-9]+⟧$"


def find_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({K.TOKEN_PATTERN})"), F.lit(1))


def is_token(value: Column) -> Column:
    return value.rlike(f"^{K.TOKEN_PATTERN}$")


def token_type(node: Column) -> Column:
    """Entity type written inside a token; null for other text."""
    kind = F.regexp_extract(node, TOKEN_TYPE_PATTERN, 1)
    return F.when(kind != "", kind)


def with_tokens(entities: Column, key: TokenKey) -> Column:
    """Add ``hmac_digest`` and ``token`` to every entity. Two passes, so that each digest is computed once."""
    digested = F.transform(
        entities,
        lambda e: F.struct(
            e["entity_type"].alias("entity_type"),
            e["start"].alias("start"),
            e["end"].alias("end"),
            e["value"].alias("value"),
            e["confidence"].alias("confidence"),
            entity_digest(e["entity_type"], e["value"], key).alias("hmac_digest"),
        ),
    )
    return F.transform(
        digested,
        lambda e: F.struct(
            e["entity_type"].alias("entity_type"),
            e["start"].alias("start"),
            e["end"].alias("end"),
            e["value"].alias("value"),
            e["confidence"].alias("confidence"),
            e["hmac_digest"].alias("hmac_digest"),
            token_text(e["entity_type"], e["hmac_digest"]).alias("token"),
        ),
    )


def tokenize(
    df: DataFrame, key: TokenKey, text: str = "text", entities: str = "entities", out: str = "tokenized"
) -> DataFrame:
    """Replace every entity by its token; ``entities`` gains ``hmac_digest`` and ``token``."""
    done = df.withColumn(entities, with_tokens(F.col(entities), key))
    return done.withColumn(out, replace_spans(F.col(text), F.col(entities), lambda e: e["token"]))


def apply_policy(
    df: DataFrame, policy: str, text: str = "text", entities: str = "entities", out: str = "protected"
) -> DataFrame:
    """TOKENIZE, REDACT (``[TYPE]``) or PASSTHROUGH per row, from a policy column; entities must carry tokens."""
    choice = F.upper(F.col(policy))
    rewritten = replace_spans(
        F.col(text),
        F.col(entities),
        lambda e: F.when(choice == "REDACT", F.concat(F.lit("["), normal_type(e["entity_type"]), F.lit("]"))).otherwise(
            e["token"]
        ),
    )
    return df.withColumn(out, F.when(choice == "PASSTHROUGH", F.col(text)).otherwise(rewritten))


def token_dictionary(entities: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(entity_type, hmac_digest, token) over all entities, with clashing tokens lengthened.

    Equal tokens of different digests are found by counting distinct digests per token; all members of a clash get
    the next four digest characters that tell them apart, so the result does not depend on arrival order. If no four do,
    they get eight, and if those are equal as well the query fails: two values never share a token.
    ``stored`` (entity_type, hmac_digest, token) keeps its tokens; new members of a clash are lengthened around it.
    """
    cols = ["entity_type", "hmac_digest"]
    base = entities.select(normal_type(F.col("entity_type")).alias("entity_type"), "hmac_digest")
    if stored is not None:
        base = base.unionByName(stored.select(*cols))
    base = base.distinct().withColumn("token", token_text(F.col("entity_type"), F.col("hmac_digest")))
    slices = [11 + 4 * i for i in range(13)]
    clashes = (
        base.groupBy("token")
        .agg(
            F.count("*").alias("n"),
            # Distinct digests sharing 40 bits: a handful at most, and only counts leave the aggregate.
            *[F.size(F.collect_set(F.substring("hmac_digest", s, 4))).alias(f"d{s}") for s in slices],
            F.size(F.collect_set(F.substring("hmac_digest", 11, 8))).alias("d8"),
        )
        .filter("n > 1")
    )
    offset = F.coalesce(*[F.when(F.col(f"d{s}") == F.col("n"), F.lit(s)) for s in slices], F.when(F.col("d8") == F.col("n"), F.lit(0)), F.raise_error("token clash that eight more digits do not resolve").cast("int"))
    chosen = clashes.select("token", offset.alias("slice"))
    extra = F.when(F.col("slice") == 0, F.substring("hmac_digest", 11, 8)).otherwise(F.expr("substring(hmac_digest, slice, 4)"))
    found = base.join(chosen, "token", "left").select(
        *cols,
        F.when(F.col("slice").isNull(), F.col("token")).otherwise(token_text(F.col("entity_type"), F.col("hmac_digest"), extra)).alias("token"),
    )
    if stored is None:
        return found
    kept = stored.select(*cols, F.col("token").alias("_kept"))
    return found.join(kept, cols, "left").select(*cols, F.coalesce("_kept", "token").alias("token"))


def lengthened(dictionary: DataFrame) -> DataFrame:
    """(hmac_digest, token) of the few entries whose token is not the plain one: what ``settle`` has to change."""
    plain = token_text(F.col("entity_type"), F.col("hmac_digest"))
    return dictionary.filter(F.col("token") != plain).select("hmac_digest", "token").distinct()


def settle(df: DataFrame, changed: DataFrame, keys: list[str], text: str = "text", entities: str = "entities", out: str = "tokenized") -> DataFrame:
    """Use the dictionary's tokens in already tokenized rows: ``changed`` (hmac_digest, token) is as small as the clashes.

    Only the digests of the rows travel; a row asks for its own entities, so what returns to it is bounded by the row.
    """
    asked = df.select(*keys, F.explode(F.array_distinct(F.transform(entities, lambda e: e["hmac_digest"]))).alias("hmac_digest"))
    found = asked.join(changed, "hmac_digest").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("hmac_digest", "token"))).alias("_map"))
    joined = df.join(found, keys, "left")
    renamed = F.transform(entities, lambda e: e.withField("token", F.coalesce(F.try_element_at(F.col("_map"), e["hmac_digest"]), e["token"])))
    done = joined.withColumn(entities, F.when(F.col("_map").isNull(), F.col(entities)).otherwise(renamed))
    return done.withColumn(out, F.when(F.col("_map").isNull(), F.col(out)).otherwise(replace_spans(F.col(text), F.col(entities), lambda e: e["token"]))).drop("_map")
