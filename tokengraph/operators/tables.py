"""Row-scoped facts from tables: predicates, unpivot, column typing, sentences with typed spans."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokengraph.functions import constants as K
from tokengraph.functions.text import literal_map, py_trim
from tokengraph.operators.composite import FACT_TYPE, decompose, header_predicate, is_composite
from tokengraph.operators.detect import HINT_TYPE


def as_cells(df: DataFrame, key: list[str], columns: Mapping[str, str]) -> DataFrame:
    """Wide table -> (key…, headers, cells). ``columns`` maps header to a SQL expression; the first is the subject."""
    return df.select(
        *key,
        F.array(*[F.lit(h) for h in columns]).alias("headers"),
        F.array(*[F.coalesce(F.expr(e).cast("string"), F.lit("")) for e in columns.values()]).alias("cells"),
    )


def row_properties(headers: Column, cells: Column) -> Column:
    """Non-empty cells after the subject as ordered (col_idx, predicate, value).

    A predicate that occurs twice in a row keeps its first place and its last value.
    """
    width = F.least(F.size(headers), F.size(cells))
    filled = F.filter(
        F.transform(
            F.arrays_zip(
                F.slice(F.transform(headers, header_predicate), F.lit(2), width - 1).alias("p"),
                F.slice(F.transform(cells, py_trim), F.lit(2), width - 1).alias("v"),
            ),
            lambda z, i: F.struct((i + 1).alias("col_idx"), z["p"].alias("predicate"), z["v"].alias("value")),
        ),
        lambda x: x["value"] != "",
    )

    def merge(acc: Column, x: Column) -> Column:
        seen = F.exists(acc, lambda a: a["predicate"] == x["predicate"])
        updated = F.transform(
            acc,
            lambda a: F.struct(
                a["col_idx"].alias("col_idx"),
                a["predicate"].alias("predicate"),
                F.when(a["predicate"] == x["predicate"], x["value"]).otherwise(a["value"]).alias("value"),
            ),
        )
        return F.when(seen, updated).otherwise(F.concat(acc, F.array(x)))

    empty = F.array().cast("array<struct<col_idx:int,predicate:string,value:string>>")
    return F.when(width > 1, F.aggregate(filled, empty, merge)).otherwise(empty)


def unpivot_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """(key…, headers, cells) -> one row per fact: (key…, subject, col_idx, predicate, value). Narrow."""
    rows = df.select(
        *key,
        F.get("cells", F.lit(0)).alias("subject"),
        F.explode_outer(row_properties(F.col("headers"), F.col("cells"))).alias("_f"),
    )
    return rows.filter(F.col("_f").isNotNull() & (F.col("subject") != "")).select(*key, "subject", "_f.*")


def _sentence_parts() -> tuple[Column, Column]:
    mids, tails = {}, {}
    for predicate, template in K.SENTENCE_TEMPLATES.items():
        mid, tail = template.removeprefix("{subj}").split("{val}")
        mids[predicate], tails[predicate] = mid, tail
    return literal_map(mids), literal_map(tails)


def fact_sentence(subject: Column, predicate: Column, value: Column) -> Column:
    """Word one fact: a known template, else ``<subject> has <attribute> <value>.``"""
    mids, tails = _sentence_parts()
    attribute = F.lower(F.replace(F.regexp_replace(predicate, "^HAS_", ""), F.lit("_"), F.lit(" ")))
    mid = F.coalesce(F.try_element_at(mids, predicate), F.concat(F.lit(" has "), attribute, F.lit(" ")))
    return F.concat(subject, mid, value, F.coalesce(F.try_element_at(tails, predicate), F.lit(".")))


def last_index(text: Column, part: Column) -> Column:
    """0-based start of the last occurrence, -1 when absent."""
    at = F.locate(F.reverse(part), F.reverse(text)) if isinstance(part, str) else F.call_function(
        "locate", F.reverse(part), F.reverse(text)
    )
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(text) - at - F.length(part) + 1)


def typed_spans(sentence: Column, subject: Column, value: Column, subject_type: Column, value_type: Column) -> Column:
    """Hints of one row sentence. PLAIN gives a span without a type; null gives no span."""

    def plain_to_null(t: Column) -> Column:
        return F.when(t != K.PLAIN, t)

    at = last_index(sentence, value)
    head = F.when(
        subject_type.isNotNull(),
        F.array(
            F.struct(
                F.lit(0).alias("start"), F.length(subject).alias("end"), plain_to_null(subject_type).alias("entity_type")
            )
        ),
    ).otherwise(F.array().cast(HINT_TYPE))
    tail = F.when(
        value_type.isNotNull() & (at >= F.length(subject)),
        F.array(
            F.struct(
                at.alias("start"), (at + F.length(value)).alias("end"), plain_to_null(value_type).alias("entity_type")
            )
        ),
    ).otherwise(F.array().cast(HINT_TYPE))
    return F.concat(head, tail)


def infer_type(header: Column, n: Column, url: Column, rating: Column, org: Column, person: Column) -> Column:
    """Ordered typing rule over a header and the value-shape fractions of its column."""
    h = F.lower(py_trim(header))
    by_predicate = literal_map(K.PREDICATE_ENTITY_TYPES)
    known = F.try_element_at(by_predicate, header_predicate(header))
    return F.coalesce(
        known,
        F.when(n == 0, F.lit(None).cast("string"))
        .when(h.rlike(K.ORG_HEADER_PATTERN), "ORGANIZATION")
        .when(h.rlike(K.URL_HEADER_PATTERN) | (url >= K.URL_FRACTION), K.PLAIN)
        .when(h.rlike(K.RATING_HEADER_PATTERN) | (rating >= K.RATING_FRACTION), K.PLAIN)
        .when(org >= K.ORG_FRACTION, "ORGANIZATION")
        .when(h.rlike(K.PERSON_HEADER_PATTERN) & (person >= K.PERSON_FRACTION), "PERSON")
        .when(h.rlike(K.CATEGORY_HEADER_PATTERN), K.PLAIN),
    )


def value_shapes(value: Column) -> dict[str, Column]:
    v = py_trim(value)
    return {
        "is_url": v.rlike(K.URL_VALUE_PATTERN),
        "is_rating": v.rlike(K.RATING_VALUE_PATTERN),
        "is_org": v.rlike(K.ORG_VALUE_PATTERN),
        "has_org_word": v.rlike(K.ORG_WORD_PATTERN),
        "is_person": v.rlike(K.PERSON_VALUE_PATTERN),
    }


def column_types(rows: DataFrame, key: list[str], sample_rows: int | None = None) -> DataFrame:
    """(key…, col_idx, header, entity_type) from all rows of each table, or from its first ``sample_rows``.

    ``rows``: key…, row_idx (0 = first data row), headers, cells. Shares are combined before the shuffle, so a long table
    costs its scan. ``K.SAMPLE_ROWS`` gives the types that a reader of only the first rows would give.
    """
    cells = (
        (rows if sample_rows is None else rows.filter(F.col("row_idx") < sample_rows))
        .select(*key, "headers", F.posexplode("cells").alias("col_idx", "value"))
        .withColumn("header", F.get("headers", F.col("col_idx")))
        .filter(F.col("header").isNotNull())
    )
    filled = py_trim(F.col("value")) != ""
    share = {name: F.avg(F.when(filled, c.cast("double"))) for name, c in value_shapes(F.col("value")).items()}
    stats = cells.groupBy(*key, "col_idx", "header").agg(
        F.sum(filled.cast("int")).alias("n"), *[c.alias(name) for name, c in share.items()]
    )
    return stats.select(
        *key,
        "col_idx",
        "header",
        infer_type(F.col("header"), F.col("n"), F.col("is_url"), F.col("is_rating"), F.col("is_org"), F.col("is_person")).alias(
            "entity_type"
        ),
    )


def expand_facts(facts: DataFrame, key: list[str]) -> DataFrame:
    """Replace composite cells by their unpacked facts: adds ``part_idx`` and ``fact_type``; narrow."""
    unpacked = F.when(is_composite(F.col("value")), decompose(F.col("value"), F.col("subject"))).otherwise(
        F.array().cast(FACT_TYPE)
    )
    itself = F.array(
        F.struct(
            F.col("predicate").alias("predicate"),
            F.col("value").alias("value"),
            F.lit(None).cast("string").alias("entity_type"),
        )
    )
    staged = facts.withColumn("_parts", unpacked)
    return (
        staged.select(
            *key,
            "subject",
            "col_idx",
            (F.size("_parts") > 0).alias("composite"),
            F.posexplode_outer(F.when(F.size("_parts") > 0, F.col("_parts")).otherwise(itself)).alias("part_idx", "_p"),
        )
        .select(*key, "subject", "col_idx", "part_idx", "composite", "_p.predicate", "_p.value",
                F.col("_p.entity_type").alias("fact_type"))
    )


def row_sentences(
    facts: DataFrame,
    key: list[str],
    department: str | None = None,
) -> DataFrame:
    """(key…, subject, col_idx, part_idx, predicate, value, text): one sentence per fact, bound to one subject.

    ``facts``: key…, subject, col_idx, predicate, value [, part_idx]; ``key`` must name a row of a table. With a
    ``department`` column, rows that state no department get one sentence for it (col_idx 0).
    """
    if "part_idx" not in facts.columns:
        facts = facts.withColumn("part_idx", F.lit(0))
    base = facts.select(
        *key,
        "subject",
        "col_idx",
        "part_idx",
        "predicate",
        "value",
        fact_sentence(F.col("subject"), F.col("predicate"), F.col("value")).alias("text"),
    )
    if department is None:
        return base
    # A table row is bounded by its number of columns, so grouping by row is small for every key.
    bound = (
        facts.groupBy(*key, "subject", department)
        .agg(F.max((F.col("predicate") == "IN_DEPARTMENT").cast("int")).alias("_has"))
        .filter(F.col(department).isNotNull() & (F.col("_has") == 0))
        .select(
            *key,
            "subject",
            F.lit(0).alias("col_idx"),
            F.lit(0).alias("part_idx"),
            F.lit("IN_DEPARTMENT").alias("predicate"),
            F.col(department).alias("value"),
        )
    )
    return base.unionByName(bound.withColumn("text", fact_sentence(F.col("subject"), F.col("predicate"), F.col("value"))))
