"""Sensitive-entity detection as array columns on text rows (no shuffle, no Python)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokengraph.functions import constants as K
from tokengraph.functions.text import (
    keep_disjoint_any,
    keep_disjoint_in_order,
    literal_map,
    match_spans,
    quote,
    shadow,
)

ENTITY_TYPE = "array<struct<entity_type:string,start:int,end:int,value:string,confidence:double>>"
HINT_TYPE = "array<struct<start:int,end:int,entity_type:string>>"

# Suffix words that contain no other suffix word: one of them is in every text the organisation pattern matches.
_ORG_STEMS = [w for w in K.ORG_SUFFIX_WORDS if not any(v != w and v in w for v in K.ORG_SUFFIX_WORDS)]


# Cheap tests that must hold wherever the pattern can match; they spare the regex on most rows.
_PREFILTER = {
    "EMAIL_ADDRESS": "contains({t}, '@')",
    "SALARY": "contains({t}, '$')",
    "PROJECT_CODE": "contains({t}, 'PRJ-')",
    "EMPLOYEE_ID": "contains({t}, 'EMP-')",
    "US_SSN": r"rlike({t}, '\\d-\\d{{2}}-\\d')",
    "PHONE_NUMBER": r"rlike({t}, '\\d{{3}}[-.\\s]?\\d{{4}}')",
    "CREDIT_CARD": r"rlike({t}, '[345]\\d{{12}}')",
    "LOCATION": r"rlike({t}, '\\d\\s+[A-Za-z0-9\\s,.-]')",
    "ORGANIZATION": "(" + " or ".join(f"contains({{t}}, '{w}')" for w in _ORG_STEMS) + ")",
}
# A PERSON value that is no job title, stop phrase or company name.
PERSON_OK = (
    f"(lower({{v}}) not in ({', '.join(quote(p) for p in K.PERSON_STOP_PHRASES)}) "
    f"and not contains(lower({{v}}), 'social security') and not rlike({{v}}, {quote(K.ORG_WORD_PATTERN)}))"
)


def category_allowed(entity_type: str, categories: Column) -> Column:
    """A type is wanted when the list is empty, names it, or one name contains the other."""
    t = F.lit(entity_type)
    overlap = F.exists(categories, lambda c: F.contains(t, c) | F.contains(c, t))
    return categories.isNull() | (F.size(categories) == 0) | overlap


def resolve_categories(categories: Column) -> Column:
    """Replace short category names by entity types."""
    names = literal_map(K.CATEGORY_ALIASES)
    return F.transform(categories, lambda c: F.coalesce(F.try_element_at(names, c), c))


def unknown_categories(docs: DataFrame, id_col: str, categories: str) -> DataFrame:
    """(id, category) for names that are no known entity type after alias resolution."""
    return (
        docs.select(id_col, F.explode(resolve_categories(F.col(categories))).alias("category"))
        .filter(~F.col("category").isin(K.ENTITY_CATEGORIES))
        .distinct()
    )


def candidate_column(
    text: str,
    shadowed: str,
    recognizers: Sequence[tuple[str, str, float]] = tuple(K.RECOGNIZERS),
    categories: Column | None = None,
    min_confidence: Column | float = K.DEFAULT_MIN_CONFIDENCE,
    person_filter: bool = True,
) -> Column:
    """Every match of every recognizer that is wanted, before overlaps are resolved.

    ``text`` and ``shadowed`` are column names. ``person_filter`` drops people that are job titles, stop phrases or
    company names.
    """
    found = []
    for entity_type, pattern, score in recognizers:
        # An address may hold every ASCII word character, so no stand-in works for it: it runs on the text itself.
        if entity_type == "EMAIL_ADDRESS":
            spans = match_spans(text, text, "(?U)" + pattern)
        else:
            spans = match_spans(shadowed, text, pattern)
        if entity_type == "PERSON" and person_filter:
            spans = f"filter({spans}, s -> {PERSON_OK.format(v='s.value')})"
        entity = (
            f"named_struct('entity_type', {quote(entity_type)}, 'start', s.start, 'end', s.end, 'value', s.value, "
            f"'confidence', double({float(score)!r}))"
        )
        test = _PREFILTER.get(entity_type, "rlike({t}, " + quote(pattern).replace("{", "{{").replace("}", "}}") + ")")
        hit = F.expr(f"if({test.format(t=shadowed)}, transform({spans}, s -> {entity}), cast(array() as {ENTITY_TYPE}))")
        wanted = category_allowed(entity_type, categories) if categories is not None else None
        if isinstance(min_confidence, Column):
            above = F.lit(float(score)) >= min_confidence
            wanted = above if wanted is None else wanted & above
        elif score < min_confidence:
            continue
        found.append(hit if wanted is None else F.when(wanted, hit).otherwise(F.array().cast(ENTITY_TYPE)))
    return F.concat(*found) if found else F.array().cast(ENTITY_TYPE)


def _ranked(entities: Column, by_score: bool) -> Column:
    """Entities ordered for a greedy fold; the index keeps recognizer order on ties."""

    def row(e: Column, i: Column) -> Column:
        keys = [e["start"].alias("k1"), (-e["confidence"]).alias("k2")]
        if by_score:
            keys = [(-e["confidence"]).alias("k1"), e["start"].alias("k2")]
        return F.struct(*keys, i.alias("k3"), e.alias("e"))

    return F.transform(F.sort_array(F.transform(entities, row)), lambda r: r["e"])


def resolve_start_first(entities: Column) -> Column:
    """Earliest start wins, then the higher score (the rule used with pattern recognizers)."""
    return F.when(F.size(entities) < 2, entities).otherwise(
        keep_disjoint_in_order(_ranked(entities, by_score=False), ENTITY_TYPE)
    )


def resolve_score_first(entities: Column) -> Column:
    """Highest score wins, then the earliest start (the rule used with model output)."""
    kept = keep_disjoint_any(_ranked(entities, by_score=True), ENTITY_TYPE)
    by_start = F.sort_array(F.transform(kept, lambda e: F.struct(e["start"].alias("k"), e.alias("e"))))
    return F.when(F.size(entities) < 2, entities).otherwise(F.transform(by_start, lambda r: r["e"]))


def refine_people(entities: Column, text: Column, shadowed: Column) -> Column:
    """Extend people over a directly following ``-Surname``; relabel company-like people as organisations."""

    def extend(e: Column) -> Column:
        tail = F.regexp_extract(F.substring(shadowed, e["end"] + 1, F.length(shadowed)), r"^-[A-Za-z]+\b", 0)
        end = F.when(e["entity_type"] == "PERSON", e["end"] + F.length(tail)).otherwise(e["end"])
        return F.struct(
            e["entity_type"].alias("entity_type"),
            e["start"].alias("start"),
            end.alias("end"),
            F.substring(text, e["start"] + 1, end - e["start"]).alias("value"),
            e["confidence"].alias("confidence"),
        )

    def relabel(e: Column) -> Column:
        org = (e["entity_type"] == "PERSON") & e["value"].rlike(K.ORG_WORD_PATTERN)
        return F.struct(
            F.when(org, "ORGANIZATION").otherwise(e["entity_type"]).alias("entity_type"),
            e["start"].alias("start"),
            e["end"].alias("end"),
            e["value"].alias("value"),
            e["confidence"].alias("confidence"),
        )

    return F.transform(F.transform(entities, extend), relabel)


def above_confidence(entities: Column, floor: Column | float) -> Column:
    low = floor if isinstance(floor, Column) else F.lit(float(floor))
    return F.filter(entities, lambda e: e["confidence"] >= low)


def merge_hints(text: Column, entities: Column, hints: Column, allowed: Column | None = None) -> Column:
    """Known spans win over detections; a span without a type only suppresses what it overlaps."""

    def typed(h: Column) -> Column:
        known = h["entity_type"].isNotNull() & (h["entity_type"] != "")
        if allowed is None:
            return known
        return known & (allowed.isNull() | (F.size(allowed) == 0) | F.array_contains(allowed, h["entity_type"]))

    free = F.filter(
        entities, lambda e: ~F.exists(hints, lambda h: (e["start"] < h["end"]) & (h["start"] < e["end"]))
    )
    given = F.transform(
        F.filter(hints, typed),
        lambda h: F.struct(
            h["entity_type"].alias("entity_type"),
            h["start"].alias("start"),
            h["end"].alias("end"),
            F.substring(text, h["start"] + 1, h["end"] - h["start"]).alias("value"),
            F.lit(1.0).alias("confidence"),
        ),
    )
    both = F.transform(
        F.concat(free, given), lambda e, i: F.struct(e["start"].alias("k1"), i.alias("k2"), e.alias("e"))
    )
    merged = F.transform(F.sort_array(both), lambda r: r["e"])
    return F.when(hints.isNull() | (F.size(hints) == 0), entities).otherwise(merged)


def detect(
    df: DataFrame,
    text: str = "text",
    out: str = "entities",
    *,
    categories: str | None = None,
    min_confidence: str | float = K.DEFAULT_MIN_CONFIDENCE,
    overlap: str = "start",
    hints: str | None = None,
    recognizers: Sequence[tuple[str, str, float]] = tuple(K.RECOGNIZERS),
) -> DataFrame:
    """Add an ordered array of disjoint entities found in ``text``.

    ``overlap`` is ``start`` (pattern rule), ``score`` (model rule, with surname and company refinement) or ``none``
    (all candidates). ``categories``/``hints`` name array columns, ``min_confidence`` a column or a number.
    """
    cats = F.col(categories) if categories else None
    floor = F.col(min_confidence) if isinstance(min_confidence, str) else min_confidence
    found = df.withColumn("_shadow", shadow(F.col(text))).withColumn(
        "_found", candidate_column(text, "_shadow", recognizers, cats, floor, overlap != "score")
    )
    raw = F.col("_found")
    if overlap == "start":
        entities = resolve_start_first(raw)
    elif overlap == "score":
        entities = resolve_score_first(refine_people(raw, F.col(text), F.col("_shadow")))
    elif overlap == "none":
        entities = raw
    else:
        raise ValueError(f"unknown overlap rule {overlap!r}")
    done = found.withColumn(out, entities).drop("_shadow", "_found")
    if hints:
        done = done.withColumn(out, merge_hints(F.col(text), F.col(out), F.col(hints), cats))
    return done


def explode_entities(df: DataFrame, *keys: str, entities: str = "entities") -> DataFrame:
    """One row per entity. ``inline_outer`` plus a null test keeps the detection from running twice: a filter on
    ``size(entities)`` would be pushed below the projection that computes it."""
    rows = df.select(*keys, F.posexplode_outer(entities).alias("entity_idx", "_e"))
    return rows.filter(F.col("_e").isNotNull()).select(*keys, "entity_idx", "_e.*")


def entity_counts(df: DataFrame, key: str, entities: str = "entities") -> DataFrame:
    return df.groupBy(key).agg(F.sum(F.greatest(F.size(entities), F.lit(0))).cast("bigint").alias("entity_count"))
