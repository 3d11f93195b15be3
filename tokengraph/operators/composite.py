"""Cells that pack several attributes: detection and unpacking into typed facts, inside the row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokengraph.functions import constants as K
from tokengraph.functions.text import literal_map, py_trim, strip_chars

FACT_TYPE = "array<struct<predicate:string,value:string,entity_type:string>>"


def header_predicate(header: Column) -> Column:
    """Table header -> graph predicate: the synonym map, else ``HAS_<SLUG>``, else ``RELATED_TO``."""
    clean = F.lower(py_trim(header))
    known = literal_map(K.HEADER_PREDICATES)
    slug = F.upper(F.regexp_replace(py_trim(F.regexp_replace(clean, r"(?U)[^\w\s]", "")), r"\s+", "_"))
    return F.coalesce(
        F.try_element_at(known, clean), F.when(slug == "", "RELATED_TO").otherwise(F.concat(F.lit("HAS_"), slug))
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expression once; without it each later use would repeat the work."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_composite(cell: Column) -> Column:
    """Ten characters or more, and: two delimiters, or a key-value shape, or two kinds of attribute."""
    kinds = sum(
        (
            cell.rlike(p).cast("int")
            for p in (K.CELL_PHONE, K.CELL_EMAIL, K.CELL_HOURS, K.CELL_CURRENCY, K.CELL_ADDRESS_WORDS)
        ),
        F.lit(0),
    )
    packed = (F.regexp_count(cell, F.lit(K.CELL_DELIMITER)) >= 2) | cell.rlike(K.CELL_KEY_VALUE) | (kinds >= 2)
    return F.coalesce((F.length(cell) >= 10) & packed, F.lit(False))


def cell_chunks(cell: Column) -> Column:
    """Trimmed, non-empty pieces between delimiters."""
    return F.filter(F.transform(F.split(cell, K.CELL_DELIMITER), py_trim), lambda c: c != "")


def is_noise(chunk: Column) -> Column:
    """Interface labels and icon glyphs that carry no fact."""
    return chunk.rlike(K.CELL_NOISE)


def is_subject_echo(chunk: Column, subject: Column) -> Column:
    """The chunk only repeats the subject (up to three more characters)."""
    low, s = F.lower(chunk), F.lower(py_trim(subject))
    repeats = (low == s) | F.startswith(low, F.concat(s, F.lit(" ")))
    return (s != "") & repeats & (F.length(low) <= F.length(s) + 3)


def _fact(predicate: Column | str, value: Column, entity_type: str | None) -> Column:
    p = predicate if isinstance(predicate, Column) else F.lit(predicate)
    return F.struct(
        p.alias("predicate"), value.alias("value"), F.lit(entity_type).cast("string").alias("entity_type")
    )


def _key_value(chunk: Column) -> Column:
    """One fact from a ``Key: value`` chunk; the value's shape decides the type."""
    value = py_trim(F.regexp_extract(chunk, K.CELL_KEY_VALUE, 2))
    predicate = header_predicate(F.regexp_extract(chunk, K.CELL_KEY_VALUE, 1))

    def typed(kv: Column) -> Column:
        v, p = kv["v"], kv["p"]
        pay = F.when(p.isin(K.PAY_LABELS), "HAS_SALARY").otherwise(p)
        return (
            F.when(v.rlike(K.CELL_EMAIL), F.array(_fact(p, v, "EMAIL_ADDRESS")))
            .when(v.rlike(K.CELL_PHONE), F.array(_fact(p, v, "PHONE_NUMBER")))
            .when(v.rlike(K.CELL_CURRENCY), F.array(_fact(pay, v, "SALARY")))
            .otherwise(F.array(_fact(p, v, None)))
        )

    return let(F.struct(value.alias("v"), predicate.alias("p")), typed)


def _take(state: Column, pattern: str, predicate: str, entity_type: str | None, tidy=lambda v: v) -> Column:
    """Move the first match of ``pattern`` from the remaining text to the facts."""
    rest, facts = state["rest"], state["facts"]
    hit = py_trim(F.regexp_extract(rest, pattern, 0))
    left = py_trim(F.array_join(F.split(rest, pattern, 2), " "))
    found = rest.rlike(pattern)
    return F.struct(
        F.when(found, left).otherwise(rest).alias("rest"),
        F.when(found, F.concat(facts, F.array(_fact(predicate, tidy(hit), entity_type)))).otherwise(facts).alias("facts"),
    )


def _tidy_hours(v: Column) -> Column:
    return strip_chars(F.regexp_replace(v, r"[·•|]", ","), ", ")


def _finish(state: Column) -> Column:
    """Classify what is left of a chunk as address, category, rating or details."""
    rest, facts = state["rest"], state["facts"]
    rating = F.coalesce(
        F.nullif(F.regexp_extract(rest, K.CELL_RATING, 1), F.lit("")), F.regexp_extract(rest, K.CELL_RATING, 2)
    )
    resid = strip_chars(py_trim(rest), K.CELL_TRIM_CHARS)
    words = F.size(F.split(rest, r"\s+"))
    last = (
        F.when(rest.rlike(K.CELL_ADDRESS_WORDS), F.array(_fact("HAS_ADDRESS", rest, "LOCATION")))
        .when(rest.rlike(K.CELL_CATEGORY_WORDS) & (words <= 5), F.array(_fact("HAS_CATEGORY", rest, None)))
        .when(rest.rlike(K.CELL_RATING) & (F.length(rest) <= 12), F.array(_fact("HAS_RATING", rating, None)))
        .when((F.length(resid) >= 6) & ~is_noise(resid), F.array(_fact("HAS_DETAILS", resid, None)))
        .otherwise(F.array().cast(FACT_TYPE))
    )
    return F.concat(facts, last)


def chunk_facts(chunk: Column, subject: Column) -> Column:
    """Facts of one chunk in extraction order."""
    start = F.struct(chunk.alias("rest"), F.array().cast(FACT_TYPE).alias("facts"))
    free_text = let(
        _take(start, K.CELL_PHONE, "HAS_PHONE", "PHONE_NUMBER"),
        lambda s1: let(
            _take(s1, K.CELL_EMAIL, "HAS_EMAIL", "EMAIL_ADDRESS"),
            lambda s2: let(
                _take(s2, K.CELL_HOURS, "HAS_HOURS", None, _tidy_hours),
                lambda s3: let(
                    _take(s3, K.CELL_CURRENCY, "HAS_SALARY", "SALARY"),
                    lambda s4: let(_take(s4, K.CELL_URL, "HAS_LINK", None), _finish),
                ),
            ),
        ),
    )
    return (
        F.when(is_noise(chunk) | is_subject_echo(chunk, subject), F.array().cast(FACT_TYPE))
        .when(chunk.rlike(K.CELL_KEY_VALUE), _key_value(chunk))
        .otherwise(free_text)
    )


def decompose(cell: Column, subject: Column) -> Column:
    """Ordered facts of a composite cell, values trimmed, repeats of (predicate, lower value) dropped."""
    chunks = cell_chunks(cell)
    chunks = F.when(F.size(chunks) == 0, F.array(py_trim(cell))).otherwise(chunks)
    raw = F.flatten(F.transform(chunks, lambda c: chunk_facts(c, subject)))
    clean = F.transform(
        raw,
        lambda f: F.struct(
            f["predicate"].alias("predicate"),
            strip_chars(py_trim(f["value"]), K.CELL_TRIM_CHARS).alias("value"),
            f["entity_type"].alias("entity_type"),
        ),
    )
    kept = F.filter(clean, lambda f: F.length(f["value"]) >= 2)

    def first_seen(fs: Column) -> Column:
        return F.filter(
            fs,
            lambda f, i: ~F.exists(
                F.slice(fs, F.lit(1), i),
                lambda g: (g["predicate"] == f["predicate"]) & (F.lower(g["value"]) == F.lower(f["value"])),
            ),
        )

    return let(kept, first_seen)
