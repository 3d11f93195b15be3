"""Column builders for spans inside text: shadow text, match offsets, disjoint-span folds, replacement.

Everything here is a Catalyst expression; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN_TYPE = "array<struct<start:int,end:int,value:string>>"
_OPEN, _CLOSE = "\u0001", "\u0002"


def quote(s: str) -> str:
    """Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_array(values: list[str]) -> Column:
    return F.expr(f"array({', '.join(quote(v) for v in values)})")


def literal_map(mapping: dict[str, str]) -> Column:
    return F.expr(f"map({', '.join(quote(x) for pair in mapping.items() for x in pair)})")


def literal_pairs(pairs: list[tuple[str, str]]) -> Column:
    """Array of structs (k, v)."""
    return F.expr(f"array({', '.join(f'named_struct(\'k\', {quote(k)}, \'v\', {quote(v)})' for k, v in pairs)})")


def py_trim(c: Column) -> Column:
    """Trim every kind of ASCII white space (``trim`` alone removes blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def strip_chars(c: Column, chars: str) -> Column:
    """Remove any of ``chars`` from both ends."""
    return F.btrim(c, F.lit(chars))


def shadow(text: Column) -> Column:
    """ASCII text of the same length whose word boundaries are those of the Unicode text.

    Letters and digits outside ASCII become ``_`` (a word character), other white space becomes a tab, anything else
    ``~``. Patterns run on the shadow; values are cut from the original by offset.
    """
    letters = F.regexp_replace(text, r"[\p{L}\p{N}&&[^\x00-\x7F]]", "_")
    blanks = F.regexp_replace(letters, r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]", "\t")
    full = F.regexp_replace(blanks, r"[^\x00\x03-\x7F]", "~")
    return F.when(text.rlike(r"[^\x00\x03-\x7F]"), full).otherwise(text)


def match_spans(shadowed: str, original: str, pattern: str) -> str:
    """SQL for all non-overlapping matches with half-open character offsets, as ``SPAN_TYPE``.

    Spark has no offset function, so every match is wrapped in two markers and the text is split on them: odd pieces
    are matches and running piece lengths are offsets. ``shadowed`` and ``original`` are column names. It is SQL text
    because one parsed expression is built much faster than hundreds of single calls.
    """
    value = f"if(contains(p, '_') or contains(p, '\\t'), substring({original}, a.pos + 1, length(p)), p)"
    span = f"named_struct('start', a.pos, 'end', a.pos + length(p), 'value', {value})"
    return (
        f"aggregate(split(regexp_replace({shadowed}, {quote('(' + pattern + ')')}, '{_OPEN}$1{_CLOSE}'), '[{_OPEN}{_CLOSE}]'), "
        f"named_struct('pos', 0, 'hit', false, 'out', cast(array() as {SPAN_TYPE})), "
        f"(a, p) -> named_struct('pos', a.pos + length(p), 'hit', not a.hit, 'out', if(a.hit, concat(a.out, array({span})), a.out)), "
        f"a -> a.out)"
    )


def keep_disjoint_in_order(sorted_spans: Column, span_type: str) -> Column:
    """Greedy fold over spans sorted by start: keep a span when it starts at or after the last kept end."""
    zero = F.struct(F.lit(-1).alias("last"), F.array().cast(span_type).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        free = s["start"] >= acc["last"]
        return F.struct(
            F.when(free, s["end"]).otherwise(acc["last"]).alias("last"),
            F.when(free, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(sorted_spans, zero, step, lambda acc: acc["out"])


def keep_disjoint_any(sorted_spans: Column, span_type: str) -> Column:
    """Greedy fold over spans in any priority order: keep a span that overlaps none kept so far."""

    def step(acc: Column, s: Column) -> Column:
        clash = F.exists(acc, lambda k: (s["start"] < k["end"]) & (k["start"] < s["end"]))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(sorted_spans, F.array().cast(span_type), step)


def replace_spans(text: Column, spans: Column, replacement) -> Column:
    """Rebuild ``text`` with each disjoint, ordered span replaced by ``replacement(span)``."""
    previous = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    size = F.length(text)

    def piece(s: Column, prev: Column) -> Column:
        return F.when(s["start"].isNull(), F.substring(text, prev + 1, size)).otherwise(
            F.concat(F.substring(text, prev + 1, s["start"] - prev), replacement(s))
        )

    return F.array_join(F.zip_with(spans, previous, piece), "")


def first_word_hit(text: Column, phrases: list[tuple[str, str]]) -> Column:
    """Value of the first (phrase, value) whose phrase is contained in ``text``; null when none is."""
    hits = F.filter(literal_pairs(phrases), lambda p: F.contains(text, p["k"]))
    return F.get(hits, F.lit(0))["v"]


def contains_any(text: Column, words: list[str]) -> Column:
    return F.exists(literal_array(words), lambda w: F.contains(text, w))
