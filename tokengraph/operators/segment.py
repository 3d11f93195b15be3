"""Paragraphs, sentences and pipe tables inside text, as array columns and narrow explodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokengraph.functions import constants as K
from tokengraph.functions.text import py_trim

# A block of consecutive lines with a pipe: either a line followed by a separator line and then every further pipe
# line, or two or more pipe lines none of which starts with '#'. Group repeats are possessive, so the JVM runs them
# as loops and a long table cannot overflow the stack.
_PIPE_LINE = r"[^\n|]*+\|[^\n]*+"
_SEPARATOR = r"[ \t]*+\|?+[ \t]*+(?::?+-++:?+[ \t]*+\|)++[ \t]*+(?::?+-++:?+[ \t]*+)?+\|?+[ \t]*+(?=\n|\z)"
_PLAIN_PIPE_LINE = r"(?![ \t]*+#)" + _PIPE_LINE
TABLE_BLOCK = (
    rf"(?:(?<=\n)|\A)(?:{_PIPE_LINE}\n{_SEPARATOR}(?:\n{_PIPE_LINE})*+"
    rf"|{_PLAIN_PIPE_LINE}(?:\n{_PLAIN_PIPE_LINE})++)"
)


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines."""
    return F.split(unix_lines(text), r"\n\s*\n+")


def flatten_block(block: Column, strip_headings: bool = True) -> Column:
    """Join the lines of a block with one blank, dropping heading marks and empty lines."""
    lines = F.split(block, "\n")
    if strip_headings:
        lines = F.transform(lines, lambda x: F.regexp_replace(x, r"^#+\s*", ""))
    lines = F.filter(F.transform(lines, py_trim), lambda x: x != "")
    return F.array_join(lines, " ")


def block_sentences(flat: Column) -> Column:
    """Cut after ``.``, ``!`` or ``?`` followed by white space."""
    parts = F.transform(F.split(flat, r"(?<=[.!?])\s+"), py_trim)
    return F.filter(parts, lambda s: s != "")


def sentence_array(text: Column, strip_headings: bool = True) -> Column:
    """All sentences of a text in order."""
    return F.flatten(F.transform(paragraphs(text), lambda b: block_sentences(flatten_block(b, strip_headings))))


def split_sentences(df: DataFrame, key: str, text: str = "text", strip_headings: bool = True) -> DataFrame:
    """(key, sent_idx, text), one row per sentence; narrow, the text itself is never shuffled."""
    rows = df.select(key, F.posexplode_outer(sentence_array(F.col(text), strip_headings)).alias("sent_idx", "_s"))
    return rows.filter(F.col("_s").isNotNull()).select(key, "sent_idx", F.col("_s").alias("text"))


def split_paragraphs(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, para_idx, paragraph) for non-empty blocks, lines joined."""
    rows = df.select(key, F.posexplode_outer(paragraphs(F.col(text))).alias("para_idx", "_b"))
    flat = rows.select(key, "para_idx", flatten_block(F.col("_b")).alias("paragraph"))
    return flat.filter("paragraph != ''")


def table_blocks(text: Column) -> Column:
    """Raw text of every pipe table in order."""
    t = unix_lines(text)
    blocks = F.regexp_extract_all(t, F.lit(f"({TABLE_BLOCK})"), F.lit(1))
    # A multi-line pipe block needs a pipe on two lines; most texts have none and skip the scan.
    return F.when(t.rlike(r"\|[^\n]*\n[^\n]*\|"), blocks).otherwise(F.array().cast("array<string>"))


def row_cells(line: Column) -> Column:
    """Cells of one table line: one outer pipe removed on each side, cells trimmed."""
    inner = F.regexp_replace(F.regexp_replace(py_trim(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|", -1), py_trim)


def is_content_row(cells: Column) -> Column:
    """False for separator rows and for rows without any text."""
    separator = F.forall(cells, lambda c: (c == "") | c.rlike(K.TABLE_SEPARATOR_CELL))
    return ~separator


def block_rows(block: Column) -> Column:
    """Content rows of a table block as arrays of cells."""
    return F.filter(F.transform(F.split(block, "\n"), row_cells), is_content_row)


def _has_data(rows: Column, header_idx: Column) -> Column:
    """Does some row after the header have a subject and a property under that header?"""
    width = F.size(F.get(rows, header_idx))
    below = F.slice(rows, header_idx + 2, F.size(rows))
    return F.exists(
        below,
        lambda r: (F.get(r, F.lit(0)) != "")
        & F.exists(F.slice(r, F.lit(2), F.greatest(width - 1, F.lit(0))), lambda c: c != ""),
    )


def header_index(rows: Column) -> Column:
    """First row that can be the header of a non-empty table; null when there is none."""
    candidates = F.sequence(F.lit(0), F.size(rows) - 2)
    later = F.get(F.filter(candidates, lambda i: _has_data(rows, i)), F.lit(0))
    return F.when(F.size(rows) < 2, F.lit(None)).when(_has_data(rows, F.lit(0)), F.lit(0)).otherwise(later)


def pipe_tables(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, table_idx, raw, rows) for every table with data; ``rows[0]`` is the header."""
    raw = df.select(key, F.posexplode_outer(table_blocks(F.col(text))).alias("table_idx", "raw"))
    raw = raw.filter(F.col("raw").isNotNull()).withColumn("_rows", block_rows(F.col("raw")))
    found = raw.withColumn("_h", header_index(F.col("_rows"))).filter(F.col("_h").isNotNull())
    return found.select(key, "table_idx", "raw", F.expr("slice(_rows, _h + 1, size(_rows))").alias("rows"))


def table_rows(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, table_idx, row_idx, cells, headers); row 0 is the header."""
    t = pipe_tables(df, key, text)
    return t.select(
        key, "table_idx", F.col("rows")[0].alias("headers"), F.posexplode("rows").alias("row_idx", "cells")
    ).select(key, "table_idx", "row_idx", "cells", "headers")


def without_tables(text: Column) -> Column:
    """The text with each table block replaced by a line break. Blocks without data rows stay."""
    t = unix_lines(text)
    blocks = table_blocks(text)
    real = F.filter(blocks, lambda b: header_index(block_rows(b)).isNotNull())
    cleaned = F.aggregate(real, t, lambda acc, b: F.replace(acc, b, F.lit("\n")))
    return F.when(F.size(real) == 0, t).otherwise(cleaned)
