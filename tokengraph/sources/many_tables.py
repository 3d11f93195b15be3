"""Delimited tables of many paths in one job: delimiter, encoding, header and quoted line breaks found per path.

Files are read as lines, so large ones are split. Whether a line starts a row depends on the lines before it: each line
maps "outside" or "inside a quoted cell" to one of the two, and such maps are composed, inside a split by a running window
and between splits by one row each. Only tables that have such lines take that way; all others stay in their scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokengraph.functions.ordered import number_rows
from tokengraph.functions.text import py_trim
from tokengraph.session import cut
from tokengraph.sources.delimited import DELIMITERS, sniff

HEAD_BYTES = 1024


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, line, value, size) of all text files below ``path``: ``block`` is where a split begins, ``line`` rises inside it."""
    raw = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    meta = F.col("_metadata")
    return raw.select(
        meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line"),
        F.col("value"), meta["file_size"].alias("size"),
    )


def by_delimiter(make: Callable[[str], Column], sep: str = "sep") -> Column:
    """``make`` for the delimiter that a row's table has, each with a constant pattern."""
    out = F.when(F.col(sep) == DELIMITERS[0], make(DELIMITERS[0]))
    for d in DELIMITERS[1:]:
        out = out.when(F.col(sep) == d, make(d))
    return out


def ends_inside(text: Column, d: str) -> Column:
    """Whether a row that begins with ``text`` is still inside a quoted cell at its end. A quote later in a cell is a character."""
    s = "\\" + d if d != "\t" else "\\t"
    body = r'[^"]*+(?:""[^"]*+)*+'
    cell = f'(?:"{body}"[^{s}]*+|[^{s}"][^{s}]*+|)'
    return F.rlike(text, F.lit(f'(?s)^(?:{cell}{s})*+"{body}$'))


def cells_of(record: Column, d: str) -> Column:
    """Cells of a whole row, quotes taken off, trimmed."""
    s = "\\" + d if d != "\t" else "\\t"
    found = F.regexp_extract_all(F.concat(record, F.lit(d)), F.lit(rf'(?s)("(?:[^"]|"")*"[^{s}]*|[^{s}]*){s}'), F.lit(1))

    def plain(c: Column) -> Column:
        inner = F.replace(F.regexp_extract(c, r'(?s)^"((?:[^"]|"")*)"', 1), F.lit('""'), F.lit('"'))
        rest = F.regexp_replace(c, r'(?s)^"(?:[^"]|"")*"', "")
        return py_trim(F.when(F.rlike(c, F.lit(r'(?s)^"(?:[^"]|"")*"')), F.concat(inner, rest)).otherwise(c))

    return F.transform(found, plain)


def _records(lines: DataFrame) -> DataFrame:
    """(path, block, line, record) of tables with quoted line breaks; ``block``, ``line`` are those of the row's first line."""
    out = by_delimiter(lambda d: ends_inside(F.col("text"), d))
    again = by_delimiter(lambda d: ends_inside(F.concat(F.lit('"'), "text"), d))
    flagged = cut(lines.withColumns({"_o": out, "_i": again}).select("path", "block", "line", "sep", "text", "_o", "_i"))
    inside = Window.partitionBy("path", "block").orderBy("line")
    fixed, swap = F.col("_o") == F.col("_i"), (F.col("_o") & ~F.col("_i")).cast("int")
    ran = flagged.withColumn("_s", F.sum(swap).over(inside)).withColumn("_f", F.last(F.when(fixed, F.struct(F.col("_o").alias("v"), F.col("_s").alias("s"))), ignorenulls=True).over(inside))

    # One row per split, then the same composition over the splits of a path.
    ends = ran.groupBy("path", "block").agg(F.max_by(F.struct("_s", "_f"), "line").alias("e"))
    whole = ends.select("path", "block", F.when(F.col("e._f").isNull(), F.col("e._s") % 2).otherwise(0).alias("_swap"), _after(F.col("e._f"), F.col("e._s"), F.lit(None).cast("boolean")).alias("_v"))
    across = Window.partitionBy("path").orderBy("block")
    whole = whole.withColumn("_ws", F.sum("_swap").over(across)).withColumn("_wf", F.last(F.when(F.col("_v").isNotNull(), F.struct(F.col("_v").alias("v"), F.col("_ws").alias("s"))), ignorenulls=True).over(across))
    whole = whole.withColumn("_end", _after(F.col("_wf"), F.col("_ws"), F.lit(False)))
    starts = whole.select("path", "block", F.coalesce(F.lag("_end").over(across), F.lit(False)).alias("_start"))

    state = ran.join(starts, ["path", "block"]).withColumn("_end", _after(F.col("_f"), F.col("_s"), F.col("_start")))
    state = state.withColumn("_opens", ~F.coalesce(F.lag("_end").over(inside), F.col("_start")))
    own = F.last(F.when(F.col("_opens"), F.struct("block", "line")), ignorenulls=True).over(inside)
    state = state.withColumn("_own", own)
    last = state.groupBy("path", "block").agg(F.max(F.when(F.col("_opens"), F.struct("block", "line"))).alias("_l"))
    carried = last.select("path", "block", F.last("_l", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    placed = state.join(carried, ["path", "block"]).withColumn("_r", F.coalesce("_own", "_before"))
    joined = placed.groupBy("path", "sep", "_r").agg(F.array_sort(F.collect_list(F.struct("block", "line", "text"))).alias("t"))
    return joined.select("path", "sep", F.col("_r.block").alias("block"), F.col("_r.line").alias("line"), F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("record"))


def _after(fix: Column, swaps: Column, start: Column) -> Column:
    """The state after a line, from the last fixed state (value, swaps then) and the swaps now, else from ``start``."""
    return F.when(fix.isNotNull(), fix["v"] != ((swaps - fix["s"]) % 2 == 1)).otherwise(start != (swaps % 2 == 1))


def read_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): path, row_idx, headers, cells of the data rows of every table below ``path``; path, reason of the others.

    Cells are trimmed, blank rows dropped, the first row left is the header; missing cells are empty and surplus ones
    dropped. UTF-8 with or without a mark, else Latin-1, per path. ``row_idx`` counts data rows from 0 in file order.
    """
    raw = file_lines(spark, path)
    kinds = cut(sniff(raw.select("path", F.col("value").alias("line")), ["path"], "line").select("path", "sep", "utf8", "broken"))
    text = F.when(F.col("utf8"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    lines = raw.join(kinds, "path").select("path", "block", "line", "sep", "broken", F.regexp_replace(F.regexp_replace(text, "\r$", ""), "^﻿", "").alias("text"))
    plain = lines.filter(~F.col("broken")).select("path", "sep", "block", "line", F.col("text").alias("record"))
    records = plain.unionByName(_records(lines.filter("broken")))
    filled = records.withColumn("cells", by_delimiter(lambda d: cells_of(F.col("record"), d))).filter(F.exists("cells", lambda c: c != ""))
    placed = cut(number_rows(filled.select("path", "block", "line", "cells"), ["block", "line"], "at", ["path"]).select("path", "at", "cells"))
    heads = placed.filter("at = 0").select("path", F.col("cells").alias("headers"))
    padded = F.transform("headers", lambda h, i: F.coalesce(F.get("cells", i), F.lit("")))
    rows = placed.filter("at > 0").join(heads, "path").select("path", (F.col("at") - 1).alias("row_idx"), "headers", padded.alias("cells"))
    # A scan leaves out files without bytes; the planner's own list of files names them.
    listed = spark.read.option("recursiveFileLookup", True).text(path).inputFiles()
    files = spark.createDataFrame([(f,) for f in listed], "path string")
    # Both name a file in their own way of writing addresses.
    same = F.regexp_replace(F.coalesce(F.try_url_decode("path"), "path"), "^([a-z0-9]+):/+", "$1:/")
    full = placed.filter("at = 1").select(same.alias("_same"))
    rejects = files.withColumn("_same", same).join(full, "_same", "left_anti").select("path", F.lit("no data rows").alias("reason"))
    return rows, rejects


def content_heads(spark: SparkSession, path: str) -> DataFrame:
    """(path, head): the first 1,024 bytes of every file, from its first lines.

    Reading lines takes off a byte order mark and does not tell whether the last line is closed; the size of the file does.
    """
    lines = file_lines(spark, path)
    first = Window.partitionBy("path").orderBy("block", "line")
    short = F.hex(F.substring(F.col("value").cast("binary"), 1, HEAD_BYTES)).alias("x")
    top = lines.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= HEAD_BYTES)  # a line has a byte at least
    heads = top.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("_n", short))).alias("t"))
    rest = lines.groupBy("path").agg((F.max("size") - F.sum(F.octet_length("value") + 1)).alias("rest"))  # 0, 3 with a mark; one less if not closed
    text = F.concat(
        F.when(F.col("rest") >= 2, "EFBBBF").otherwise(""), F.array_join(F.transform("t", lambda x: x["x"]), "0A"), F.when(F.col("rest").isin(0, 3), "0A").otherwise("")
    )
    return heads.join(rest, "path").select("path", F.substring(F.unhex(text), 1, HEAD_BYTES).alias("head"))
