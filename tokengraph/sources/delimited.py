"""Delimited text tables: delimiter and encoding found by one aggregate over the lines, then the built-in reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = [",", ";", "\t", "|"]


def sniff(lines: DataFrame, keys: list[str] | None = None, line: str = "value") -> DataFrame:
    """(keys…, sep, utf8, broken) per table: the delimiter with the highest median count outside quotes, comma when none
    is found; whether all bytes are UTF-8; whether a quoted cell runs over a line end.

    ``lines``: keys…, line. A few short or odd rows do not move a median. Only sketches and counts leave the aggregate.
    """
    filled = lines.filter(F.trim(line) != "")
    bare = F.regexp_replace(F.col(line), '"[^"]*"', "")
    counts = [F.percentile_approx(F.size(F.split(bare, "\\" + d, -1)) - 1, 0.5).alias(f"m{i}") for i, d in enumerate(DELIMITERS)]
    odd = (F.length(line) - F.length(F.replace(F.col(line), F.lit('"'), F.lit("")))) % 2 == 1
    stats = filled.groupBy(*(keys or [])).agg(*counts, F.every(F.is_valid_utf8(F.col(line))).alias("utf8"), F.some(odd).alias("broken"))
    best = F.greatest(*[F.col(f"m{i}") for i in range(len(DELIMITERS))])
    sep: Column = F.when(best == 0, F.lit(","))
    for i, d in enumerate(DELIMITERS):
        sep = sep.when(F.col(f"m{i}") == best, F.lit(d))
    return stats.select(*(keys or []), F.coalesce(sep, F.lit(",")).alias("sep"), F.coalesce("utf8", F.lit(True)).alias("utf8"), F.coalesce("broken", F.lit(False)).alias("broken"))


def read_cells(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None) -> DataFrame:
    """(headers, cells) of one logical table below ``path``, each file with the same header line.

    Cells are trimmed, missing cells of short rows are empty, blank rows are dropped; headers may repeat. Files are split
    between tasks unless a quoted cell runs over a line end. Raises when there is no data row.
    """
    found = sniff(spark.read.text(path)).first()
    sep = sep or found["sep"]
    encoding = encoding or ("UTF-8" if found["utf8"] else "ISO-8859-1")
    options = {"sep": sep, "encoding": encoding, "quote": '"', "escape": '"', "multiLine": found["broken"]}
    top = spark.read.options(header=False, **options).csv(path).first()
    headers = [(h or "").strip().lstrip("\ufeff") for h in top or []]
    schema = ", ".join(f"c{i} string" for i in range(len(headers)))
    if not headers:
        raise ValueError(f"no usable data rows below {path}")
    raw = spark.read.schema(schema).options(header=True, enforceSchema=True, **options).csv(path)
    cells = F.array(*[F.trim(F.coalesce(F.col(c), F.lit(""))) for c in raw.columns])
    rows = raw.select(F.array(*[F.lit(h) for h in headers]).alias("headers"), cells.alias("cells")).filter(F.exists("cells", lambda c: c != ""))
    if rows.isEmpty():
        raise ValueError(f"no usable data rows below {path}")
    return rows


def read_table(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None) -> DataFrame:
    """``read_cells`` with one column per header; a repeated header gets its place appended."""
    rows = read_cells(spark, path, sep, encoding)
    headers = rows.first()["headers"]
    names = [h if headers.count(h) == 1 else f"{h}{i}" for i, h in enumerate(headers)]
    return rows.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def empty_tables(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, reason) for tables with a header only, or nothing. ``lines``: path, value."""
    counts = lines.filter(F.trim("value") != "").groupBy("path").agg(F.count("*").alias("n"))
    usable = counts.filter("n >= 2")
    return files.select("path").join(usable, "path", "left_anti").withColumn("reason", F.lit("no data rows"))


def as_header_cells(rows: DataFrame) -> DataFrame:
    """(headers, cells) with the column order of the file."""
    return rows.select(
        F.array(*[F.lit(c) for c in rows.columns]).alias("headers"),
        F.array(*[F.col(f"`{c}`") for c in rows.columns]).alias("cells"),
    )
