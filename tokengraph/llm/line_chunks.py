"""Repeated stretches of lines, found by content-defined chunks and, around them, by pairs of neighbouring lines.

A rolling hash over the hashes of neighbouring lines chooses chunk boundaries, so a shifted passage is cut at the same
lines. A chunk of two lines or more that occurs earlier (smaller id, then place) is removed whole after its bytes were
compared with the first occurrence. What a passage has beside whole chunks (its first and last lines, or all of it if it
is short) is found by pairs of neighbouring lines: every pair outside the repeats of chunks is looked up the same way.
So a repeated stretch of two lines or more goes whole wherever it begins and ends. An equal line always stays at an
earlier place; a first occurrence can lose lines only to repeats of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokengraph.llm import common as C

LEAST_LINES = 2
SPAN, DIVISOR = 2, 4
"""Lines under the rolling hash, and the share of lines (one of so many) that end a chunk."""
BASE = np.uint64(0x9E3779B97F4A7C15)
KEY, TWIN = "__line_chunk_key", "__line_chunk_twin"


def blocks(text: str) -> list[tuple[int, int, bytes]]:
    """``(first line, number of lines, bytes)`` of the content-defined chunks of two lines or more that are not all blank.

    A boundary follows from the ``SPAN`` lines before it alone: lines put in elsewhere do not move it.
    """
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    if len(lines) < LEAST_LINES:
        return []
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in lines), np.uint64, len(lines))
    rolling = np.zeros(len(lines), np.uint64)
    for k in range(SPAN):
        rolling[k:] = rolling[k:] + hashes[: len(lines) - k] * BASE ** np.uint64(k)
    rolling = (rolling ^ (rolling >> np.uint64(31))) * BASE
    ends = np.flatnonzero((rolling >> np.uint64(33)) % np.uint64(DIVISOR) == 0) + 1
    edges = np.unique(np.concatenate([[0], ends, [len(lines)]])).tolist()
    return [(i, j - i, b"\n".join(lines[i:j])) for i, j in zip(edges, edges[1:]) if j - i >= LEAST_LINES and any(x.strip() for x in lines[i:j])]


def chunks(text: str) -> list[tuple[int, int, bytes]]:
    """``(first line, number of lines, bytes)`` of the pairs that may be removed; one of blank lines only never is.

    Two lines with several blank ones between them are a chunk too, so that a repeated stretch goes with the blank lines
    inside it. Of several blank lines at the edge of a stretch the outer ones stay. No two chunks of a run of equal lines
    share the run's second line, so that a run is no repeat of itself; three equal lines are one chunk with the bytes of two.
    """
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    out, last = [], -1  # the last line that is not blank
    for i, line in enumerate(lines):
        blank = not line.strip()
        if i > 1 and not blank and lines[i - 2] == lines[i - 1] == line and (i == 2 or lines[i - 3] != line):
            if lines[i + 1 : i + 2] != [line]:
                out[-1] = (i - 2, 3, out[-1][2])
        elif i and not (blank and last < i - 1):
            out.append((i - 1, LEAST_LINES, lines[i - 1] + b"\n" + line))
        if not blank:
            if 0 <= last < i - LEAST_LINES:
                out.append((last, i - last + 1, b"\n".join(lines[last : i + 1])))
            last = i
    return out


def with_key(docs: DataFrame) -> DataFrame:
    """``docs`` with the id (null: the smallest number) and what tells rows of one id apart: nothing, if their texts are equal, else a digest.

    Rows of equal id and text are one document; rows that share an id, or have none, with other texts are documents of
    their own, so that no text stands in for another.
    """
    named = docs.withColumn(KEY, F.coalesce(docs["doc_id"].cast("long"), F.lit(C.FIRST)))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    mark = F.unhex(F.md5(text))
    ids = named.select(KEY, mark.alias("m")).groupBy(KEY).agg(F.min("m").alias("low"), F.max("m").alias("high"))
    shared = C.cut(ids.where(F.col("low") != F.col("high")).select(F.col(KEY).alias("_shared")))
    both = named.join(shared, F.col(KEY) == F.col("_shared"), "left")
    return both.withColumn(TWIN, F.when(F.col("_shared").isNull(), F.lit(b"")).otherwise(mark)).drop("_shared")


def keyed(docs: DataFrame) -> DataFrame:
    return with_key(docs.select("doc_id", "text")).select(F.col(KEY).alias("doc_id"), F.col(TWIN).alias("twin"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


ROW = ["doc_id", "twin"]
FOUND = "doc_id bigint, twin binary, line bigint, lines bigint, hash binary, inside bigint"
"""``inside``: null for a chunk; for a pair the first line of the chunk that holds it, -1 where it lies across an edge."""


def listing(text: str) -> list[tuple[int, int, bytes, int | None]]:
    """All chunks and pairs of a text."""
    whole = blocks(text)
    home = {}
    for a, n, _ in whole:
        home.update(dict.fromkeys(range(a, a + n), a))
    pairs = [(a, n, d, home.get(a, -1) if home.get(a) == home.get(a + n - 1) else -1) for a, n, d in chunks(text)]
    return [(a, n, d, None) for a, n, d in whole] + pairs


def repeated(found: DataFrame) -> DataFrame:
    """The rows whose hash occurs at two places or more, with ``is_first``; counts are combined before the shuffle."""
    place = F.struct(*ROW, "line")
    first = found.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("first") != F.col("last")).select("hash", "first")
    return found.join(first, "hash").select(*ROW, "line", "lines", "hash", place.eqNullSafe(F.col("first")).alias("is_first")).distinct()


def removals(docs: DataFrame) -> DataFrame:
    """``doc_id, twin, first line, lines``: every chunk and pair to remove, bytes compared.

    Only ids, places and 16-byte hashes are shuffled to find what recurs; pairs inside a chunk that is a repeat itself need
    not be looked up, as those of its first occurrence are. Bytes travel for what recurs alone.
    """
    src = keyed(docs)
    types = (("line", pa.int64()), ("lines", pa.int64()), ("hash", pa.binary()))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in C.rows_of(batches):
            found = listing(r["text"])
            if found:
                a, n, data, inside = zip(*found)
                columns = [pa.array([r["doc_id"]] * len(a), pa.int64()), pa.array([r["twin"]] * len(a), pa.binary()), pa.array(a, pa.int64()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([xxhash.xxh3_128_digest(d) for d in data], pa.binary()), pa.array(inside, pa.int64())], names=[*ROW, "line", "lines", "hash", "inside"])

    found = C.cut(src.mapInArrow(listed, FOUND))
    whole = C.cut(repeated(found.where("inside IS NULL")))
    copies = whole.where(~F.col("is_first")).select(*ROW, F.col("line").alias("inside"))
    pairs = repeated(found.where("inside IS NOT NULL").join(copies, [*ROW, "inside"], "left_anti"))
    again = C.cut(whole.unionByName(pairs))
    wanted = again.groupBy(*ROW).agg(F.collect_list(F.struct("line", "lines", "hash", "is_first")).alias("wanted"))

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in C.rows_of(batches):
            at = {(a, n, xxhash.xxh3_128_digest(d)): d for a, n, d, _ in listing(r["text"])}
            rows = [w for w in r["wanted"] if (w["line"], w["lines"], w["hash"]) in at]
            columns = [pa.array([r["doc_id"]] * len(rows), pa.int64()), pa.array([r["twin"]] * len(rows), pa.binary()), *[pa.array([w[c] for w in rows], t) for c, t in types]]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([w["is_first"] for w in rows], pa.bool_()), pa.array([at[w["line"], w["lines"], w["hash"]] for w in rows], pa.binary())], names=[*ROW, "line", "lines", "hash", "is_first", "data"]
            )

    data = C.cut(src.join(wanted, ROW).mapInArrow(fetched, "doc_id bigint, twin binary, line bigint, lines bigint, hash binary, is_first boolean, data binary"))
    kept = data.where("is_first").select("hash", F.col("data").alias("kept")).distinct()
    same = data.where(~F.col("is_first")).join(kept, "hash").where(F.col("data") == F.col("kept"))
    return same.select(*ROW, "line", "lines").distinct()


def without(text: str, ranges: list) -> tuple[str, int, int]:
    """The text without the given ``(line, lines)`` ranges, its number of lines before, and how many went."""
    lines = text.split("\n")
    gone = np.zeros(len(lines), bool)
    for a, n in ranges:
        gone[a : a + n] = True
    kept = "\n".join(x for x, g in zip(lines, gone.tolist()) if not g) if ranges else text
    return kept, len(lines), int(gone.sum())


REWRITTEN = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("sha256", T.StringType())])


@F.pandas_udf(REWRITTEN)
def rewrite(text: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    rows = []
    for t, r in zip(text, ranges):
        kept, n, gone = without(t or "", [] if r is None else [(x["line"], x["lines"]) for x in r])
        rows.append((kept, n, gone, hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
    return pd.DataFrame(rows, columns=["text", "n_lines", "n_removed", "sha256"])


def rewritten(docs: DataFrame) -> DataFrame:
    """``docs`` with one more column, ``__line_chunk``: the text left, lines before, lines removed, digest of the text left.

    A null text is empty with one empty line. An empty table gives an empty table. All columns are kept as they are.
    """
    ranges = removals(docs).groupBy(*ROW).agg(F.collect_list(F.struct("line", "lines")).alias("__line_ranges")).withColumnsRenamed({"doc_id": KEY, "twin": TWIN})
    joined = with_key(docs).join(ranges, [KEY, TWIN], "left")
    return joined.withColumn("__line_chunk", rewrite(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("__line_ranges"))).drop(KEY, TWIN, "__line_ranges")


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_removed, text, kept_sha256``: one row per input row."""
    made = rewritten(docs.select("doc_id", "text"))
    return made.select("doc_id", *[F.col("__line_chunk")[c].alias(c) for c in ("n_lines", "n_removed", "text")], F.col("__line_chunk")["sha256"].alias("kept_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated chunks gone from ``text`` and ``n_chars``, where there is one, counted again."""
    made = rewritten(docs)
    text = F.col("__line_chunk")["text"]
    made = made.withColumn("text", F.when(F.col("__line_chunk")["n_removed"] > 0, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(F.col("__line_chunk")["n_removed"] > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return made.drop("__line_chunk").select(*docs.columns)
