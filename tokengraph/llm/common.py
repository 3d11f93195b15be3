"""Helpers shared by the operators: reading, value ranges, packing of arrays, exact word splitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokengraph.session import cut  # noqa: F401  (the lineage cut of every operator here)

FIRST = -(1 << 63)
"""Stands for a null id where rows are put in order: such rows come first."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns an operator needs, under fixed names; a null text is empty, other columns are left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def range_bounds(docs: DataFrame, rows_per_range: int) -> list[int]:
    """Ids at which value ranges of about ``rows_per_range`` rows begin; the first is the smallest id.

    Only the id column is read. Every bound is an id that occurs, so the row at a bound is the first of its range.
    The list has one entry per range (8 bytes for each few thousand documents), which is what bounds its size.
    """
    ids = docs.select(F.coalesce(F.col("doc_id"), F.lit(FIRST)).alias("k"))
    n, low = ids.agg(F.count("*"), F.min("k")).first()
    if not n:
        return [FIRST]
    parts = max(1, -(-n // rows_per_range))
    if parts == 1:
        return [low]
    marks = ids.select(F.percentile_approx("k", [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first()[0]
    return sorted({low, *marks})


def range_of(bounds: np.ndarray, ids: pa.Array) -> np.ndarray:
    keys = np.asarray(ids.fill_null(FIRST).to_numpy(zero_copy_only=False), dtype=np.int64)
    return np.maximum(np.searchsorted(bounds, keys, side="right") - 1, 0).astype(np.int32)


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=dtype)


def squeeze(b: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(b)


def expand(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def rows_of(batches: Iterator[pa.RecordBatch], step: int = 64) -> Iterator[dict]:
    """Rows one at a time, so that a task holds one Arrow batch and one row of Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, step):
            yield from b.slice(i, step).to_pylist()


def partition_id() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def in_groups(rows: Iterator[dict], key: Callable[[dict], object]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Consecutive rows with one key; each group is a stream."""
    from itertools import groupby

    yield from groupby(rows, key)


def next_power(x: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, x)))))


ODD = 0x9E3779B97F4A7C15
BYTE_WORDS = np.random.RandomState(101).randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse modulo 2**64, kept per process."""
    if len(_POWERS[0]) < n:
        size = next_power(n)
        for k, base in enumerate((ODD, pow(ODD, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return [p[:n] for p in _POWERS]


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of many byte spans of one array, by prefix sums: equal bytes have equal hashes wherever they stand."""
    power, inverse = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_WORDS[data] * power, out=sums[1:])
    h = (sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64)
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))
