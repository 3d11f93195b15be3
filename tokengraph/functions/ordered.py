"""Ordered operators that stay parallel when one group holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokengraph.session import cut

BLOCK = 4096


def carry_forward(
    df: DataFrame, keys: list[str], order: str, last_of: str, out: str, first_of: str | None = None, block: int = BLOCK
) -> DataFrame:
    """Last non-null ``last_of`` strictly before each row, per key in ``order`` (an integer ordinal).

    Where there is none, the first non-null ``first_of`` before the row. A plain running window would pull a whole
    group into one task. Here the ordinal is cut into blocks: the window runs inside a block, each block is summarised
    by combinable aggregates, and only the short list of summaries per key is scanned to carry values between blocks.
    """
    first_of = first_of or last_of
    blocked = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)).cast("bigint"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = blocked.withColumn("_last", F.last(last_of, ignorenulls=True).over(inside)).withColumn(
        "_first", F.first(first_of, ignorenulls=True).over(inside)
    )
    at = F.col(order).alias("o")
    ends = blocked.groupBy(*keys, "_block").agg(
        F.max(F.when(F.col(last_of).isNotNull(), F.struct(at, F.col(last_of).alias("v")))).alias("_e"),
        F.min(F.when(F.col(first_of).isNotNull(), F.struct(at, F.col(first_of).alias("v")))).alias("_s"),
    )
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keys,
        "_block",
        F.last("_e.v", ignorenulls=True).over(across).alias("_carried_last"),
        F.first("_s.v", ignorenulls=True).over(across).alias("_carried_first"),
    )
    return (
        local.join(carried, [*keys, "_block"], "left")
        .withColumn(out, F.coalesce("_last", "_carried_last", "_carried_first", "_first"))
        .drop("_block", "_last", "_first", "_carried_last", "_carried_first")
    )


def number_rows(df: DataFrame, order: list[str], out: str, keys: list[str] | None = None) -> DataFrame:
    """Add ``out``, the place from 0 of each row in ``order`` per ``keys`` (over all rows without keys), by many tasks.

    Rows are dealt in ranges and numbered inside; the ranges' counts, a row per range and key, give each its offset. A key
    that holds most rows is spread over ranges like any other, as long as ``order`` tells its rows apart.
    """
    keys = keys or []
    kept = cut(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id()))
    part, row = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")
    placed = kept.select(*df.columns, part, row)
    sizes = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    on = F.col("_part") == F.col("_p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return placed.join(starts, on).select(*df.columns, (F.col("_start") + F.col("_row")).alias(out))


def nth_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The ``n`` first rows of every group. Spark trims each group to ``n`` rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)


def chunked_text(
    lines: DataFrame, keys: list[str], line: str, out: str = "text", per_chunk: int = 1000, order: list[str] | None = None, glue: str = "\n"
) -> DataFrame:
    """Concatenate lines per key, in ``order``, into chunks of bounded size: (keys…, chunk, n_lines, out).

    The chunk of a line follows from its place in the key alone, so the chunks put together are the whole ordered text,
    whatever its length, and a key with very many lines is numbered and joined by many tasks. Without ``order`` lines are
    sorted by themselves.
    """
    columns = [*keys, line, *[o for o in order or [] if o != line and o not in keys]]
    placed = number_rows(lines.select(*columns), [*(order or []), *([] if order and line in order else [line])], "_place", keys)
    return _chunks(placed, keys, line, out, per_chunk, glue)


def chunked_in_place(lines: DataFrame, keys: list[str], line: str, out: str, per_chunk: int, order: list[str], glue: str = "\n") -> DataFrame:
    """``chunked_text`` for keys of bounded size whose lines lie in one partition already, dealt by some of the keys.

    They are numbered and joined where they are. A key's lines are sorted in one task.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return _chunks(lines.withColumn("_place", place), keys, line, out, per_chunk, glue)


def _chunks(placed: DataFrame, keys: list[str], line: str, out: str, per_chunk: int, glue: str) -> DataFrame:
    chunks = placed.withColumn("chunk", F.floor(F.col("_place") / per_chunk).cast("bigint")).groupBy(*keys, "chunk")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", F.col(line).alias("l")))), lambda x: x["l"]), glue)
    return chunks.agg(F.count("*").alias("n_lines"), text.alias(out))
