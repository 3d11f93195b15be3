"""Breadth-first search from very many seeds at once: one row per node and group of 64 seeds, the seeds as bits.

Seeds get numbers in an order that keeps those with a common way on together, and 64 neighbouring numbers are one ``block``. A step moves masks along the edges and joins arrivals by
``bit_or``, which combines before the shuffle, so a hub that all seeds reach costs a row per 64 of them. A seed is walked
once, to the greatest depth anyone asks for; who asked comes last, by a join on the seed's number.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokengraph.session import cut

_PLACES = json.dumps([[[8 * byte + bit for bit in range(8) if value >> bit & 1] for value in range(256)] for byte in range(8)])


def bit_places(mask: Column) -> Column:
    """Places of the set bits of a bigint, by a table per byte."""
    places = F.from_json(F.lit(_PLACES), "array<array<array<int>>>")  # one literal: the planner folds it
    byte = [F.shiftrightunsigned(mask, 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(8)]
    return F.flatten(F.array(*[F.get(F.get(places, F.lit(i)), b) for i, b in enumerate(byte)]))


def busiest_way(adj: DataFrame) -> DataFrame:
    """(_node, _way) as hashes: the neighbour of each node that leads on to most nodes, so most of what the node reaches.

    Hashes only: they decide which seeds lie together, never what is found.
    """
    steps = adj.select(F.xxhash64("node").alias("_node"), F.xxhash64("neighbour").alias("_next"))
    out = steps.groupBy(F.col("_node").alias("_next")).agg(F.least(F.count("*"), F.lit((1 << 23) - 1)).alias("n")).filter("n > 1")
    packed = F.shiftleft("n", 40).bitwiseOR(F.col("_next").bitwiseAND(F.lit((1 << 40) - 1)))
    return steps.join(out, "_next").groupBy("_node").agg(F.max(packed).alias("_way"))


def number_seeds(seeds: DataFrame, adj: DataFrame) -> DataFrame:
    """(node, depth, seed): a number per distinct node, with the greatest depth asked for; materialised, so numbers stay.

    Seeds with the same busiest neighbour get numbers in a row: they share a block, and one mask holds what they all reach.
    """
    one = seeds.groupBy("node").agg(F.max("depth").alias("depth"))
    order = ["depth", "_way", "node"]
    near = one.join(busiest_way(adj), F.xxhash64("node") == F.col("_node"), "left").select(*order)
    return cut(near.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seed", F.monotonically_increasing_id()).drop("_way"))


def _any(names: list[str], side: str = "") -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), [F.col(side + n) for n in names])


@dataclass
class Walk:
    """``masks``: node, depth, block, f0 … fD, the seeds that find the node at each hop first; ``seeds``: node, depth, seed."""

    masks: DataFrame
    seeds: DataFrame
    depth: int

    def reached(self) -> DataFrame:
        """(seed, node, hop) with the smallest hop; ``seed`` is the number."""
        levels = F.array(*[F.struct(F.lit(h).alias("hop"), F.col(f"f{h}").alias("mask")) for h in range(self.depth + 1)])
        return _by_seed(self.masks.select("block", "node", F.explode(levels).alias("l")).select("block", "node", "l.*"), ["node", "hop"])

    def edges(self, edges: DataFrame) -> DataFrame:
        """(seed, level, edge columns…): edges with both ends reached, and the depth from which on they are."""
        cols = edges.columns
        both = self.inside(edges)
        within = [F.col(f"w{h}") for h in range(self.depth + 1)]
        fresh = [w if h == 0 else w.bitwiseAND(F.bitwise_not(within[h - 1])) for h, w in enumerate(within)]
        levels = F.array(*[F.struct(F.lit(h).alias("level"), m.alias("mask")) for h, m in enumerate(fresh)])
        return _by_seed(both.select("block", *cols, F.explode(levels).alias("l")).select("block", *cols, "l.*"), ["level", *cols])

    def inside(self, edges: DataFrame, ends: bool = True) -> DataFrame:
        """(edge columns…, depth, block, w0 … wD): the seeds of a block that reach both ends within each number of hops.

        A row stands for all those seeds. Without ``ends`` the names of the ends are dropped as soon as they have met.
        """
        hops = [f"f{h}" for h in range(self.depth + 1)]
        cols = [c for c in edges.columns if ends or c not in ("source", "target")]
        near = self.masks.select(F.col("node").alias("source"), "depth", "block", *[F.col(f).alias(f"s{f}") for f in hops])
        far = self.masks.select(F.col("node").alias("target"), "depth", "block", *[F.col(f).alias(f"t{f}") for f in hops])
        met = edges.join(near, "source").select(*{*cols, "target"}, "depth", "block", *[f"s{f}" for f in hops])
        both = met.join(far, ["target", "depth", "block"])
        within = [_any(hops[: h + 1], "s").bitwiseAND(_any(hops[: h + 1], "t")) for h in range(self.depth + 1)]
        return both.select(*cols, "depth", "block", *[w.alias(f"w{h}") for h, w in enumerate(within)]).filter(F.col(f"w{self.depth}") != 0)


def _by_seed(rows: DataFrame, cols: list[str]) -> DataFrame:
    found = rows.filter(F.col("mask") != 0).select("block", *cols, F.explode(bit_places(F.col("mask"))).alias("bit"))
    return found.select((F.shiftleft("block", 6) + F.col("bit")).alias("seed"), *cols)


def walk(seeds: DataFrame, adj: DataFrame, depth: int) -> Walk:
    """Reach of (node, depth) seeds along ``adj`` (node, neighbour), up to each seed's own depth and ``depth`` at most.

    One lazy plan; every hop exchanges masks once. A seed stops where its depth is used up: its bits stay but move no more.
    """
    numbered = number_seeds(seeds.filter(F.col("node").isNotNull()).select("node", F.least(F.col("depth"), F.lit(depth)).alias("depth")), adj)
    keys = ["node", "depth", "block"]
    bit = F.expr("shiftleft(1L, int(seed & 63))")
    state = numbered.filter(F.col("node").isNotNull()).select("node", "depth", F.shiftright("seed", 6).alias("block"), bit.alias("f0"), F.when(F.col("depth") > 0, bit).otherwise(0).alias("go"))
    for hop in range(1, depth + 1):
        before = [f"f{h}" for h in range(hop)]
        nothing = F.lit(0).cast("bigint")
        moved = state.filter(F.col("go") != 0).join(adj, "node").select(
            F.col("neighbour").alias("node"), "depth", "block", *[nothing.alias(f) for f in before], F.col("go").alias("arrived")
        )
        met = state.select(*keys, *before, nothing.alias("arrived")).unionByName(moved)
        merged = met.groupBy(*keys).agg(*[F.bit_or(f).alias(f) for f in before], F.bit_or("arrived").alias("arrived"))
        new = F.col("arrived").bitwiseAND(F.bitwise_not(_any(before)))
        # Both uses of a hop share one exchange if the planner pushes the same filters into both: the frontier is told by a
        # computed column, not by the grouping key, and the join's own "not null" is said for both.
        state = merged.filter(F.col("node").isNotNull()).select(*keys, *before, new.alias(f"f{hop}")).withColumn("go", F.when(F.col("depth") > hop, F.col(f"f{hop}")).otherwise(0))
    return Walk(cut(state.drop("go")), numbered, depth)
