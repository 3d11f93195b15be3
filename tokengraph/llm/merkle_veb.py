"""Merkle manifest of a table: one tree per language and one over the languages, stored in van Emde Boas layout.

A row is a leaf. The leaves of a language are put in order, cut into aligned subtrees of ``HEIGHT`` levels, and every
subtree is one row whose digests lie in van Emde Boas order: the upper half of its levels first, then the lower
subtrees from left to right, each laid out the same way. The roots of subtrees are the leaves of the next tier, until a
language is one subtree; the roots of the languages are the leaves of a last forest. Building and reading siblings use
the same address arithmetic, so a path from a leaf up touches few stretches of memory whatever the size of a cache line.

Texts are read once, for their digests; only ids and digests are shuffled. A task holds one subtree at a time.

A null value is hashed as ``-``. Rows of one language are in order of id (null first), then of leaf; equal rows are
leaves of their own. A null language is a language of its own, before all others. Other columns are not part of a leaf.
An empty table gives no rows. One row gives a tree of one node: its proof is the digest of nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokengraph.llm import common as C

HEIGHT = 10
"""Levels of a subtree: 1,024 leaves, the bound of what one task holds of the tree."""
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEFT, RIGHT, ALONE = 0, 1, 2
"""Where the sibling of a step stands; a last node without a sibling is hashed alone."""


def address(height: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` at ``depth`` (0 is the root) of a complete tree of ``height`` levels below its root.

    The tree is split at half its levels. A node of the upper part keeps its place there; one of the lower part lies
    behind the whole upper part and behind the lower subtrees left of its own.
    """
    at = np.zeros(len(index), np.int64)
    index = np.asarray(index, np.int64)
    levels = height + 1
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        depth, levels = depth - upper, levels - upper
        at += (1 << upper) - 1 + (index >> depth) * ((1 << levels) - 1)
        index = index & ((1 << depth) - 1)
    return at


@lru_cache(maxsize=256)
def _level(height: int, depth: int) -> np.ndarray:
    return address(height, depth, np.arange(1 << depth))


def h(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def build_block(leaves: np.ndarray, height: int) -> np.ndarray:
    """Digests of a subtree in layout order (rows of 32 bytes) from the digests of its first ``len(leaves)`` leaves."""
    nodes = np.zeros(((2 << height) - 1, DIGEST), np.uint8)
    nodes[_level(height, height)[: len(leaves)]] = leaves
    width = len(leaves)
    for depth in range(height, 0, -1):
        hexes = nodes[_level(height, depth)[:width]].tobytes().hex().encode()
        pair = 4 * DIGEST
        made = b"".join(hashlib.sha256(hexes[i : i + pair]).digest() for i in range(0, len(hexes), pair))
        width = (width + 1) // 2
        nodes[_level(height, depth - 1)[:width]] = np.frombuffer(made, np.uint8).reshape(-1, DIGEST)
    return nodes


def siblings(nodes: np.ndarray, height: int, n: int, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digests, sides) from the leaves ``index`` up to the root of their subtree, read by address."""
    digests = np.zeros((len(index), height, DIGEST), np.uint8)
    sides = np.full((len(index), height), ALONE, np.uint8)
    at, width = np.asarray(index, np.int64), n
    for step in range(height):
        other = at ^ 1
        there = other < width
        digests[there, step] = nodes[address(height, height - step, other[there])]
        sides[there, step] = np.where(at[there] & 1, LEFT, RIGHT)
        at, width = at >> 1, (width + 1) // 2
    return digests, sides


def pack_path(digests: np.ndarray, sides: np.ndarray) -> list[bytes]:
    """Paths as bytes: a side and a digest per step."""
    both = np.concatenate([sides[:, :, None], digests], axis=2)
    return [row.tobytes() for row in both]


def path_steps(path: bytes) -> list[tuple[int, bytes]]:
    """(side, hex digest) per step of a packed path."""
    step = DIGEST + 1
    return [(path[i], path[i + 1 : i + step].hex().encode()) for i in range(0, len(path), step)]


def fold(leaf: bytes, steps: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf (hex) leads to along its path."""
    for side, digest in steps:
        both = leaf if side == ALONE else digest + leaf if side == LEFT else leaf + digest
        leaf = hashlib.sha256(both).hexdigest().encode()
    return leaf


# --- leaves ---------------------------------------------------------------------------------------------------------


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of text columns: ``-`` for null, else the byte count, a colon and the value."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in fields]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(run, doc_id, leaf, bad, tie): digests of the rows as they are, and of the tampered ones with 1 added to ``n_chars``."""
    value = {f: F.col(f).cast("string") for f in FIELDS}
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    chosen = F.crc32(value["doc_id"].cast("binary")) % 7 == 0
    return docs.select(
        F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang").cast("string"))).alias("run"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest([value[f] for f in FIELDS]).alias("leaf"),
        F.when(chosen, leaf_digest([more if f == "n_chars" else value[f] for f in FIELDS])).alias("bad"),
        F.monotonically_increasing_id().alias("tie"),
    )


# --- construction ---------------------------------------------------------------------------------------------------


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``at`` (place in the run, from 0) and ``n`` (rows of the run).

    Ranges of (run, order) are counted first, and a range goes on from the sum of those before it, so a run that holds
    most rows is numbered by many tasks. The last column of ``order`` differs in every row, so any run can be split.
    """
    schema = pa.schema([("part", pa.int32()), ("within", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, done = C.partition_id(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            names = np.asarray(b.column("run").to_pylist(), object)
            starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
            within = np.arange(b.num_rows, dtype=np.int64)
            begun = within - np.repeat(starts, np.diff(np.append(starts, b.num_rows)))
            first = int(starts[1]) if len(starts) > 1 else b.num_rows
            if names[0] == run:
                begun[:first] += done
            run, done = names[-1], int(begun[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(begun)], names=[*b.schema.names, *schema.names])

    ranged = rows.repartitionByRange("run", *order).sortWithinPartitions("run", *order)
    kept = C.cut(ranged.mapInArrow(count, f"{_ddl(rows)}, part int, within long"))
    from pyspark.sql import Window

    counts = kept.groupBy("run", "part").agg(F.count("*").alias("c"))  # a row per range and run
    before = Window.partitionBy("run").orderBy("part")
    offsets = C.cut(
        counts.select("run", "part", (F.sum("c").over(before) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy("run")).alias("n"))
    )
    return kept.join(offsets, ["run", "part"]).select(*rows.columns, (F.col("before") + F.col("within")).alias("at"), "n")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def levels_of(n: int) -> int:
    """Levels above the leaves of a run of ``n``."""
    return max(0, int(n) - 1).bit_length()


@dataclass
class Forest:
    """Tiers of subtrees from the leaves up: (run, block, n, height, total, items, nodes, root) in each."""

    tiers: list[DataFrame]
    step: int

    def roots(self) -> DataFrame:
        """(run, root) of every run."""
        parts = [t.filter(F.col("total") <= 1 << self.step).select("run", "root") for t in self.tiers]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def forest(rows: DataFrame, order: list[str], payload: list[str], step: int) -> Forest:
    """Subtrees of ``step`` levels of every run of (run, leaf, order…, payload…); ``payload`` columns stay with the leaves of the lowest tier."""
    tier = numbered(rows, order)
    tiers: list[DataFrame] = []
    keep = payload
    while True:
        made = C.cut(_blocks(tier, keep, step))
        tiers.append(made)
        above = made.filter(F.col("total") > 1 << step).select(
            "run", F.col("block").alias("at"), F.ceil(F.col("total") / (1 << step)).cast("long").alias("n"), F.col("root").alias("leaf")
        )
        if above.isEmpty():  # a tier has a 1,024th of the rows of the one below
            return Forest(tiers, step)
        tier, keep = above, []


def _blocks(rows: DataFrame, payload: list[str], step: int) -> DataFrame:
    item = F.struct((F.col("at") % (1 << step)).cast("int").alias("at"), "leaf", *payload)
    grouped = rows.groupBy("run", F.shiftright("at", step).alias("block")).agg(
        F.count("*").cast("int").alias("n"), F.max("n").alias("total"), F.array_sort(F.collect_list(item)).alias("items")
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                items = row.column("items").flatten()
                total = row.column("total")[0].as_py()
                height = min(step, levels_of(total))
                nodes = build_block(_digests(items.field("leaf")), height)
                more = [pa.array([height], pa.int32()), pa.array([nodes.tobytes()], pa.binary()), pa.array([nodes[0].tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([*row.columns, *more], names=[*row.schema.names, "height", "nodes", "root"])

    return grouped.mapInArrow(build, f"{_ddl(grouped)}, height int, nodes binary, root binary")


def _digests(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, DIGEST)


# --- paths ----------------------------------------------------------------------------------------------------------


def above_blocks(made: Forest, above: DataFrame) -> DataFrame:
    """(run, block, subroot, above) of the lowest tier: the root of the run, and the path from the root of each subtree to the top.

    ``above``: run, subroot, above, the path from the root of a run on. Only the one top subtree of a run meets it by
    the run; all others get theirs from the subtree above, by run and block, so a run that holds most rows stays spread.
    """
    paths, step = None, made.step

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in C.rows_of(batches, 1):
            nodes = np.frombuffer(r["nodes"], np.uint8).reshape(-1, DIGEST)
            inside = pack_path(*siblings(nodes, r["height"], r["n"], np.arange(r["n"])))
            first = r["block"] << step
            columns = [pa.array([r["run"]] * r["n"]), pa.array(range(first, first + r["n"]), pa.int64()), pa.array([r["subroot"]] * r["n"], pa.binary()), pa.array([p + r["above"] for p in inside], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["run", "block", "subroot", "above"])

    for tier in reversed(made.tiers):
        top = tier.filter(F.col("total") <= 1 << step).select("run", "block").join(above, "run")
        paths = top if paths is None else paths.unionByName(top)
        if tier is made.tiers[0]:
            return paths
        whole = tier.select("run", "block", "n", "height", "nodes").join(paths, ["run", "block"])
        paths = C.cut(whole.mapInArrow(below, "run string, block long, subroot binary, above binary"))
    raise ValueError("a forest has one tier at least")


@dataclass
class Manifest:
    """The forest of the rows, the forest over the roots of their runs, and the digest over all (None if empty)."""

    rows: Forest
    runs: Forest
    root: bytes | None

    def subroots(self) -> DataFrame:
        return self.rows.roots()

    def run_paths(self) -> DataFrame:
        """(run, subroot, above): the root of each run and the path from there to the root of everything."""
        names = self.runs.tiers[0]
        one = names.sparkSession.createDataFrame([("", self.root or b"", b"")], "run string, subroot binary, above binary")
        whole = names.select("run", "block", "n", "height", "nodes", "items").join(above_blocks(self.runs, one), ["run", "block"])

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in C.rows_of(batches, 1):
                nodes = np.frombuffer(r["nodes"], np.uint8).reshape(-1, DIGEST)
                paths = pack_path(*siblings(nodes, r["height"], r["n"], np.arange(r["n"])))
                columns = [pa.array([i["name"] for i in r["items"]]), pa.array([i["leaf"] for i in r["items"]], pa.binary()), pa.array([p + r["above"] for p in paths], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["run", "subroot", "above"])

        return whole.mapInArrow(spread, "run string, subroot binary, above binary")


def manifest(docs: DataFrame, step: int = HEIGHT) -> Manifest:
    """Leaves, subtrees of ``step`` levels and root of ``docs`` (doc_id, source, lang, n_chars, text)."""
    rows = forest(C.cut(leaves(docs)), ["doc_id", "leaf", "tie"], ["doc_id", "bad"], step)
    subroots = rows.roots().select(F.lit("").alias("run"), F.col("run").alias("name"), F.col("root").alias("leaf"))
    runs = forest(subroots, ["name"], ["name"], step)
    top = runs.roots().first()
    return Manifest(rows, runs, bytes(top["root"]) if top else None)


def proofs(made: Manifest) -> DataFrame:
    """One row per leaf: its digest, the roots, the digest of its siblings, and the root that the row, tampered or not, folds to."""
    run_paths = C.cut(made.run_paths())
    whole = made.rows.tiers[0].join(above_blocks(made.rows, run_paths), ["run", "block"])
    root = (made.root or b"").hex()
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in C.rows_of(batches, 1):
            nodes = np.frombuffer(r["nodes"], np.uint8).reshape(-1, DIGEST)
            inside = pack_path(*siblings(nodes, r["height"], r["n"], np.arange(r["n"])))
            above = path_steps(r["above"])
            beyond = b"".join(d for side, d in above if side != ALONE)
            out: list[tuple] = []
            for item, path in zip(r["items"], inside):
                steps = path_steps(path)
                proof = h(b"".join(d for side, d in steps if side != ALONE) + beyond)
                start = item["leaf"] if item["bad"] is None else item["bad"]
                folded = fold(start.hex().encode(), steps + above).decode()
                out.append((item["doc_id"], item["leaf"].hex(), r["subroot"].hex(), root, proof, folded, folded == root))
            yield C.batch(schema, list(zip(*out)))

    return whole.mapInArrow(prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def prove_all(docs: DataFrame, step: int = HEIGHT) -> DataFrame:
    return proofs(manifest(docs, step))
