"""Short codes for vectors: one byte per part, from codebooks that rounds of exact integer k-means move.

A vector becomes integers and is cut into equal parts; each part position has a codebook. Drake and Hamerly's adaptive
bounds spare most distances: a part keeps its ``b`` closest entries, a lower bound for each of them in ascending order,
one upper bound for the entry it has, and one outer bound for all entries not listed. When entries move, bounds move by
as much. A part whose upper bound is below every lower bound keeps its entry; else exact integer distances to the entries
in doubt decide (ties to the lower index), and only if the outer bound is reached are all entries looked at. After every
round ``b`` follows the depth that parts needed.

Bounds are stored with the vectors in a table per round, so a lost executor repeats one pass of its share. Sums are
gathered as changes (parts that left or joined an entry), combined per task and then by Spark; the driver sees codebook
sized results only: parts x entries x width numbers.

A null vector and one with a null or non-finite component are left out. The dimension is the length of the vector with
the smallest id (of equal ids, the smallest vector) among those whose length is a multiple of the parts; vectors of another length are left out.
Repeated rows count each; rows without an id are coded, and seed codebooks only after all others. Fewer vectors than
entries give as many entries as vectors. Components beyond the exact integer range (about 23,000 at 16 components a
part) raise an error. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokengraph.llm import common as C

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
CLOSEST, MOST_CLOSEST = 16, 64
"""Listed entries of a part in the first round, and the most that a later round may list."""
CHUNK = 2048


def record(b: int) -> np.dtype:
    """What a part keeps: its ``b`` closest entries, the lower bound of each, the upper bound of the first, the outer bound."""
    return np.dtype([("near", "u1", (b,)), ("low", "<f4", (b,)), ("upper", "<f4"), ("outer", "<f4")])


def down(v: np.ndarray) -> np.ndarray:
    return np.nextafter(v.astype(np.float32), np.float32(-np.inf))


def up(v: np.ndarray) -> np.ndarray:
    return np.nextafter(v.astype(np.float32), np.float32(np.inf))


def distances(x: np.ndarray, book: np.ndarray, exact: bool) -> np.ndarray:
    """Squared distances of all rows to all entries as integers; ``exact`` says that doubles hold them without loss."""
    if exact:
        xf, bf = x.astype(np.float64), book.astype(np.float64)
        return ((xf * xf).sum(axis=1)[:, None] - 2.0 * (xf @ bf.T) + (bf * bf).sum(axis=1)).astype(np.int64)
    d = np.zeros((len(x), len(book)), np.int64)
    for i in range(x.shape[1]):
        d += np.square(x[:, i, None] - book[None, :, i])
    return d


def scan(x: np.ndarray, book: np.ndarray, b: int, exact: bool) -> np.ndarray:
    """Fresh records from the distances to all entries."""
    k = len(book)
    out = np.zeros(len(x), record(b))
    for i in range(0, len(x), CHUNK):
        keys = distances(x[i : i + CHUNK], book, exact) * k + np.arange(k)  # by distance, then by index
        if k > b:
            keys = np.partition(keys, b, axis=1)
            outer = down(np.sqrt((keys[:, b] // k).astype(np.float64)))
            keys = keys[:, :b]
        else:
            outer = np.full(len(keys), np.inf, np.float32)
        keys = np.sort(keys, axis=1)
        root = np.sqrt((keys // k).astype(np.float64))
        r = out[i : i + CHUNK]
        r["near"], r["low"], r["upper"], r["outer"] = keys % k, down(root), up(root[:, 0]), outer
    return out


def resize(r: np.ndarray, b: int) -> np.ndarray:
    """Records with ``b`` listed entries: dropped ones go to the outer bound, missing ones repeat the first under it."""
    old = r["near"].shape[1]
    if old == b:
        return r
    out = np.zeros(len(r), record(b))
    m = min(b, old)
    out["near"][:, :m], out["low"][:, :m] = r["near"][:, :m], r["low"][:, :m]
    out["near"][:, m:], out["low"][:, m:] = r["near"][:, :1], r["outer"][:, None]
    out["upper"] = r["upper"]
    out["outer"] = np.minimum(r["outer"], r["low"][:, m:].min(axis=1)) if old > b else r["outer"]
    return out


def follow(x: np.ndarray, r: np.ndarray, book: np.ndarray, drift: np.ndarray, b: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """(records, depth) after entries moved by ``drift`` at most; ``depth`` is how many listed entries were in doubt, ``old + 1`` for all."""
    old, k = r["near"].shape[1], len(book)
    r = r.copy()
    r["upper"] = up(r["upper"].astype(np.float64) + drift[r["near"][:, 0]])
    r["low"] = down(r["low"].astype(np.float64) - drift[r["near"]])
    r["outer"] = down(r["outer"].astype(np.float64) - drift.max(initial=0.0))
    # beyond[:, j]: a bound for every entry but the first j + 1 of the list, ascending in j
    beyond = np.concatenate([r["low"][:, 1:], r["outer"][:, None]], axis=1)
    beyond = np.minimum.accumulate(beyond[:, ::-1], axis=1)[:, ::-1]
    depth = np.ones(len(r), np.int64)
    doubt = np.flatnonzero(r["upper"] >= beyond[:, 0])
    if len(doubt):
        own = np.square(x[doubt] - book[r["near"][doubt, 0]]).sum(axis=1)
        r["upper"][doubt] = up(np.sqrt(own.astype(np.float64)))
        depth[doubt] = 1 + (beyond[doubt] <= r["upper"][doubt, None]).sum(axis=1)
        listed = doubt[(depth[doubt] > 1) & (depth[doubt] <= old)]
        for i in range(0, len(listed), CHUNK):
            rows = listed[i : i + CHUNK]
            most = int(depth[rows].max())
            near = r["near"][rows, :most].astype(np.int64)
            keys = np.square(x[rows][:, None, :] - book[near]).sum(axis=2) * k + near
            inside = np.arange(most) < depth[rows][:, None]
            order = np.argsort(np.where(inside, keys, np.iinfo(np.int64).max), axis=1, kind="stable")
            keys, near = np.take_along_axis(keys, order, 1), np.take_along_axis(near, order, 1)
            root = np.sqrt((keys // k).astype(np.float64))
            r["low"][rows, :most] = np.where(inside, down(root), r["low"][rows, :most])
            r["near"][rows, :most], r["upper"][rows] = near, up(root[:, 0])
    out = resize(r, b)
    whole = np.flatnonzero(depth > old)
    if len(whole):
        out[whole] = scan(x[whole], book, b, exact)
    return out, depth


# --- passes over the vectors ----------------------------------------------------------------------------------------


@dataclass
class Books:
    """Codebooks (parts, entries, width) with what the next pass needs to know."""

    entries: np.ndarray
    drift: np.ndarray
    exact: bool

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


STATE = "vec_id long, label int, x array<int>, kept binary, cells array<int>, sums array<long>"
_SCHEMA = pa.schema([("vec_id", pa.int64()), ("label", pa.int32()), ("x", pa.list_(pa.int32())), ("kept", pa.binary()), ("cells", pa.list_(pa.int32())), ("sums", pa.list_(pa.int64()))])


def _vectors(b: pa.RecordBatch, shape: tuple[int, int, int]) -> np.ndarray:
    parts, _, width = shape
    return b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, parts, width)


def _kept(b: pa.RecordBatch, parts: int, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("kept").to_pylist()), record(size)).reshape(b.num_rows, parts)


def _records(x: np.ndarray, kept: np.ndarray | None, books: Books, b: int) -> tuple[np.ndarray, np.ndarray | None]:
    found, depths = [], []
    for p, book in enumerate(books.entries):
        if kept is None:
            found.append(scan(x[:, p], book, b, books.exact))
        else:
            r, depth = follow(x[:, p], kept[:, p], book, books.drift[p], b, books.exact)
            found.append(r)
            depths.append(depth)
    return np.stack(found, axis=1), np.stack(depths, axis=1) if depths else None


def assign(state: DataFrame, books: Books, size: int | None, b: int) -> DataFrame:
    """One pass: vectors with fresh records of ``b`` entries, and a row of changed sums per task.

    ``size`` is the list length of the records in ``state``, None in the first pass. Cells of the sums are numbered by
    (part, entry, component), the count behind the components; the depths that were needed come behind all cells.
    """
    shape = books.entries.shape
    parts, k, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((parts, k, width + 1), np.int64)
        depths = np.zeros(MOST_CLOSEST + 2, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch, shape)
            before = None if size is None else _kept(batch, parts, size)
            after, depth = _records(x, before, books, b)
            if depth is not None:
                depths += np.bincount(np.where(depth > size, MOST_CLOSEST + 1, depth).reshape(-1), minlength=MOST_CLOSEST + 2)
            for p in range(parts):
                new = after["near"][:, p, 0]
                moved = np.ones(len(x), bool) if before is None else new != before["near"][:, p, 0]
                whole = np.concatenate([x[moved, p], np.ones((int(moved.sum()), 1), np.int64)], axis=1)
                np.add.at(totals[p], new[moved], whole)
                if before is not None:
                    np.subtract.at(totals[p], before["near"][moved, p, 0], whole)
            none = pa.nulls(batch.num_rows)
            rows = np.ascontiguousarray(after)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("vec_id", "label", "x")), pa.array([row.tobytes() for row in rows], pa.binary()), none.cast(_SCHEMA.field("cells").type), none.cast(_SCHEMA.field("sums").type)], schema=_SCHEMA
            )
        flat = np.concatenate([totals.reshape(-1), depths])
        cells = np.flatnonzero(flat)
        yield C.batch(_SCHEMA, [[None], [None], [None], [None], [cells.astype(np.int32)], [flat[cells]]])

    return state.mapInArrow(run, STATE)


def gathered(rows: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(changes of the sums with the count last, depths) from the rows that tasks left; as many cells as the codebooks have."""
    parts, k, width = shape
    found = (
        rows.filter(F.col("cells").isNotNull()).select(F.explode(F.arrays_zip("cells", "sums")).alias("c"))
        .groupBy("c.cells").agg(F.sum("c.sums").alias("s")).toArrow()
    )
    flat = np.zeros(parts * k * (width + 1) + MOST_CLOSEST + 2, np.int64)
    flat[found.column("cells").to_numpy()] = found.column("s").to_numpy()
    n = parts * k * (width + 1)
    return flat[:n].reshape(parts, k, width + 1), flat[n:]


def adapted(b: int, depths: np.ndarray, k: int) -> int:
    """The next list length: doubled if over a sixteenth needed all entries, else as short as serves all but a 64th."""
    total = int(depths.sum())
    if not total:
        return b
    if depths[-1] * 16 > total:
        return min(2 * b, MOST_CLOSEST, k)
    deeper = total - np.cumsum(depths)
    return min(max(2, int(np.argmax(deeper * 64 <= total + depths[-1] * 64))), b, k)


# --- the whole ------------------------------------------------------------------------------------------------------


def integers(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """(vec_id, label, x) of vectors that can be coded; ``x`` is the floor of each component times ``scale``."""
    whole = F.col("embedding").cast("array<double>")
    fine = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), whole.alias("e"))
        .filter(F.col("e").isNotNull() & (F.size("e") > 0) & (F.size("e") % parts == 0) & fine)
        .select("vec_id", "label", F.transform("e", lambda c: F.floor(c * float(scale))).alias("x"))
    )


@dataclass
class Fitted:
    """Codebooks, the table of the last pass with its list length, and the list lengths of all rounds."""

    books: Books
    state: DataFrame
    size: int
    sizes: list[int]


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, closest: int = CLOSEST) -> Fitted | None:
    """Rounds of assigning and averaging; None when no vector can be coded."""
    if not 1 <= entries <= 256:
        raise ValueError("an index is one byte: 1 to 256 entries")
    whole = C.cut(integers(vectors, scale, parts))
    order = [F.col("vec_id").asc_nulls_last(), "x"]
    first = whole.orderBy(*order).select(F.size("x").alias("d")).first()
    if first is None:
        return None
    width = first["d"] // parts
    same = whole.filter(F.size("x") == first["d"])
    top = same.agg(F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))))).first()[0]
    if width * (2 * (top + 1)) ** 2 * 256 >= 1 << 63:
        raise ValueError(f"components up to {top} after scaling are beyond the exact integer range")
    seeds = np.array([r["x"] for r in same.orderBy(*order).select("x").limit(entries).collect()], np.int64)
    book = np.ascontiguousarray(seeds.reshape(len(seeds), parts, width).transpose(1, 0, 2))
    books = Books(book, np.zeros(book.shape[:2]), width * (2 * (top + 1)) ** 2 < 1 << 53)
    state = same.select("vec_id", "label", F.col("x").cast("array<int>").alias("x"), F.lit(None).cast("binary").alias("kept"))
    k = book.shape[1]
    size, b, sizes = None, min(closest, MOST_CLOSEST, k), []
    totals = np.zeros((*book.shape[:2], width + 1), np.int64)
    for _ in range(rounds):
        rows = C.cut(assign(state, books, size, b))
        change, depths = gathered(rows, book.shape)
        totals += change
        count = totals[:, :, width:]
        moved = np.where(count > 0, totals[:, :, :width] // np.maximum(count, 1), books.entries)
        drift = np.sqrt(np.square(moved - books.entries).sum(axis=2).astype(np.float64))
        books = Books(moved, np.nextafter(drift, np.inf) * (drift > 0), books.exact)
        sizes.append(b)
        state, size, b = rows.filter(F.col("cells").isNull()).select("vec_id", "label", "x", "kept"), b, adapted(b, depths, k)
    return Fitted(books, state, size, sizes)


CODES = "vec_id long, label int, code string, error long"


def encode(made: Fitted) -> DataFrame:
    """(vec_id, label, code, error): a last pass by the stored bounds; the error is the exact squared distance."""
    books, size = made.books, made.size
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int32()), ("code", pa.string()), ("error", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch, books.entries.shape)
            after, _ = _records(x, _kept(batch, x.shape[1], size), books, size)
            chosen = after["near"][:, :, 0]
            nearest = np.stack([book[chosen[:, p]] for p, book in enumerate(books.entries)], axis=1)
            error = np.square(x - nearest).sum(axis=(1, 2))
            yield C.batch(schema, [batch.column("vec_id"), batch.column("label"), [bytes(c).hex() for c in chosen], error])

    return made.state.mapInArrow(run, CODES)


def decode(codes: DataFrame, books: Books, scale: int = SCALE) -> DataFrame:
    """(vec_id, embedding): the entries that a code names, back in the scale of the vectors."""
    parts, _, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = np.frombuffer(bytes.fromhex("".join(batch.column("code").to_pylist())), np.uint8).reshape(-1, parts)
            whole = np.concatenate([books.entries[p][index[:, p]] for p in range(parts)], axis=1) / scale
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(list(whole), pa.list_(pa.float64()))], names=["vec_id", "embedding"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, embedding array<double>")


def report(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector that can be coded."""
    made = fit(vectors)
    if made is None:
        empty = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], empty)
    codes = C.cut(encode(made))
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    joined = codes.join(sums, codes["label"].eqNullSafe(sums["_label"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(made.books.digest()).alias("codebooks_sha256"))
