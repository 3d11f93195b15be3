"""Order MinHash fingerprints: similarity that follows edit distance.

Each text becomes its occurrence-numbered k-mers: code point k-grams, each with the count of equal ones before it. For
every hash function the ``pick`` smallest of them are selected, put back into text order, and the ordered tuple is hashed
to one word of the signature. Two texts agree in a word when they select the same k-mers in the same order, so moving a
passage costs as much as changing it.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tokengraph.llm import common as C

K, HASHES, PICK = 7, 64, 2
CHUNK = 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def kmers(text: str, k: int = K) -> np.ndarray:
    """64-bit words of the occurrence-numbered k-mers, in text order; a text shorter than ``k`` is one k-mer."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if not len(points):
        return np.empty(0, np.uint64)
    k = min(k, len(points))
    n = len(points) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x100000001B3) + points[j : j + n] + np.uint64(1)
    h = _mix(h)
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(n, bool)
    new[1:] = s[1:] != s[:-1]
    at = np.arange(n)
    numbered = np.empty(n, np.uint64)
    numbered[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return _mix(h + numbered * np.uint64(0xD6E8FEB86659FD93))


@functools.cache
def _seeds(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(20_11)
    return (r.randint(0, 1 << 31, hashes, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1))[:, None], r.randint(0, 1 << 32, hashes, dtype=np.int64).astype(np.uint32)[:, None]


def _least(words: np.ndarray, start: int, hashes: int, pick: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hash values, places)`` of the ``pick`` least words from ``start`` on per hash function, the earlier on a tie."""
    a, b = _seeds(hashes)
    best_v, best_p = np.empty((hashes, 0), np.uint32), np.empty((hashes, 0), np.int64)
    rows = np.arange(hashes)
    for i in range(start, len(words), CHUNK):  # a very long text never needs more than one chunk of the matrix
        part = words[i : i + CHUNK]
        low, high = part.astype(np.uint32), (part >> np.uint64(32)).astype(np.uint32)
        v = low[None] * a
        v += b
        v ^= high[None]
        v *= np.uint32(0x9E3779B1)
        found_v, found_p = [], []
        for _ in range(min(pick, v.shape[1])):
            p = v.argmin(axis=1)
            found_v.append(v[rows, p][:, None])
            found_p.append((p + i)[:, None])
            v[rows, p] = np.uint32(0xFFFFFFFF)
        best_v, best_p = _merged((best_v, best_p), (np.hstack(found_v), np.hstack(found_p)), pick)
    return best_v, best_p


def _merged(one: tuple, two: tuple, pick: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``pick`` least of two results of ``_least``, the second from later places."""
    v, p = np.hstack([one[0], two[0]]), np.hstack([one[1], two[1]])
    if v.shape[1] <= pick:
        return v, p
    keep = np.argsort(v, axis=1, kind="stable")[:, :pick]
    return np.take_along_axis(v, keep, 1), np.take_along_axis(p, keep, 1)


def _signed(words: np.ndarray, best_p: np.ndarray, hashes: int) -> np.ndarray:
    best_p = np.sort(best_p, axis=1)
    out = np.ones(hashes, np.uint64)
    for j in range(best_p.shape[1]):
        out = _mix(out * np.uint64(0x9FB21C651E98DF25) + words[best_p[:, j]])
    return (out >> np.uint64(32)).astype(np.uint32)


def signature(text: str, k: int = K, hashes: int = HASHES, pick: int = PICK) -> np.ndarray:
    """``hashes`` 32-bit words. An empty text has the all-zero signature."""
    words = kmers(text, k)
    if not len(words):
        return np.zeros(hashes, np.uint32)
    return _signed(words, _least(words, 0, hashes, pick)[1], hashes)


def signatures(text: str, changed: str, same: int, k: int = K, hashes: int = HASHES, pick: int = PICK) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of two texts whose first ``same`` code points are equal; the k-mers inside those are hashed once.

    A k-mer there is numbered by what stands before it, so both texts have it with the same word.
    """
    shared = same - k + 1
    if shared < max(pick, 1):
        return signature(text, k, hashes, pick), signature(changed, k, hashes, pick)
    a, b = kmers(text, k), kmers(changed, k)
    head = _least(a[:shared], 0, hashes, pick)
    return tuple(_signed(w, _merged(head, _least(w, shared, hashes, pick), pick)[1], hashes) for w in (a, b))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def text_of(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many first code points of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


DEALT = pa.schema([("part", pa.int32()), ("tail", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string())])
MADE = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def sql_type(schema: pa.Schema) -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.float64(): "double", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def fingerprints(docs: DataFrame, k: int = K, hashes: int = HASHES, pick: int = PICK) -> DataFrame:
    """``doc_id, fingerprint``: one row per input row. Null texts are empty; other columns are not carried."""

    def run(batches):
        for b in batches:
            t = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([text_of(signature(x, k, hashes, pick)) for x in t], pa.string())], names=["doc_id", "fingerprint"])

    return C.texts(docs).mapInArrow(run, "doc_id bigint, fingerprint string")


def compare_neighbours(docs: DataFrame, rows_per_range: int = 4000, k: int = K, hashes: int = HASHES, pick: int = PICK) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document.

    Documents go to ranges of ids, one shuffle of the texts. The first document of a range is sent to the range before
    as well, so each range is a stream that holds two texts. Rows with one id are ordered by text; a null id comes first.
    An empty table gives no rows; a single row is followed by itself.
    """
    src = C.texts(docs)
    bounds = np.array(C.range_bounds(src, rows_per_range), dtype=np.int64)

    def deal(batches):
        for b in batches:
            part = C.range_of(bounds, b.column("doc_id"))
            ids = np.asarray(b.column("doc_id").fill_null(C.FIRST).to_numpy(zero_copy_only=False), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(part), np.int32)), b.column("doc_id"), b.column("text")], schema=DEALT)
            heads = np.flatnonzero(bounds[part] == ids)
            if len(heads):
                before = ((part[heads].astype(np.int64) - 1) % len(bounds)).astype(np.int32)
                t = b.take(pa.array(heads))
                yield pa.RecordBatch.from_arrays([pa.array(before), pa.array(np.ones(len(heads), np.int32)), t.column("doc_id"), t.column("text")], schema=DEALT)

    def run(batches):
        out: list[list] = [[] for _ in MADE]

        def sign(row, following):
            """The row's id, text length, edited digest and both signatures; likeness to the next text waits for its signature."""
            i, text = row
            changed = edited(text, following)
            sig, sig_changed = signatures(text, changed, len(text) - len(text) // 4, k, hashes, pick)
            return i, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), sig, sig_changed

        def emit(row, following_sig):
            i, n, digest, sig, sig_changed = row
            made = (i, n, digest, text_of(sig), text_of(sig_changed), likeness(sig, sig_changed), likeness(sig, following_sig))
            for column, value in zip(out, made):
                column.append(value)

        for part, rows in C.in_groups(C.rows_of(batches), lambda r: r["part"]):
            held, first, signed = None, None, None  # the last row read, the first one, the row before the last one
            for r in rows:
                text = r["text"] or ""
                if held is not None:
                    made = sign(held, text)
                    if signed is not None:
                        emit(signed, made[3])
                    signed, held = made, None
                if r["tail"]:
                    if signed is not None:
                        emit(signed, signature(text, k, hashes, pick))
                        signed = None
                    break
                held = (r["doc_id"], text)
                first = first or held
            for _ in rows:
                pass
            if held is not None:
                made = sign(held, first[1])
                if signed is not None:
                    emit(signed, made[3])
                emit(made, signature(first[1], k, hashes, pick))
            if len(out[0]) >= 512:
                yield C.batch(MADE, out)
                out = [[] for _ in MADE]
        if out[0]:
            yield C.batch(MADE, out)

    dealt = src.mapInArrow(deal, sql_type(DEALT)).repartition("part").sortWithinPartitions("part", "tail", "doc_id", "text")
    return dealt.mapInArrow(run, sql_type(MADE))
