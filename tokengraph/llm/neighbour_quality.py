"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled texts is turned into term weights and a truncated singular value decomposition gives each a
short vector. Vectors and the projection are broadcast; every text is projected, its cosine to all labelled vectors is
computed in blocks, and the labels of the nearest vote with their similarity as weight.

Terms are hashed code point trigrams and a few bins of surface statistics (share of words that echo the one before, of distinct words, of capitals, of marks,
of repeated lines, word length). Labels, language, source and id are never terms.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokengraph.llm import common as C

TERMS, RANK, PER_CLASS, NEIGHBOURS, SHARPNESS = 1 << 13, 48, 1500, 15, 8
"""``PER_CLASS`` bounds the labelled sample: as many rows of each label at most, chosen by a hash of the id."""
BINS, BIN_WEIGHT = 12, 6.0
CHUNK = 1 << 20
WORD = re.compile(r"[^\t-\r ]+")


def _shares(text: str) -> list[float]:
    words = WORD.findall(text)
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x]
    letters = sum(map(str.isalpha, words))
    capitals = sum(w.isupper() and len(w) > 1 for w in words)
    echoes = sum(map(str.__eq__, words, words[1:]))
    return [echoes / n, len(set(words)) / n, capitals / n, letters / n, len(set(lines)) / max(1, len(lines)), min(1.0, len(words) and chars / n / 16), words.count("|") / n, min(1.0, np.log1p(len(words)) / 12)]


def terms(text: str, size: int = TERMS) -> np.ndarray:
    """Term weights before the document frequencies: ``log(1 + count)`` of trigrams, a fixed weight for a hit bin."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    counts = np.zeros(size)
    for i in range(0, max(0, len(points) - 2), CHUNK):  # whole texts, a bounded stretch at a time
        p = points[i : i + CHUNK + 2]
        h = (p[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (p[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (p[2:] * np.uint64(0x165667B19E3779F9))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        counts += np.bincount((h >> np.uint64(40)).astype(np.int64) % size, minlength=size)
    shares = _shares(text)
    bins = np.zeros(len(shares) * BINS)
    for j, s in enumerate(shares):
        bins[j * BINS + min(BINS - 1, int(s * BINS))] = BIN_WEIGHT
    return np.concatenate([np.log1p(counts), bins]).astype(np.float32)


def fit(weights: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """Projection (terms by ``rank``, document frequencies included) and the unit vectors of the rows."""
    idf = np.log((1 + len(weights)) / (1 + (weights > 0).sum(axis=0))).astype(np.float32) + 1
    x = weights * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    rank = max(1, min(rank, *x.shape))
    q = np.random.RandomState(7).standard_normal((x.shape[1], rank + 10)).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    projection = (q @ v[:rank].T).astype(np.float32) * idf[:, None]
    return projection, unit(weights @ projection)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def vote(vectors: np.ndarray, labelled: np.ndarray, labels: np.ndarray, neighbours: int = NEIGHBOURS, block: int = 1024) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest; all that tie with the last neighbour count."""
    if not len(labels):
        return np.full(len(vectors), 0.5)
    sims = np.hstack([vectors @ labelled[i : i + block].T for i in range(0, len(labelled), block)]).round(5)
    k = min(neighbours, len(labels))
    last = np.partition(sims, len(labels) - k, axis=1)[:, len(labels) - k : len(labels) - k + 1]
    w = np.where(sims >= last, np.maximum(sims, 1e-6).astype(np.float64) ** SHARPNESS, 0)
    return (w @ labels / w.sum(axis=1)).round(6)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS) -> tuple[np.ndarray, np.ndarray]:
    """Term weights and labels of the sample. Held-out rows, rows without an id or with a label other than 0 or 1 never enter."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(~held_out(F.col("doc_id"))).distinct()
    chosen = None
    for y in (0, 1):
        some = rows.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.union(some)

    def run(batches):
        for b in batches:
            for t, y, d in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), b.column("doc_id").to_pylist()):
                w = terms(t)
                at = np.flatnonzero(w)
                yield pa.RecordBatch.from_pylist([{"doc_id": d, "label": y, "at": C.pack(at.astype(np.uint16)), "w": C.pack(w[at])}])

    found = C.texts(docs).join(F.broadcast(C.cut(chosen)), "doc_id").mapInArrow(run, "doc_id bigint, label bigint, at binary, w binary")
    got = sorted(found.collect(), key=lambda r: (r.doc_id, r.label, r.w))
    x = np.zeros((len(got), len(terms(""))), np.float32)
    for i, r in enumerate(got):
        x[i, C.unpack(r["at"], np.uint16)] = C.unpack(r["w"], np.float32)
    return x, np.array([r.label for r in got], np.float64)


def scorer(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS, rank: int = RANK, neighbours: int = NEIGHBOURS):
    """A function from a text column to its score, fitted on the labelled sample of ``docs``; its model is broadcast."""
    x, y = labelled_sample(docs, labels, label_col, per_class)
    projection, vectors = fit(x, rank) if len(y) else (np.zeros((x.shape[1], 1), np.float32), np.zeros((0, 1), np.float32))
    model = docs.sparkSession.sparkContext.broadcast((projection, vectors, y))  # bounded by the sample and the number of terms

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        projection, vectors, y = model.value
        out = [np.empty(0)]
        for i in range(0, len(text), 256):
            w = np.array([terms(t) for t in text.iloc[i : i + 256]])
            out.append(vote(unit(w @ projection), vectors, y, neighbours))
        return pd.Series(np.concatenate(out))

    return lambda text: scored(F.coalesce(text.cast("string"), F.lit("")))


def score(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """``doc_id, score``: one row per input row, 0 to 1, higher where label 1 is likelier.

    A null or empty text is scored by its surface bins like any other. Without any labelled row every score is 0.5. Rows
    with equal texts get equal scores. Columns of ``docs`` other than id and text are not carried.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), scorer(docs, labels, **settings)(docs["text"]).alias("score"))


THRESHOLD = 0.3


def decide(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns as they are."""
    return docs.where(scorer(docs, labels, **settings)(docs["text"]) >= threshold)
