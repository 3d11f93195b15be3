"""Vector codes against SQL, against plain integer k-means, and the bounds against full scans."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tokengraph.llm import queries
from tokengraph.llm import vector_codes as V

COLUMNS = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def plain(rows, parts=4, entries=256, rounds=4, scale=1024) -> Counter:
    kept = [(i, [math.floor(scale * float(c)) for c in v], label) for i, v, label in rows if v and len(v) % parts == 0 and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return Counter()
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, p: min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        moved = []
        for p in range(parts):
            member = defaultdict(list)
            for _, v, _ in kept:
                member[nearest(v, p)].append(cut(v, p))
            moved.append([[sum(c) // len(member[e]) for c in zip(*member[e])] if member[e] else old for e, old in enumerate(books[p])])
        books = moved
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    coded = []
    for i, v, label in kept:
        code = [nearest(v, p) for p in range(parts)]
        coded.append((i, bytes(code).hex(), sum(far(cut(v, p), books[p][e]) for p, e in enumerate(code)), label))
    sums = Counter()
    for _, _, error, label in coded:
        sums[label] += error
    return Counter((i, code, error, sums[label], digest) for i, code, error, label in coded)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_query_matches_sql(spark, sf):
    for d in (sf, "/root/testdata/sf0.01"):
        con = duckdb.connect()
        con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
        want = con.execute(queries.ORACLES["op13_vector_codes"]).fetchall()
        assert sorted(map(tuple, queries.QUERIES["op13_vector_codes"](spark, d).select(COLUMNS).collect())) == sorted(want)


def test_more_vectors_than_entries_with_ties(spark):
    """Small whole components make many equal distances; one vector holds a third of the rows, one label too."""
    r = np.random.RandomState(3)
    rows = [(int(i), [float(x) / 1024 for x in r.randint(-3, 4, 8)], int(i) % 3 if i % 2 else None) for i in r.permutation(500)]
    rows += [(1000 + i, [0.25] * 8, 1) for i in range(250)]
    got = V.report(frame(spark, rows).repartition(6)).select(COLUMNS).collect()
    assert Counter(map(tuple, got)) == plain(rows)


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("b, later", [(4, 4), (2, 6), (6, 2), (1, 1), (30, 40)])
def test_bounds_find_what_a_full_scan_finds(exact, b, later):
    r = np.random.RandomState(b)
    x = r.randint(-40, 40, (700, 6)).astype(np.int64)
    book = x[:40].copy()
    kept = V.scan(x, book, min(b, 40), exact)
    for step in range(5):
        moved = book + r.randint(-8 + step, 9 - step, book.shape)
        moved[::7] = book[::7]
        if step == 3:
            moved[5] = moved[20]  # equal entries: the lower index counts
        drift = np.nextafter(np.sqrt(np.square(moved - book).sum(axis=1).astype(float)), np.inf)
        book, size = moved, min(later if step % 2 else b, 40)
        kept, depth = V.follow(x, kept, book, drift, size, exact)
        d = np.square(x[:, None, :] - book[None]).sum(axis=2)
        assert (kept["near"][:, 0] == (d * 40 + np.arange(40)).argmin(axis=1)).all()
        root = np.sqrt(d)
        every = np.arange(len(x))
        assert (kept["upper"] >= root[every, kept["near"][:, 0]]).all()
        for row in range(0, len(x), 23):
            outside = np.setdiff1d(np.arange(40), kept["near"][row])
            assert not len(outside) or min(kept["outer"][row], kept["low"][row].min()) <= root[row, outside].min()
        assert depth.min() >= 1


def test_wide_integers_stay_exact(spark):
    r = np.random.RandomState(9)
    rows = [(i, [float(np.float32(x)) for x in r.uniform(-9000, 9000, 8)], 0) for i in range(300)]
    made = V.fit(frame(spark, rows), entries=16, rounds=2)
    assert Counter((c["vec_id"], c["code"], c["error"]) for c in V.encode(made).collect()) == Counter({k[:3]: n for k, n in plain(rows, entries=16, rounds=2).items()})
    with pytest.raises(ValueError):
        V.fit(frame(spark, [(1, [1e30] * 4, 0)]))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, -0.25, 1.0, 2.0], 1), (2, None, 1), (3, [], 1), (4, [0.5, None, 1.0, 2.0], 1), (5, [nan] * 4, 1), (6, [0.0, inf, 0.0, 0.0], 2),
        (7, [1.0] * 8, 2), (8, [1.0] * 5, 2), (None, [0.25, 0.25, -1.0, 3.0], None), (1, [0.5, -0.25, 1.0, 2.0], 1), (1, [0.5, -0.25, 1.0, 1.5], None),
    ]
    docs = frame(spark, rows).selectExpr("*", "'x' AS code", "1 AS error", "'y' AS _label", "2 AS x")
    assert Counter(map(tuple, V.report(docs).select(COLUMNS).collect())) == plain(rows)
    assert V.report(docs.limit(0)).collect() == []
    assert V.report(docs.filter("vec_id = 2")).columns == COLUMNS


def test_codes_give_back_near_vectors(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    made = V.fit(vectors)
    back = {r["vec_id"]: np.array(r["embedding"]) for r in V.decode(V.encode(made), made.books).collect()}
    for r in vectors.collect():
        error = np.square(np.floor(1024 * np.array(r["embedding"], float)) - 1024 * back[r["vec_id"]]).sum()
        assert error < np.square(1024 * np.array(r["embedding"])).sum()


def test_list_length_follows_the_depth():
    depths = np.zeros(V.MOST_CLOSEST + 2, np.int64)
    assert V.adapted(16, depths, 256) == 16
    depths[1], depths[5] = 1000, 30
    assert V.adapted(16, depths, 256) == 5
    depths[-1] = 200
    assert V.adapted(16, depths, 256) == 32 and V.adapted(64, depths, 256) == 64
