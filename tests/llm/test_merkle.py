"""The Merkle manifest against a plain tree, against its SQL, and on odd rows."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tokengraph.llm import merkle_veb as M
from tokengraph.llm import queries


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree: list[list[str]], i: int) -> list[tuple[str, str | None]]:
    out = []
    for nodes in tree[:-1]:
        j = i ^ 1
        out.append((("left" if j < i else "right"), nodes[j]) if j < len(nodes) else ("none", None))
        i //= 2
    return out


def plain(rows) -> Counter:
    runs = defaultdict(list)
    for r in rows:
        hashed = lambda n: H(*map(field, (r.doc_id, r.source, r.lang, n, r.text)))
        picked = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        start = hashed(r.n_chars if r.n_chars is None or not picked else r.n_chars + 1)
        runs[r.lang].append((r.doc_id, hashed(r.n_chars), start))
    trees = {}
    for lang, found in runs.items():
        found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = levels([x[1] for x in found])
    langs = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    top = levels([trees[k][-1][0] for k in langs])
    out = Counter()
    for k, lang in enumerate(langs):
        for i, (doc_id, leaf, x) in enumerate(runs[lang]):
            steps = path(trees[lang], i) + path(top, k)
            for side, other in steps:
                x = H(x) if side == "none" else H(other, x) if side == "left" else H(x, other)
            out[(doc_id, leaf, trees[lang][-1][0], top[-1][0], H(*[o for _, o in steps if o]), x, x == top[-1][0])] += 1
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("height", range(0, 12))
def test_addresses_fill_the_array_and_keep_subtrees_together(height):
    every = [M.address(height, d, np.arange(1 << d)) for d in range(height + 1)]
    assert sorted(np.concatenate(every)) == list(range((2 << height) - 1))
    upper = (height + 1) // 2
    if height:
        top = np.concatenate(every[:upper])
        assert sorted(top) == list(range((1 << upper) - 1))
        size = (1 << (height + 1 - upper)) - 1
        for root in range(1 << upper):  # each lower subtree is one stretch, in order
            inside = np.concatenate([every[upper + d][(root << d) : (root + 1) << d] for d in range(height + 1 - upper)])
            first = (1 << upper) - 1 + root * size
            assert sorted(inside) == list(range(first, first + size))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13])
def test_subtree_and_siblings(n):
    leaves = [H(str(i)) for i in range(n)]
    height = M.levels_of(n)
    nodes = M.build_block(np.frombuffer(bytes.fromhex("".join(leaves)), np.uint8).reshape(-1, M.DIGEST), height)
    tree = levels(leaves)
    assert nodes[0].tobytes().hex() == tree[-1][0]
    paths = M.pack_path(*M.siblings(nodes, height, n, np.arange(n)))
    for i in range(n):
        steps = M.path_steps(paths[i])
        assert [d.decode() for s, d in steps if s != M.ALONE] == [o for _, o in path(tree, i) if o]
        assert M.fold(leaves[i].encode(), steps).decode() == tree[-1][0]


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(queries.ORACLES["op12_merkle_veb"]).fetchall()
    got = queries.QUERIES["op12_merkle_veb"](spark, sf)
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == sorted(want)


def test_many_blocks_and_tiers(spark):
    """Small subtrees, so that runs need three tiers; one language holds most rows, many hold one, one row is repeated."""
    rows = [(i, f"text {i}", "hot" if i % 10 else f"l{i // 10}", "s", 5) for i in range(150)] + [(3, "text 3", "hot", "s", 5)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    got = Counter(tuple(r) for r in M.prove_all(docs, step=2).select(COLUMNS).collect())
    assert got == plain(docs.collect())
    assert {v[-1] for v in got} == {True, False}


def test_odd_rows(spark, odd_docs, no_docs):
    assert Counter(tuple(r) for r in M.prove_all(odd_docs).select(COLUMNS).collect()) == plain(odd_docs.collect())
    assert M.prove_all(no_docs).collect() == []
    assert M.manifest(no_docs).root is None
    largest = spark.createDataFrame([(7, "a", None, "s", (1 << 63) - 1), (8, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(tuple(r) for r in M.prove_all(largest).select(COLUMNS).collect()) == plain(largest.collect())
    one = largest.limit(1)
    assert M.prove_all(one).first()["proof_sha256"] == H("")
