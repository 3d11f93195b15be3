"""Contexts and citations: what stands once per question already is neither grouped nor exchanged again."""

import random

import pytest
from pyspark.sql import functions as F

from tokengraph.operators import graph as G
from tokengraph.operators import retrieve as R


@pytest.fixture(scope="module")
def small(spark):
    """A graph with a place that only grouping edges lead to, and seeds that share depths, keys and nodes."""
    r = random.Random(5)
    pairs = sorted({(f"n{r.randrange(90)}", f"n{r.randrange(90)}") for _ in range(160)})
    facts = [(a, "P" if i % 3 else "Q", b) for i, (a, b) in enumerate(pairs)] + [(f"n{i}", "LOCATED_IN", "place") for i in range(0, 90, 2)]
    r.shuffle(facts)
    rows = [(s, p, o, "" if n % 4 else f"{s} {p} {o}.", None if n % 7 == 0 else f"d{n % 5}", None if n % 11 == 0 else "ns", "INTERNAL", n) for n, (s, p, o) in enumerate(facts)]
    triples = spark.createDataFrame(rows, "subject string, predicate string, object string, source_sentence string, doc_id string, namespace string, classification string, ord bigint")
    edges, nodes = G.edges_from(triples), G.nodes_from(triples)
    asked = [(f"q{i}", f"n{i}", i % 3) for i in range(90)] + [("q7", "n7", 1), ("p", "place", 2), ("gone", "nobody", 2), (None, "n3", 2), (None, "n4", 1)]
    asked += [("many", f"n{i}", 1) for i in range(0, 90, 5)] + [("two", "n8", 0), ("two", "n9", 2)]
    seeds = spark.createDataFrame(asked, "query_id string, node string, depth int")
    return nodes, edges, seeds, G.walk_graph(edges, nodes, seeds, 2)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_context_is_rendered_where_its_block_is(small):
    nodes, edges, seeds, done = small
    named = G.reached_by(seeds, done, ["query_id"], "depth").join(nodes.select(F.col("id").alias("node"), "namespace"), "node")
    lines = G.context_lines(named, G.induced_by(seeds, done, edges, ["query_id"], "depth"), ["query_id"])
    for per_chunk in (3, 1000):
        want = G.render_context(lines, ["query_id"], per_chunk)
        got = G.rendered_by(seeds, done, nodes, edges, ["query_id"], per_chunk, "depth")
        assert rows(got.select(*want.columns)) == rows(want)


def test_lines_and_citations_are_not_exchanged(small, spark):
    nodes, edges, seeds, done = small
    reached = G.reached_by(seeds, done, ["query_id"], "depth", nodes)
    sub = G.induced_by(seeds, done, edges, ["query_id"], "depth")
    kept = [spark.createDataFrame(df.collect(), df.schema) for df in (reached, sub)]
    plain = R.build_context(*kept, ordered=False)
    assert rows(plain) == rows(R.build_context(*kept).select(*plain.columns))
    cites = R.citations(kept[1], once=True)
    assert rows(cites) == rows(R.citations(kept[1]).select(*cites.columns))
    for df in (plain, cites):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_subgraph_keeps_further_columns_of_edges(small):
    nodes, edges, seeds, done = small
    more = edges.withColumn("cite", F.struct(F.concat("source", "target").alias("a")))
    sub = G.induced_by(seeds, done, more, ["query_id"], "depth", carry=["cite"])
    assert rows(sub.drop("cite")) == rows(G.induced_by(seeds, done, edges, ["query_id"], "depth"))
    assert sub.filter(F.col("cite.a") != F.concat("source", "target")).count() == 0
