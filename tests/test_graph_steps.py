"""Steps that all queries over subgraphs share: edges are numbered where they are stored, few words do not move all nodes."""

from tokengraph.operators import graph as G
from tokengraph.operators import retrieve as R
from tokengraph.session import cut


def rows(df):
    return sorted(map(repr, df.collect()))


def test_numbered_edges_do_not_meet_again(spark):
    facts = [(f"n{i}", "P", f"n{i // 2}", "", "d", "ns", "INTERNAL", i) for i in range(20)]
    triples = spark.createDataFrame(facts, "subject string, predicate string, object string, source_sentence string, doc_id string, namespace string, classification string, ord bigint")
    edges, nodes = G.edges_from(triples), G.nodes_from(triples)
    seeds = spark.createDataFrame([("q1", "n9", 2), ("q2", "n3", 1)], "query_id string, node string, depth int")
    done = G.walk_graph(edges, nodes, seeds, 2)
    stored = cut(G.number_edges(edges))
    numbered, _ = G.met_edges(done, stored)
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert rows(G.induced_by(seeds, done, stored, ["query_id"], "depth")) == rows(G.induced_by(seeds, done, edges, ["query_id"], "depth")) != []
    assert "Aggregate" not in plan and numbered.inputFiles() and set(numbered.inputFiles()) == set(stored.inputFiles())


def test_few_words_meet_nodes_where_they_are(spark):
    nodes = cut(spark.createDataFrame([("Alpha Beta",), ("alphabet",), ("gamma",), ("xy",), (None,)], "id string"))
    words = spark.createDataFrame([("q1", "alpha"), ("q1", "beta"), ("q2", "gam"), ("q3", "zzz"), ("q1", "alpha"), (None, "gam")], "query_id string, keyword string")
    got = R.match_nodes(words, nodes)
    assert rows(got) == rows(spark.createDataFrame([("q1", "Alpha Beta"), ("q1", "alphabet"), ("q2", "gamma"), (None, "gamma")], "query_id string, node string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not any("hashpartitioning(gram" in line for line in plan.splitlines())
