"""Facts told from blocks of seeds: the same as from each question's subgraph, without rows per question that are exchanged."""

import random

import pytest
from pyspark.sql import functions as F

from tokengraph.operators import answer as A
from tokengraph.operators import graph as G
from tokengraph.operators import retrieve as R
from tokengraph.operators.facts import block_facts


@pytest.fixture(scope="module")
def small(spark):
    """Subjects with several values and equal places, questions with one seed, several seeds, several depths and no id."""
    r = random.Random(11)
    pairs = sorted({(f"n{r.randrange(80)}", r.choice("PQ"), f"n{r.randrange(80)}") for _ in range(170)})
    facts = pairs + [(f"n{i}", "LOCATED_IN", "place") for i in range(0, 80, 2)] + [(f"n{i}", "REPORTS_TO", f"n{i // 3}") for i in range(80)]
    r.shuffle(facts)
    rows = [(s, p, o, "", f"d{n % 5}", "ns", "INTERNAL", n // 2) for n, (s, p, o) in enumerate(facts)]
    triples = spark.createDataFrame(rows, "subject string, predicate string, object string, source_sentence string, doc_id string, namespace string, classification string, ord bigint")
    edges, nodes = G.edges_from(triples), G.nodes_from(triples)
    asked = [(f"q{i}", f"n{i}", i % 3) for i in range(80)] + [("q7", "n7", 1), ("gone", "nobody", 2), (None, "n3", 2), (None, "n4", 1)]
    asked += [("many", f"n{i}", 1) for i in range(0, 80, 5)] + [("two", "n8", 0), ("two", "n9", 2)]
    seeds = spark.createDataFrame(asked, "query_id string, node string, depth int")
    done = G.walk_graph(edges, nodes, seeds, 2)
    sub = G.induced_by(seeds, done, edges, ["query_id"], "depth")
    return edges, seeds, done, spark.createDataFrame(sub.collect(), sub.schema)


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("store", [True, False])
def test_facts_are_those_of_the_subgraph(small, spark, store):
    edges, seeds, done, sub = small
    held, want = block_facts(seeds, done, edges, "depth", store), A.fact_index(sub)
    order = ["query_id", "subject", "predicate", "first_value", "vals", "all_values", "first_ord"]
    assert held.many.count() > 0
    assert rows(held.rows().select(order)) == rows(want.select(order))
    assert rows(held.rows(only=["REPORTS_TO", "P"]).select(order)) == rows(want.filter("predicate IN ('REPORTS_TO', 'P')").select(order))
    assert rows(held.known()) == rows(want.select("query_id").distinct())
    asked = spark.createDataFrame([("q4", "x"), ("q4", "y"), ("two", "x"), ("many", "z"), ("many", "z"), ("none", "x"), (None, "x")], "query_id string, q string")
    more = [*order, "q"]
    assert rows(held.rows(asked).select(more)) == rows(want.join(asked, "query_id").select(more))
    first = want.groupBy("query_id", "subject").agg(F.min("first_ord").alias("ord")).join(asked, "query_id")
    assert rows(held.firsts(asked).select("query_id", "q", "subject", "ord")) == rows(first.select("query_id", "q", "subject", "ord"))
    pairs = want.select("query_id", "subject").distinct().filter(F.xxhash64("query_id", "subject") % 3 == 0)
    assert rows(held.rows(pairs).select(order)) == rows(want.join(pairs, ["query_id", "subject"]).select(order))


def test_answers_from_blocks_are_those_from_rows(small, spark):
    edges, seeds, done, sub = small
    held, index = block_facts(seeds, done, edges, "depth"), A.fact_index(sub)
    texts = ["Who does n{i} report to, and who does that person report to?", "Tell me about n{i}", "Where is n{i}", "who are they, everyone"]
    qs = [(q, texts[n % 4].format(i=(q or "n0")[1:])) for n, q in enumerate([*[f"q{i}" for i in range(80)], "q5", "many", "two", "gone", None])]
    prepared = spark.createDataFrame(qs, "query_id string, query_text string").withColumn("tokenized", F.col("query_text"))
    q = A.question_columns(prepared)
    targets = A.target_subjects(q, index)
    assert rows(A.target_subjects(q, held)) == rows(targets) != []
    for make in (lambda i: A.lookup_answers(q, targets, i), lambda i: A.reporting_chains(targets, i), lambda i: A.list_items(q, i), A.entity_summaries, lambda i: A.general_answers(A.entity_summaries(i))):
        assert rows(make(held)) == rows(make(index)) != []
    assert rows(A.answer_queries(prepared, held)) == rows(A.answer_queries(prepared, sub)) != []


def test_rows_of_questions_are_not_exchanged(small, spark):
    edges, seeds, done, _ = small
    single = seeds.filter("query_id LIKE 'q%' AND query_id <> 'q7'")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        held = block_facts(single, done, edges, "depth")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = held.subjects()._jdf.queryExecution().executedPlan().toString().split("Union")[-1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # the question's rows come from a join of what is exchanged by block; only rows of questions with several blocks meet again
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not any("subject" in line and "query_id" in line and "_block" in line for line in dealt)
    one = plan.split("ObjectHashAggregate")[0]
    assert one.index("SortMergeJoin") < one.index("Exchange")
