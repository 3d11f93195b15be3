"""Steps whose work per task or per row must not grow with the table."""

import random

import pytest
import yaml

from tokengraph.llm import order_minhash as OM
from tokengraph.operators import triples as TR
from tokengraph.plans import derive as D
from tokengraph.session import INPUT_PARTITIONS
from tokengraph.sources import documents as SD


@pytest.fixture
def cluster_like(spark):
    """A session that is not told how many parts its inputs have."""
    n = spark.conf.get(INPUT_PARTITIONS)
    spark.conf.set(INPUT_PARTITIONS, "")
    yield spark
    spark.conf.set(INPUT_PARTITIONS, n)


def test_narrow_tables_are_dealt_by_rows(cluster_like, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "ROWS_PER_TASK", 30)
    rows = cluster_like.range(100).selectExpr("id AS c_custkey", "'n' AS c_name")
    for name in ("customer", "documents"):
        rows.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    dealt = D.table(cluster_like, str(tmp_path), "customer")
    parts = [len(p) for p in dealt.rdd.glom().collect()]
    assert len(parts) == 4 and max(parts) <= 30
    assert sorted(r.c_custkey for r in dealt.collect()) == list(range(100))
    assert D.table(cluster_like, str(tmp_path), "documents").rdd.getNumPartitions() == 1  # texts stay where they are


def test_each_sentence_is_parsed_once(spark):
    df = spark.createDataFrame([("d", 0, "⟦TK_PERSON_AAAA1111⟧ works in Legal."), ("d", 1, "She earns a lot.")], "doc_id string, sent_idx bigint, text string")
    plan = TR.extract_triples(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "ExternalRDD" not in plan and "LogicalRDD" not in plan and "LocalRelation" not in plan  # what the joins read is stored


HEADERS = [
    "a: \"x y\"\nb:\n  - ONE\n  - 'it''s'\nc: 0.9\nd: '2026-07-15'\ne: 2026-07-15",
    "a: 1\n  b: 2", "a:\n- x\n- y", "a: yes\nb: 0x1F\nc: 1_000\nd: 08\ne: null", "a: \"tab\\t\"", "a: [1, 2]", "a: {b: c}", "é: ü", "---\na: 1", "a: b: c", "a: 1\na: 2", "", "a:", "- x",
]


@pytest.mark.parametrize("raw", HEADERS)
def test_headers_load_alike(raw):
    def get(load):
        try:
            return load(raw)
        except yaml.YAMLError:
            return "malformed"

    assert get(SD.load_header) == get(yaml.safe_load)


def test_each_header_is_decoded_once(spark):
    head = "---\nokf_version: \"1.0\"\ndocument:\n  id: \"A\"\n---\nbody"
    good, bad = SD.parse_documents(spark.createDataFrame([("p", head)], "path string, content string"))
    for df in (good, bad):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert bad.count() == 1 and good.count() == 0


def test_texts_that_share_their_head_are_signed_as_by_themselves(monkeypatch):
    r = random.Random(7)
    texts = ["", "a", "abcdefg", "abcdefgh", "a" * 30, "é🙂" * 9] + ["".join(r.choice("abc ") for _ in range(r.randrange(90))) for _ in range(60)]
    taken = []
    least = OM._least
    monkeypatch.setattr(OM, "_least", lambda w, start, hashes, pick: taken.append(len(w) - start) or least(w, start, hashes, pick))
    for chunk in (1 << 16, 8):
        monkeypatch.setattr(OM, "CHUNK", chunk)
        for text, following in zip(texts, texts[1:] + texts[:1]):
            changed = OM.edited(text, following)
            taken.clear()
            both = OM.signatures(text, changed, len(text) - len(text) // 4)
            if len(text) >= 30:
                assert sum(taken) < 0.8 * (len(text) + len(changed))  # the head counts once
            assert [s.tolist() for s in both] == [OM.signature(text).tolist(), OM.signature(changed).tolist()]


def test_fact_index_moves_rows_once(spark):
    from tokengraph.operators import answer as A

    rows = [("q1", "a", "P", "y", 2), ("q1", "a", "P", "x", 1), ("q1", "a", "P", "y", 0), ("q1", "a", "R", "z", 5), ("q2", "a", "P", "x", 7), (None, "a", "P", "x", 8), (None, "a", "P", "x", 3)]
    facts = spark.createDataFrame(rows, "query_id string, source string, predicate string, target string, ord long").repartition(3)
    values = A.subject_values(facts.repartition(3))
    plan = values._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = {(r.query_id, r.subject, r.predicate): (r.first_value, r.vals, r.first_ord) for r in A.indexed(values).collect()}
    assert got == {("q1", "a", "P"): ("y", "y, x", 0), ("q1", "a", "R"): ("z", "z", 5), ("q2", "a", "P"): ("x", "x", 7), (None, "a", "P"): ("x", "x", 3)}
