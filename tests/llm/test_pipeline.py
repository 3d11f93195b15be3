"""The pipeline against its stages in plain Python, and the shape of every stage."""

import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from test_operators import lines_left, linked  # noqa: E402
from tokengraph.llm import neighbour_quality, templates  # noqa: E402


def test_stages_keep_the_columns_and_odd_rows(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, docs, sf)
            assert made.columns == docs.columns, name
            assert made.count() <= docs.count(), name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert last.count() == docs.count() and last.columns == ["doc_id", "ids", "n_tokens"]


def test_run_matches_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    score = neighbour_quality.score(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id for r in score.collect() if r.score >= neighbour_quality.THRESHOLD}
    left = {i: t for i, (t, _, _) in lines_left({r.doc_id: r.text for r in docs.collect() if r.doc_id in good}).items()}
    left = {i: left[i] for i, (_, c) in linked(left, 5, 80).items() if i == c}
    index, code = templates.Index([(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]), templates.Coder()
    left = {i: t for i, t in left.items() if not index.matches(*code(t))}
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = {i: t.encode(x, add_special_tokens=False).ids for i, x in left.items()}
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()} == want
    assert 0 < len(want) < docs.count()
