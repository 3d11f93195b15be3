"""The registered queries of this package, each over its whole table with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tokengraph.llm import common as C
from tokengraph.llm import oracle_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op3_order_minhash")
def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokengraph.llm.order_minhash import compare_neighbours

    return compare_neighbours(C.table(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    """The tokenizer's JSON as text; the driver reads it once and the tasks get it with their code."""
    from pathlib import Path

    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text()


@query("op7_word_table_bpe")
def op7_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokengraph.llm.word_table_bpe import round_trip

    return round_trip(C.table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query("op5_repair_store")
def op5_repair_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokengraph.llm import repair_store as R

    path = R.new_path(spark)
    R.write(C.table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"))
    return R.digests(spark, path)


@query("op4_neighbour_quality")
def op4_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokengraph.llm import neighbour_quality as N

    return N.decide(N.score(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")))


@query("op2_host_paths")
def op2_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokengraph.llm.host_paths import extract

    return extract(C.table(spark, sf_dir, "pages"))


@query("op8_secret_cnn")
def op8_secret_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokengraph.llm.secret_cnn import scan

    return scan(C.table(spark, sf_dir, "documents"))


@query("op9_line_chunks")
def op9_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokengraph.llm.line_chunks import report

    return report(C.table(spark, sf_dir, "documents"))


@query("op6_templates")
def op6_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokengraph.llm.templates import leaking

    return leaking(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


@query("op10_trie_join")
def op10_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokengraph.llm.trie_join import join

    return join(C.table(spark, sf_dir, "documents"))


@query("op1_phrase_automata")
def op1_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tokengraph.llm.phrase_automata import deduplicate

    made = deduplicate(C.table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_merkle_veb", oracle_sql.MERKLE)
def op12_merkle_veb(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokengraph.llm.merkle_veb import prove_all

    return prove_all(C.table(spark, sf_dir, "documents"))


@query("op13_vector_codes", oracle_sql.VECTOR_CODES)
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokengraph.llm.vector_codes import report

    return report(C.table(spark, sf_dir, "embeddings"))


@query("op11_license_rules")
def op11_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokengraph.llm.license_scan import scan

    return scan(C.table(spark, sf_dir, "documents")).drop("found")
