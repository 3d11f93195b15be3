"""Queries that reach branches no other query takes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokengraph.functions.hashing import entity_token
from tokengraph.operators import answer as A
from tokengraph.operators import registry as REG
from tokengraph.operators import triples
from tokengraph.plans import derive as D
from tokengraph.plans import sql as S
from tokengraph.plans.graph_queries import _REGISTRY, _registry
from tokengraph.plans.registry import query
from tokengraph.sources import delimited
from tokengraph.sources import documents as SD

_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents"


@query(
    "sentence_hints",
    f"SELECT doc_id, i::BIGINT AS sent_idx, md5(line) AS text_hash, CASE WHEN i < 2 THEN length(line) END::BIGINT AS hint_end FROM ({_LINES}) WHERE doc_id IS NOT NULL",
)
def sentence_hints(spark, sf):
    """Lines of all documents as sentences; the first two carry a known span, those past the list of spans none."""
    lines = F.split("text", "\n")
    span = F.transform(F.slice(lines, 1, 2), lambda x: F.array(F.struct(F.lit(0).alias("start"), F.length(x).alias("end"), F.lit("LINE").alias("entity_type"))))
    docs = D.table(spark, sf, "documents").select("doc_id", lines.alias("sentences"), span.alias("sentence_hints"))
    rows = SD.sentences_with_hints(docs)
    return rows.select("doc_id", F.col("sent_idx").cast("bigint").alias("sent_idx"), F.md5("text").alias("text_hash"), F.get("hints", F.lit(0))["end"].cast("bigint").alias("hint_end"))


@query("empty_tables", f"SELECT 'd' || doc_id AS path, 'no data rows' AS reason FROM ({_LINES}) GROUP BY doc_id HAVING count(*) FILTER (WHERE trim(line) <> '') < 2")
def empty_tables(spark, sf):
    """Every document taken as a table: those with a header line at most are refused."""
    docs = D.table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "text")
    return delimited.empty_tables(docs.select("path"), docs.select("path", F.explode(F.split("text", "\n")).alias("value")))


@query("registry_document", S.sql(["sents_ents", "facts"], "SELECT doc_id, title, department, entity_count, triple_count FROM reg WHERE doc_id = 'NAT-7'", _REGISTRY))
def registry_document(spark, sf):
    return REG.get_document(_registry(spark, sf), "NAT-7").select("doc_id", "title", "department", "entity_count", "triple_count")


@query(
    "pronoun_triples",
    S.sql(
        ["staff"],
        f"""SELECT 'P' || k AS doc_id, 0::BIGINT AS sent_idx, {S.token(S.q('PERSON'), 'name')} AS subject, 'IN_DEPARTMENT' AS predicate, 'Legal' AS object FROM staff
        UNION ALL SELECT 'P' || k, 1, {S.token(S.q('PERSON'), 'name')}, 'RELATED_TO', {S.token(S.q('US_SSN'), 'ssn')} FROM staff""",
    ),
)
def pronoun_triples(spark, sf):
    """A sentence of a pronoun and one token relates the carried subject to it."""
    person, number = entity_token(F.lit("PERSON"), F.col("name"), D.KEY), entity_token(F.lit("US_SSN"), F.col("ssn"), D.KEY)
    texts = F.array(F.concat(person, F.lit(" works in Legal.")), F.concat(F.lit("They, "), number, F.lit("!")))
    rows = D.staff(spark, sf).select(F.concat(F.lit("P"), F.col("k").cast("string")).alias("doc_id"), F.posexplode(texts).alias("i", "text"))
    found = triples.extract_triples(rows.select("doc_id", F.col("i").cast("bigint").alias("sent_idx"), "text"))
    return found.select("doc_id", "sent_idx", "subject", "predicate", "object")


@query("generic_property", S.sql(["staff"], "SELECT 'g' || k AS query_id, 'lookup' AS route, name || '''s has_shoe_size is ' || (k % 10) || '.' AS answer FROM staff"))
def generic_property(spark, sf):
    """A question for a property without a rule of its own is answered by the predicate it names."""
    people = D.staff(spark, sf)
    key = F.concat(F.lit("g"), F.col("k").cast("string")).alias("query_id")
    facts = people.select(key, F.col("name").alias("source"), F.lit("HAS_SHOE_SIZE").alias("predicate"), (F.col("k") % 10).cast("string").alias("target"), F.col("k").alias("ord"))
    text = F.concat(F.lit("What is the shoe size of "), "name", F.lit("?"))
    prepared = people.select(key, text.alias("query_text"), text.alias("tokenized"))
    return A.answer_queries(prepared, facts).select("query_id", "route", "answer")
