"""Queries over tables, vault, triples."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tokengraph.functions import constants as K
from tokengraph.functions.hashing import entity_digest, entity_token, token_text
from tokengraph.operators import composite, tables, tokens, triples
from tokengraph.operators import detect as DT
from tokengraph.operators import vault as V
from tokengraph.plans import derive as D
from tokengraph.plans import sql as S
from tokengraph.plans.registry import query
from tokengraph.session import cut, shared_dir
from tokengraph.sources import delimited
from tokengraph.sources import documents as SD

# --- headers and unpivot --------------------------------------------------------------------------------------------
_CUSTOMER = {"Name": "c_name", "Salary": "'$' || cast(floor(c_acctbal) as bigint)", "Department": "c_mktsegment", "Nation key!": "c_nationkey", "Pay": "if(c_custkey % 3 = 0, '$1', '')"}
_SUPPLIER = {"Vendor name": "s_name", "Balance (USD)": "cast(floor(s_acctbal) as bigint)", "Location": "'Nation ' || s_nationkey"}
_PART = {"Part": "p_name", "Brand": "p_brand", "Type": "p_type", "Size": "p_size", "???": "'x' || p_partkey"}
_TABLES = [("customer", "c_custkey", _CUSTOMER), ("supplier", "s_suppkey", _SUPPLIER), ("part", "p_partkey", _PART)]
_ORDER = {"customer": 0, "supplier": 1, "part": 2}


def _wide_rows(spark, sf):
    out = None
    for name, key, cols in _TABLES:
        one = tables.as_cells(D.table(spark, sf, name).withColumn("table_name", F.lit(name)).withColumn("row_id", F.col(key)), ["table_name", "row_id"], cols)
        out = one if out is None else out.unionByName(one)
    return out


def _slug_sql(h: str) -> str:
    clean = f"lower(trim({h}))"
    slug = f"upper(regexp_replace(trim(regexp_replace({clean}, '[^\\w\\s]', '', 'g')), '\\s+', '_', 'g'))"
    return f"CASE WHEN {clean} IN ({', '.join(S.q(k) for k in K.HEADER_PREDICATES)}) THEN {S.case_map(clean, K.HEADER_PREDICATES)} WHEN {slug} = '' THEN 'RELATED_TO' ELSE 'HAS_' || {slug} END"


def _cells_sql() -> str:
    parts = []
    for name, key, cols in _TABLES:
        for i, (h, e) in enumerate(cols.items()):
            parts.append(
                f"SELECT {S.q(name)} AS table_name, {key} AS row_id, {i} AS col_idx, {S.q(h)} AS header, coalesce(({e.replace('if(', 'if(')})::VARCHAR, '') AS value FROM {name}"
            )
    return " UNION ALL ".join(parts)


S.CTE["cells"] = ([], _cells_sql())
S.CTE["tfact"] = (
    ["cells"],
    f"""SELECT table_name, row_id, subject, predicate, min(col_idx) AS col_idx, arg_max(value, col_idx) AS value FROM (
      SELECT c.table_name, c.row_id, s.value AS subject, c.col_idx, c.value, {_slug_sql('c.header')} AS predicate FROM cells c
      JOIN cells s ON s.table_name = c.table_name AND s.row_id = c.row_id AND s.col_idx = 0
      WHERE c.col_idx > 0 AND c.value <> '' AND s.value <> '') GROUP BY 1, 2, 3, 4""",
)


@query(
    "header_predicates",
    f"SELECT header, {_slug_sql('header')} AS predicate, count(*) AS n FROM (SELECT [{', '.join(S.q(h) for h in [*K.HEADER_PREDICATES, 'Google Maps Link', '  Full  Name (legal)', '#!', 'Zip-code'])}][p_partkey % {len(K.HEADER_PREDICATES) + 4} + 1] AS header FROM part) GROUP BY 1",
)
def header_predicates(spark, sf):
    """Headers picked by part id from the known words and odd spellings."""
    names = [*K.HEADER_PREDICATES, "Google Maps Link", "  Full  Name (legal)", "#!", "Zip-code"]
    h = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("p_partkey") % len(names) + 1).cast("int"))
    return D.table(spark, sf, "part").select(h.alias("header")).groupBy("header").agg(F.count("*").alias("n")).select(
        "header", composite.header_predicate(F.col("header")).alias("predicate"), "n"
    )


def _facts(spark, sf):
    return tables.unpivot_rows(_wide_rows(spark, sf), ["table_name", "row_id"])


@query("table_unpivot", S.sql(["tfact"], "SELECT table_name, row_id, subject, col_idx::BIGINT AS col_idx, predicate, value FROM tfact"))
def table_unpivot(spark, sf):
    return _facts(spark, sf).withColumn("col_idx", F.col("col_idx").cast("bigint"))


@query(
    "row_sentences",
    S.sql(
        ["tfact"],
        f"""SELECT table_name, row_id, subject, predicate, {S.fact_sentence('subject', 'predicate', 'value')} AS sentence FROM (
        SELECT table_name, row_id, subject, predicate, value FROM tfact
        UNION ALL SELECT table_name, row_id, any_value(subject), 'IN_DEPARTMENT', 'Logistics' FROM tfact WHERE table_name <> 'customer' GROUP BY 1, 2)""",
    ),
)
def row_sentences(spark, sf):
    facts = _facts(spark, sf).withColumn("section", F.lit("Logistics"))
    return tables.row_sentences(facts, ["table_name", "row_id"], "section").select("table_name", "row_id", "subject", "predicate", F.col("text").alias("sentence"))


_SAMPLED = "cells"


@query(
    "column_types",
    S.sql(
        ["cells"],
        f"""SELECT table_name, col_idx::BIGINT AS col_idx, header, CASE
          WHEN {_slug_sql('header')} IN ({', '.join(S.q(k) for k in K.PREDICATE_ENTITY_TYPES)}) THEN {S.case_map(_slug_sql('header'), K.PREDICATE_ENTITY_TYPES)}
          WHEN n = 0 THEN NULL WHEN regexp_matches(h, {S.q(K.ORG_HEADER_PATTERN)}) THEN 'ORGANIZATION'
          WHEN regexp_matches(h, {S.q(K.URL_HEADER_PATTERN)}) OR url >= 0.8 THEN 'PLAIN'
          WHEN regexp_matches(h, {S.q(K.RATING_HEADER_PATTERN)}) OR rating >= 0.8 THEN 'PLAIN'
          WHEN org >= 0.5 THEN 'ORGANIZATION' WHEN regexp_matches(h, {S.q(K.PERSON_HEADER_PATTERN)}) AND person >= 0.5 THEN 'PERSON'
          WHEN regexp_matches(h, {S.q(K.CATEGORY_HEADER_PATTERN)}) THEN 'PLAIN' END AS entity_type
        FROM (SELECT table_name, col_idx, header, lower(trim(header)) AS h, count(*) FILTER (WHERE trim(value) <> '') AS n,
          avg(regexp_matches(trim(value), {S.q(K.URL_VALUE_PATTERN)})::INT) FILTER (WHERE trim(value) <> '') AS url,
          avg(regexp_matches(trim(value), {S.q(K.RATING_VALUE_PATTERN)})::INT) FILTER (WHERE trim(value) <> '') AS rating,
          avg(regexp_matches(trim(value), {S.q(K.ORG_VALUE_PATTERN)})::INT) FILTER (WHERE trim(value) <> '') AS org,
          avg(regexp_matches(trim(value), {S.q(K.PERSON_VALUE_PATTERN)})::INT) FILTER (WHERE trim(value) <> '') AS person
          FROM {_SAMPLED} GROUP BY 1, 2, 3, 4)""",
    ),
)
def column_types(spark, sf):
    """Types from all rows of each table."""
    rows = _wide_rows(spark, sf).withColumnRenamed("row_id", "row_idx")
    return tables.column_types(rows, ["table_name"]).withColumn("col_idx", F.col("col_idx").cast("bigint"))


_SHAPES = {"is_url": K.URL_VALUE_PATTERN, "is_rating": K.RATING_VALUE_PATTERN, "is_org": K.ORG_VALUE_PATTERN, "has_org_word": K.ORG_WORD_PATTERN, "is_person": K.PERSON_VALUE_PATTERN}


@query(
    "value_shapes",
    S.sql(
        ["staff"],
        "SELECT v, " + ", ".join(f"regexp_matches(v, {S.q(p)}) AS {n}" for n, p in _SHAPES.items())
        + " FROM (SELECT CASE k % 6 WHEN 0 THEN 'https://x.example/' || k WHEN 1 THEN rating WHEN 2 THEN name || ' Labs' WHEN 3 THEN 'Digital ' || name WHEN 4 THEN name ELSE department END AS v FROM staff)",
    ),
)
def value_shapes(spark, sf):
    k = F.col("k")
    v = (
        F.when(k % 6 == 0, F.concat(F.lit("https://x.example/"), k.cast("string"))).when(k % 6 == 1, F.col("rating"))
        .when(k % 6 == 2, F.concat("name", F.lit(" Labs"))).when(k % 6 == 3, F.concat(F.lit("Digital "), "name"))
        .when(k % 6 == 4, F.col("name")).otherwise(F.col("department"))
    )
    d = D.staff(spark, sf).select(v.alias("v"))
    return d.select("v", *[c.alias(n) for n, c in tables.value_shapes(F.col("v")).items()])


@query(
    "typed_spans",
    S.sql(
        ["kinded"],
        """SELECT ord, 0::BIGINT AS start_pos, length(subject)::BIGINT AS stop_pos, 'PERSON' AS entity_type FROM kinded
        UNION ALL SELECT ord, s, s + length(object), CASE WHEN kind <> 'PLAIN' THEN kind END FROM (
          SELECT *, (length(source_sentence) - strpos(reverse(source_sentence), reverse(object)) - length(object) + 1)::BIGINT AS s
          FROM (SELECT ord, subject, object, source_sentence, coalesce(kind, CASE WHEN predicate = 'HAS_RATING' THEN 'PLAIN' END) AS kind FROM kinded)) WHERE kind IS NOT NULL AND s >= length(subject)""",
    ),
)
def typed_spans(spark, sf):
    rows = _hinted(spark, sf).select("ord", F.explode("hints").alias("h"))
    return rows.select("ord", F.col("h.start").cast("bigint").alias("start_pos"), F.col("h.end").cast("bigint").alias("stop_pos"), F.col("h.entity_type").alias("entity_type"))


def _hinted(spark, sf):
    facts = D.staff_facts(spark, sf).filter(F.col("about") == "person")
    kind = F.when(F.col("predicate") == "HAS_RATING", K.PLAIN)
    for p, t in D.TYPED_OBJECTS.items():
        kind = F.when(F.col("predicate") == p, t).otherwise(kind)
    return facts.withColumn(
        "hints", tables.typed_spans(F.col("source_sentence"), F.col("subject"), F.col("object"), F.lit("PERSON"), kind)
    )


@query(
    "hint_merge",
    S.sql(
        ["kinded"],
        """SELECT ord, entity_type, s::BIGINT AS start_pos, e::BIGINT AS stop_pos, value, score::DOUBLE AS confidence FROM (
          SELECT id AS ord, entity_type, s, e, value, score FROM ents x WHERE NOT EXISTS (SELECT 1 FROM hints h WHERE h.ord = x.id AND x.s < h.e AND h.s < x.e)
          UNION ALL SELECT ord, entity_type, s, e, substr(source_sentence, s + 1, e - s), 1.0 FROM hints JOIN kinded USING (ord) WHERE entity_type IS NOT NULL)""",
        f"""hints AS MATERIALIZED (SELECT ord, 0::BIGINT AS s, length(subject)::BIGINT AS e, 'PERSON' AS entity_type FROM kinded
          UNION ALL SELECT ord, s, s + length(object), CASE WHEN kind <> 'PLAIN' THEN kind END FROM (
          SELECT *, (length(source_sentence) - strpos(reverse(source_sentence), reverse(object)) - length(object) + 1)::BIGINT AS s
          FROM (SELECT ord, subject, object, source_sentence, coalesce(kind, CASE WHEN predicate = 'HAS_RATING' THEN 'PLAIN' END) AS kind FROM kinded)) WHERE kind IS NOT NULL AND s >= length(subject)),
        hc AS (SELECT * FROM ({S.recognizer_rows('kinded', 'ord', 'source_sentence')}) WHERE {S.person_filter()}), """
        + S.start_first("hc"),
    ),
)
def hint_merge(spark, sf):
    done = DT.detect(_hinted(spark, sf), "source_sentence", hints="hints")
    rows = DT.explode_entities(done, "ord")
    return rows.select("ord", "entity_type", F.col("start").cast("bigint").alias("start_pos"), F.col("end").cast("bigint").alias("stop_pos"), "value", "confidence")


# --- composite cells ------------------------------------------------------------------------------------------------
_CELL_SQL = """SELECT p_partkey AS k, p_name || ' Ltd' AS subject, CASE p_partkey % 5
  WHEN 0 THEN p_name || ' Ltd | 4.' || (p_partkey % 10) || '(12) | Software company · ' || (p_partkey % 90 + 1) || ' Baker Street | Open · Closes 9 pm · 087094 9' || lpad((p_partkey % 10000)::VARCHAR, 4, '0') || ' | Website'
  WHEN 1 THEN 'Role: ' || p_type || '; Department: ' || p_brand || '; Base: $' || (p_partkey + 100) || ',000; email: p' || p_partkey || '@tech.example'
  WHEN 2 THEN 'VAT: GB' || p_partkey || ' | help' || p_partkey || '@parts.example | Mon-Fri 9am-5pm | size ' || p_size || ' widgets'
  WHEN 3 THEN p_name
  ELSE 'see https://p.example/' || p_partkey || '; $' || p_size || ',500/month; 4.5 stars' END AS cell FROM part"""
S.CTE["ccells"] = ([], _CELL_SQL)


def _cells(spark, sf):
    k, sk = F.col("p_partkey"), F.col("p_partkey").cast("string")
    size = F.col("p_size").cast("string")
    cell = (
        F.when(k % 5 == 0, F.concat("p_name", F.lit(" Ltd | 4."), (k % 10).cast("string"), F.lit("(12) | Software company · "), (k % 90 + 1).cast("string"), F.lit(" Baker Street | Open · Closes 9 pm · 087094 9"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit(" | Website")))
        .when(k % 5 == 1, F.concat(F.lit("Role: "), "p_type", F.lit("; Department: "), "p_brand", F.lit("; Base: $"), (k + 100).cast("string"), F.lit(",000; email: p"), sk, F.lit("@tech.example")))
        .when(k % 5 == 2, F.concat(F.lit("VAT: GB"), sk, F.lit(" | help"), sk, F.lit("@parts.example | Mon-Fri 9am-5pm | size "), size, F.lit(" widgets")))
        .when(k % 5 == 3, F.col("p_name"))
        .otherwise(F.concat(F.lit("see https://p.example/"), sk, F.lit("; $"), size, F.lit(",500/month; 4.5 stars")))
    )
    return D.table(spark, sf, "part").select(k.alias("k"), F.concat("p_name", F.lit(" Ltd")).alias("subject"), cell.alias("cell"))


_KINDS = " + ".join(f"regexp_matches(cell, {S.q(p)})::INT" for p in (K.CELL_PHONE, K.CELL_EMAIL, K.CELL_HOURS, K.CELL_CURRENCY, K.CELL_ADDRESS_WORDS))
_IS_COMPOSITE = f"(length(cell) >= 10 AND (len(regexp_extract_all(cell, {S.q(K.CELL_DELIMITER)})) >= 2 OR regexp_matches(cell, {S.q(K.CELL_KEY_VALUE)}) OR {_KINDS} >= 2))"


@query("composite_detect", S.sql(["ccells"], f"SELECT k, {_IS_COMPOSITE} AS composite FROM ccells"))
def composite_detect(spark, sf):
    return _cells(spark, sf).select("k", composite.is_composite(F.col("cell")).alias("composite"))


def _first(pattern: str, text: str) -> str:
    return f"regexp_extract({text}, {S.q(pattern)})"


def _take_sql(cte: str, prev: str, pattern: str, col: str) -> str:
    """One extraction step: the first match and the text without it."""
    m = f"regexp_extract(rest, {S.q(pattern)})"
    return (
        f"{cte} AS (SELECT * EXCLUDE (rest), trim({m}) AS {col}, CASE WHEN {m} = '' THEN rest ELSE "
        f"trim(substr(rest, 1, strpos(rest, {m}) - 1) || ' ' || substr(rest, strpos(rest, {m}) + length({m}))) END AS rest FROM {prev})"
    )


_TRIM = "trim({}, '.!?,|·• ')"
_KV = f"regexp_matches(chunk, {S.q(K.CELL_KEY_VALUE)})"
_COMPOSITE = ", ".join(
    [
        f"chunked AS (SELECT k, subject, ci, trim(c) AS chunk FROM (SELECT k, subject, unnest(cs) AS c, generate_subscripts(cs, 1) AS ci FROM (SELECT k, subject, string_split_regex(cell, {S.q(K.CELL_DELIMITER)}) AS cs FROM ccells)) WHERE trim(c) <> '')",
        f"live AS (SELECT *, {_KV} AS kv FROM chunked WHERE NOT regexp_matches(chunk, {S.q(K.CELL_NOISE)}) AND NOT ((lower(chunk) = lower(subject) OR starts_with(lower(chunk), lower(subject) || ' ')) AND length(chunk) <= length(subject) + 3))",
        f"kvs AS (SELECT k, ci, {_slug_sql(f'regexp_extract(chunk, {S.q(K.CELL_KEY_VALUE)}, 1)')} AS p, trim(regexp_extract(chunk, {S.q(K.CELL_KEY_VALUE)}, 2)) AS v FROM live WHERE kv)",
        "s0 AS (SELECT k, ci, chunk AS rest FROM live WHERE NOT kv)",
        _take_sql("s1", "s0", K.CELL_PHONE, "phone"),
        _take_sql("s2", "s1", K.CELL_EMAIL, "email"),
        _take_sql("s3", "s2", K.CELL_HOURS, "hours"),
        _take_sql("s4", "s3", K.CELL_CURRENCY, "money"),
        _take_sql("s5", "s4", K.CELL_URL, "url"),
        f"""found AS (
          SELECT k, ci, 0 AS step, CASE WHEN t = 'SALARY' AND p IN ({', '.join(S.q(x) for x in K.PAY_LABELS)}) THEN 'HAS_SALARY' ELSE p END AS p, v, t FROM (
            SELECT *, CASE WHEN regexp_matches(v, {S.q(K.CELL_EMAIL)}) THEN 'EMAIL_ADDRESS' WHEN regexp_matches(v, {S.q(K.CELL_PHONE)}) THEN 'PHONE_NUMBER' WHEN regexp_matches(v, {S.q(K.CELL_CURRENCY)}) THEN 'SALARY' END AS t FROM kvs)
          UNION ALL SELECT k, ci, 1, 'HAS_PHONE', phone, 'PHONE_NUMBER' FROM s5 WHERE phone <> ''
          UNION ALL SELECT k, ci, 2, 'HAS_EMAIL', email, 'EMAIL_ADDRESS' FROM s5 WHERE email <> ''
          UNION ALL SELECT k, ci, 3, 'HAS_HOURS', trim(regexp_replace(hours, '[·•|]', ',', 'g'), ', '), NULL FROM s5 WHERE hours <> ''
          UNION ALL SELECT k, ci, 4, 'HAS_SALARY', money, 'SALARY' FROM s5 WHERE money <> ''
          UNION ALL SELECT k, ci, 5, 'HAS_LINK', url, NULL FROM s5 WHERE url <> ''
          UNION ALL SELECT k, ci, 6, p, v, CASE WHEN p = 'HAS_ADDRESS' THEN 'LOCATION' END FROM (SELECT k, ci,
            CASE WHEN regexp_matches(rest, {S.q(K.CELL_ADDRESS_WORDS)}) THEN 'HAS_ADDRESS'
              WHEN regexp_matches(rest, {S.q(K.CELL_CATEGORY_WORDS)}) AND len(string_split_regex(rest, '\\s+')) <= 5 THEN 'HAS_CATEGORY'
              WHEN regexp_matches(rest, {S.q(K.CELL_RATING)}) AND length(rest) <= 12 THEN 'HAS_RATING'
              WHEN length({_TRIM.format('rest')}) >= 6 AND NOT regexp_matches({_TRIM.format('rest')}, {S.q(K.CELL_NOISE)}) THEN 'HAS_DETAILS' END AS p,
            CASE WHEN regexp_matches(rest, {S.q(K.CELL_ADDRESS_WORDS)}) THEN rest
              WHEN regexp_matches(rest, {S.q(K.CELL_CATEGORY_WORDS)}) AND len(string_split_regex(rest, '\\s+')) <= 5 THEN rest
              WHEN regexp_matches(rest, {S.q(K.CELL_RATING)}) AND length(rest) <= 12 THEN regexp_extract(rest, {S.q(K.CELL_RATING)}, 1) || regexp_extract(rest, {S.q(K.CELL_RATING)}, 2)
              ELSE {_TRIM.format('rest')} END AS v FROM s5) WHERE p IS NOT NULL)""",
        f"tidy AS (SELECT k, ci, step, p, {_TRIM.format('trim(v)')} AS v, t FROM found)",
        "facts1 AS (SELECT k, p AS predicate, v AS value, t AS entity_type FROM (SELECT *, row_number() OVER (PARTITION BY k, p, lower(v) ORDER BY ci, step) AS rn FROM tidy WHERE length(v) >= 2) WHERE rn = 1)",
    ]
)


@query("composite_facts", S.sql(["ccells"], "SELECT * FROM facts1", _COMPOSITE))
def composite_facts(spark, sf):
    rows = _cells(spark, sf).select("k", F.explode_outer(composite.decompose(F.col("cell"), F.col("subject"))).alias("f"))
    return rows.filter(F.col("f").isNotNull()).select("k", "f.*")


@query(
    "expanded_facts",
    S.sql(
        ["ccells"],
        f"""SELECT k, subject, predicate, value, {S.fact_sentence('subject', 'predicate', 'value')} AS sentence FROM (
        SELECT k, subject, predicate, value FROM facts1 JOIN ccells USING (k) WHERE {_IS_COMPOSITE}
        UNION ALL SELECT k, subject, 'HAS_NOTES', cell FROM ccells WHERE NOT {_IS_COMPOSITE})""",
        _COMPOSITE,
    ),
)
def expanded_facts(spark, sf):
    """Composite cells replaced by their facts, others kept, all worded as sentences."""
    facts = _cells(spark, sf).select("k", "subject", F.lit(1).alias("col_idx"), F.lit("HAS_NOTES").alias("predicate"), F.col("cell").alias("value"))
    rows = tables.row_sentences(tables.expand_facts(facts, ["k"]), ["k"])
    return rows.select("k", "subject", "predicate", "value", F.col("text").alias("sentence"))


@query(
    "csv_scan",
    "SELECT c_custkey::VARCHAR AS id, trim(c_name) AS name, c_mktsegment || ', ' || c_nationkey AS segment FROM customer",
)
def csv_scan(spark, sf):
    """All customers written as semicolon text, read back with the delimiter found in the data."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    rows = D.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("name"),
        F.concat("c_mktsegment", F.lit(", "), F.col("c_nationkey").cast("string")).alias("segment"),
    )
    rows.write.mode("overwrite").options(header=True, sep=";", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return delimited.read_table(spark, path)


# --- vault ----------------------------------------------------------------------------------------------------------
S.CTE["sents_ents"] = (
    ["kinded"],
    f"""SELECT doc_id, entity_type, value, ord, dig AS hmac_digest, {S.token_from('entity_type', 'dig')} AS token FROM (
      SELECT *, {S.digest('entity_type', 'value')} AS dig FROM (
        SELECT doc_id, 'PERSON' AS entity_type, subject AS value, ord * 2 AS ord FROM kinded
        UNION ALL SELECT doc_id, kind, object, ord * 2 + 1 FROM kinded WHERE kind IS NOT NULL))""",
)
S.CTE["vault"] = (
    ["sents_ents"],
    "SELECT token, arg_min(entity_type, ord) AS entity_type, arg_min(hmac_digest, ord) AS hmac_digest, arg_min(doc_id, ord) AS first_doc_id, "
    "arg_max(value, length(value) * 10000000000000::HUGEINT - ord) AS value FROM sents_ents GROUP BY 1",
)
_VCOLS = "token, entity_type, value, hmac_digest, first_doc_id"


@query("vault_upsert", S.sql(["vault"], f"SELECT {_VCOLS} FROM vault"))
def vault_upsert(spark, sf):
    return V.upsert(D.staff_entities(spark, sf))


# Two batches: short names first, then the same people with a compound surname.
_TWO = "SELECT name AS value, k AS ord, doc_id FROM staff UNION ALL SELECT name || CASE WHEN k % 2 = 0 THEN '-Sorensen' ELSE '' END, k + 1000000000, 'late-' || doc_id FROM staff"


@query(
    "vault_upsert_longest",
    S.sql(["staff"], f"""SELECT token, 'PERSON' AS entity_type, arg_max(value, length(value)) AS value, arg_min(dig, ord) AS hmac_digest, arg_min(doc_id, ord) AS first_doc_id
      FROM (SELECT *, {S.token_from(S.q('PERSON'), 'dig')} AS token FROM (SELECT *, {S.digest(S.q('PERSON'), 'value')} AS dig FROM ({_TWO}))) GROUP BY token"""),
)
def vault_upsert_longest(spark, sf):
    def batch(df):
        d = df.withColumn("entity_type", F.lit("PERSON")).withColumn("hmac_digest", entity_digest(F.lit("PERSON"), F.col("value"), D.KEY))
        return d.withColumn("token", token_text(F.lit("PERSON"), F.col("hmac_digest")))

    people = D.staff(spark, sf)
    first = batch(people.select(F.col("name").alias("value"), F.col("k").alias("ord"), "doc_id"))
    longer = F.concat("name", F.when(F.col("k") % 2 == 0, "-Sorensen").otherwise(""))
    second = batch(people.select(longer.alias("value"), F.col("k").alias("ord"), F.concat(F.lit("late-"), "doc_id").alias("doc_id")))
    return V.upsert(second, V.upsert(first))


@query("vault_roundtrip", S.sql(["vault"], "SELECT token, value, entity_type, hmac_digest, first_doc_id FROM vault"))
def vault_roundtrip(spark, sf):
    """Encrypted, decrypted; ciphertext is random and is never part of a result."""
    return V.unseal(V.seal(V.upsert(D.staff_entities(spark, sf)), D.AES_KEY), D.AES_KEY)


@query("vault_wrong_key", S.sql(["vault"], "SELECT count(*) AS tokens, 0::BIGINT AS readable FROM vault"))
def vault_wrong_key(spark, sf):
    sealed = V.seal(V.upsert(D.staff_entities(spark, sf)), D.AES_KEY)
    opened = V.unseal(sealed, bytes(reversed(D.AES_KEY)))
    return opened.agg(F.count("*").alias("tokens"), F.count("value").alias("readable"))


_GONE = "(SELECT 'NAT-' || n_nationkey FROM nation WHERE n_regionkey = 1)"


def _gone(spark, sf):
    return D.table(spark, sf, "nation").filter("n_regionkey = 1").select(F.concat(F.lit("NAT-"), F.col("n_nationkey").cast("string")).alias("doc_id"))


@query("vault_purge_first", S.sql(["vault"], f"SELECT {_VCOLS} FROM vault WHERE first_doc_id NOT IN {_GONE}"))
def vault_purge_first(spark, sf):
    return V.purge(V.upsert(D.staff_entities(spark, sf)), _gone(spark, sf))


@query(
    "vault_purge_any",
    S.sql(["vault"], f"SELECT {_VCOLS} FROM vault WHERE token IN (SELECT token FROM sents_ents WHERE doc_id NOT IN {_GONE})"),
)
def vault_purge_any(spark, sf):
    ents = D.staff_entities(spark, sf)
    return V.purge(V.upsert(ents), _gone(spark, sf), V.references(ents), "any")


@query("vault_counts", S.sql(["vault"], "SELECT count(*) AS tokens, (SELECT count(*) FROM (SELECT DISTINCT token, doc_id FROM sents_ents)) AS refs, 0::BIGINT AS cleared FROM vault"))
def vault_counts(spark, sf):
    ents = D.staff_entities(spark, sf)
    v = V.upsert(ents)
    parts = [(V.count_tokens(v), "tokens"), (V.count_tokens(V.references(ents)), "refs"), (V.count_tokens(V.clear(v)), "cleared")]
    rows = None
    for df, name in parts:
        one = df.select(F.lit(name).alias("m"), F.col("tokens").alias("n"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(*[F.max(F.when(F.col("m") == name, F.col("n"))).alias(name) for _, name in parts])


@query(
    "vault_access",
    S.sql(["vault"], f"SELECT token, value, true AS stamped FROM vault WHERE token IN (SELECT {S.token(S.q('PERSON'), 'name')} FROM staff)"),
)
def vault_access(spark, sf):
    """Batch look-up of the tokens of all people and of all nations (which have none), access stamps folded in."""
    stored = V.seal(V.upsert(D.staff_entities(spark, sf)), D.AES_KEY)
    names = D.staff(spark, sf).select("name").unionByName(D.table(spark, sf, "nation").select(F.col("n_name").alias("name")))
    asked = names.select(entity_token(F.lit("PERSON"), F.col("name"), D.KEY).alias("token"))
    stamped = V.stamp_access(stored, V.access_events(asked, stored))
    found = V.lookup(asked, stored, D.AES_KEY)
    return found.join(stamped.select("token", F.col("accessed_at").isNotNull().alias("stamped")), "token")


@query("reconstruct_text", S.sql(["sents"], "SELECT doc_id, sent_idx, text AS reconstructed, n FROM (SELECT sents.*, (SELECT count(DISTINCT (entity_type, lower(value))) FROM se WHERE se.id = sents.sent_idx) AS n FROM sents)", f"""sc AS (SELECT * FROM ({S.recognizer_rows('sents', 'sent_idx', 'text')}) WHERE {S.person_filter()}), {S.start_first('sc')}, se AS (SELECT * FROM ents)"""))
def reconstruct_text(spark, sf):
    """Tokenize every staff sentence, vault the values, swap the tokens back: the text returns unchanged."""
    done = tokens.tokenize(DT.detect(D.staff_sentences(spark, sf)), D.KEY)
    ents = DT.explode_entities(done, "doc_id", "sent_idx").withColumn("ord", F.col("sent_idx") * 100 + F.col("entity_idx"))
    sealed = V.seal(V.upsert(ents), D.AES_KEY)
    values = V.unseal(sealed, D.AES_KEY).select("token", "value")
    back = V.reconstruct(done.select("doc_id", "sent_idx", "tokenized"), values, "sent_idx", "tokenized")
    return back.select("doc_id", "sent_idx", "reconstructed", F.col("n_reconstructed").cast("bigint").alias("n"))


# --- triples --------------------------------------------------------------------------------------------------------
def _token_sentences(spark, sf):
    """The stored table of tokenized sentences that triple extraction reads."""
    done = tokens.tokenize(DT.detect(D.staff_sentences(spark, sf)), D.KEY)
    return cut(done.select("doc_id", "sent_idx", F.col("tokenized").alias("text")))


def _tok(kind: str, value: str) -> str:
    return S.token(S.q(kind), value)


# The three sentence shapes of staff_sentences have a closed form for their triples, written out here.
_TRIPLES = f"""SELECT doc_id, k * 3 AS sent_idx, {_tok('PERSON', 'name')} AS subject, 'IN_DEPARTMENT' AS predicate,
    CASE WHEN contains(department, ' ') THEN {_tok('PERSON', 'department')} ELSE department END AS object FROM staff
  UNION ALL SELECT doc_id, k * 3, {_tok('PERSON', 'name')}, 'HAS_SSN', {_tok('US_SSN', 'ssn')} FROM staff
  UNION ALL SELECT doc_id, k * 3 + 1, {_tok('PERSON', 'name')}, 'HAS_SALARY', {_tok('SALARY', 'salary')} FROM staff
  UNION ALL SELECT doc_id, k * 3 + 1, {_tok('PERSON', 'name')}, 'REPORTS_TO', {_tok('PERSON', 'manager')} FROM staff WHERE manager IS NOT NULL AND manager <> name
  UNION ALL SELECT doc_id, k * 3 + 2, {_tok('PERSON', 'name')}, 'HAS_ADDRESS', 'plot ' || k || ', ' || {_tok('PERSON', S.q('Orchard Hill'))} FROM staff WHERE k % 2 = 0
  UNION ALL SELECT doc_id, k * 3 + 2, {_tok('EMAIL_ADDRESS', 'email')}, 'RELATED_TO', {_tok('PERSON', 'name')} FROM staff WHERE k % 2 = 1"""
S.CTE["triples"] = (["staff"], _TRIPLES)


@query("text_triples", S.sql(["triples"], "SELECT * FROM triples"))
def text_triples(spark, sf):
    return triples.extract_triples(_token_sentences(spark, sf)).select("doc_id", "sent_idx", "subject", "predicate", "object")


@query("triples_per_doc", S.sql(["triples"], "SELECT doc_id, count(*) AS triple_count FROM triples GROUP BY 1"))
def triples_per_doc(spark, sf):
    return triples.triple_counts(triples.extract_triples(_token_sentences(spark, sf)))


@query(
    "clause_verbs",
    "WITH vp AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, {S.q(p)}, {S.q(v)})" for i, (p, v) in enumerate(K.VERB_PREDICATES.items()))
    + """) t(prio, phrase, predicate)),
  cl AS MATERIALIZED (SELECT conv_id, turn, ci, regexp_replace(c, '^\\s+|\\s+$', '', 'g') AS clause FROM (SELECT conv_id, turn, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS ci FROM (
    SELECT conv_id, turn, string_split_regex(text, """ + S.q(K.CLAUSE_PATTERN) + """) AS cs FROM
      (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'He has software and is an owner; ' WHEN 1 THEN 'Earning much while she leads it and ' ELSE '' END || """ + S.shadow("text") + """ AS text FROM conversations)))),
  hit AS (SELECT conv_id, turn, ci, min(prio) AS prio FROM cl JOIN vp ON contains(' ' || regexp_replace(lower(clause), '[^a-z0-9_]', ' ', 'g') || ' ', ' ' || phrase || ' ') GROUP BY 1, 2, 3)
  SELECT conv_id, turn, ci::BIGINT AS clause_idx, phrase, predicate FROM hit JOIN vp USING (prio)""",
)
def clause_verbs(spark, sf):
    """First verb phrase of every clause of every conversation turn, with two seeded openings."""
    from tokengraph.functions.text import shadow

    head = F.when(F.col("turn") % 4 == 0, "He has software and is an owner; ").when(F.col("turn") % 4 == 1, "Earning much while she leads it and ").otherwise("")
    d = D.table(spark, sf, "conversations").select("conv_id", "turn", F.concat(head, shadow(F.col("text"))).alias("text"))
    cl = d.select("conv_id", "turn", F.posexplode(triples.clauses(F.col("text"))).alias("clause_idx", "clause"))
    v = cl.withColumn("v", triples.verb_phrase(F.lower("clause"))).select(
        "conv_id", "turn", F.col("clause_idx").cast("bigint").alias("clause_idx"), F.col("v.phrase").alias("phrase"), F.col("v.predicate").alias("predicate")
    )
    return v.filter(F.col("phrase").isNotNull())


@query(
    "coref_carry",
    """SELECT conv_id, turn, last_value(CASE WHEN turn % 3 <> 1 AND length(text) % 5 <> 0 THEN 'T' || turn END IGNORE NULLS)
      OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_subject FROM conversations""",
)
def coref_carry(spark, sf):
    """Carried subject over conversation order: the last earlier turn that names one."""
    from tokengraph.functions.ordered import carry_forward

    own = F.when((F.col("turn") % 3 != 1) & (F.length("text") % 5 != 0), F.concat(F.lit("T"), F.col("turn").cast("string")))
    d = D.table(spark, sf, "conversations").select("conv_id", "turn", own.alias("own"))
    return carry_forward(d, ["conv_id"], "turn", "own", "prev_subject").select("conv_id", "turn", "prev_subject")


@query(
    "retention_terms",
    "SELECT doc_id, 'CEO' AS subject, 'HAS_RETENTION_BONUS' AS predicate, (doc_id % 90 + 10) || '% of base salary upon deal close' AS object FROM documents WHERE doc_id % 8 = 5",
)
def retention_terms(spark, sf):
    """Executive retention terms found in the sentences of the seeded documents."""
    from tokengraph.operators.segment import split_sentences

    sents = split_sentences(D.seeded_text(spark, sf), "doc_id")
    rows = sents.select("doc_id", F.explode_outer(triples.retention_triples(F.col("text"))).alias("t"))
    return rows.filter(F.col("t").isNotNull()).select("doc_id", "t.*")
