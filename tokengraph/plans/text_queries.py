"""Queries over whole documents: detection, tokens, scans, segmentation, identity, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokengraph.functions import constants as K
from tokengraph.functions.hashing import entity_digest, token_text
from tokengraph.operators import detect as DT
from tokengraph.operators import guard, segment, tokens
from tokengraph.plans import derive as D
from tokengraph.plans import sql as S
from tokengraph.plans.registry import query
from tokengraph.sources import documents as SD
from tokengraph.functions.text import shadow


def _entities(spark: SparkSession, sf: str, overlap: str = "start") -> DataFrame:
    return DT.explode_entities(DT.detect(D.seeded_text(spark, sf), overlap=overlap), "doc_id")


def _span_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", "entity_type", F.col("start").cast("bigint").alias("start_pos"), F.col("end").cast("bigint").alias("stop_pos"), "value"
    )


@query("entity_counts_by_type", S.sql(["cands"], "SELECT entity_type, count(*) AS n, count(DISTINCT value) AS n_values FROM ents GROUP BY 1", S.start_first("cands")))
def entity_counts_by_type(spark, sf):
    return _entities(spark, sf).groupBy("entity_type").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


@query("entity_spans", S.sql(["cands"], "SELECT id AS doc_id, entity_type, s::BIGINT AS start_pos, e::BIGINT AS stop_pos, value FROM cands"))
def entity_spans(spark, sf):
    return _span_columns(_entities(spark, sf, "none"))


@query("overlap_start_first", S.sql(["cands"], "SELECT id AS doc_id, entity_type, s::BIGINT AS start_pos, e::BIGINT AS stop_pos, value FROM ents", S.start_first("cands")))
def overlap_start_first(spark, sf):
    return _span_columns(_entities(spark, sf, "start"))


_REFINED = f"""raw AS MATERIALIZED (SELECT * FROM ({S.recognizer_rows('seeded', 'doc_id', 'text')})),
  texts AS MATERIALIZED (SELECT doc_id AS id, text AS txt, {S.shadow('text')} AS sh FROM seeded),
  longer AS (SELECT raw.id, entity_type, prio, score, s,
      e + CASE WHEN entity_type = 'PERSON' THEN length(regexp_extract(substr(sh, e + 1), '^-[A-Za-z]+\\b')) ELSE 0 END AS e, txt
      FROM raw JOIN texts USING (id)),
  refined AS MATERIALIZED (SELECT id, CASE WHEN entity_type = 'PERSON' AND regexp_matches(substr(txt, s + 1, e - s), {S.q(K.ORG_WORD_PATTERN)})
      THEN 'ORGANIZATION' ELSE entity_type END AS entity_type, entity_type AS first_type, prio, score, s, e, substr(txt, s + 1, e - s) AS value FROM longer)"""
_SCORE = """, ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY -score, s, prio) AS r FROM refined),
  walk AS (SELECT id, 0::BIGINT AS r, false AS ok, []::BIGINT[] AS ss, []::BIGINT[] AS es FROM (SELECT DISTINCT id FROM ranked)
    UNION ALL
    SELECT id, r, ok, CASE WHEN ok THEN list_append(ss, s) ELSE ss END, CASE WHEN ok THEN list_append(es, e) ELSE es END FROM (
      SELECT w.id, x.r, w.ss, w.es, x.s::BIGINT AS s, x.e::BIGINT AS e,
        len(list_filter(range(1, len(w.ss) + 1), lambda i: w.ss[i] < x.e AND x.s < w.es[i])) = 0 AS ok
      FROM walk w JOIN ranked x ON x.id = w.id AND x.r = w.r + 1))"""


@query("overlap_score_first", S.sql(["seeded"], "SELECT ranked.id AS doc_id, entity_type, s::BIGINT AS start_pos, e::BIGINT AS stop_pos, value FROM ranked JOIN walk USING (id, r) WHERE ok", _REFINED + _SCORE))
def overlap_score_first(spark, sf):
    return _span_columns(_entities(spark, sf, "score"))


@query("person_stop_phrases", S.sql(["seeded"], "SELECT id AS doc_id, value, count(*) AS n FROM raw WHERE entity_type = 'PERSON' AND NOT " + S.person_filter() + " GROUP BY 1, 2", f"raw AS MATERIALIZED ({S.recognizer_rows('seeded', 'doc_id', 'text', [r for r in K.RECOGNIZERS if r[0] == 'PERSON'])})"))
def person_stop_phrases(spark, sf):
    """PERSON-shaped values that the stop rules drop."""
    people = [r for r in K.RECOGNIZERS if r[0] == "PERSON"]
    d = D.seeded_text(spark, sf).withColumn("sh", shadow(F.col("text")))
    every = d.select("doc_id", DT.candidate_column("text", "sh", people, person_filter=False).alias("entities"))
    rows = DT.explode_entities(every, "doc_id")
    return rows.filter(F.expr("not " + DT.PERSON_OK.format(v="value"))).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


@query("refined_people", S.sql(["seeded"], "SELECT id AS doc_id, entity_type, s::BIGINT AS start_pos, e::BIGINT AS stop_pos, value FROM refined WHERE first_type = 'PERSON'", _REFINED))
def refined_people(spark, sf):
    """Surname extension and company relabelling of PERSON candidates."""
    people = [r for r in K.RECOGNIZERS if r[0] == "PERSON"]
    d = D.seeded_text(spark, sf).withColumn("sh", shadow(F.col("text")))
    found = d.withColumn("raw", DT.candidate_column("text", "sh", people, person_filter=False))
    return _span_columns(
        DT.explode_entities(found.select("doc_id", DT.refine_people(F.col("raw"), F.col("text"), F.col("sh")).alias("entities")), "doc_id")
    )


_CATS = [["SSN", "EMAIL"], ["PERSON", "PHONE", "BIOMETRIC"], [], ["SALARY", "LOCATION", "CREDIT"]]


def _categories(key):
    out = F.array().cast("array<string>")
    for i, names in enumerate(_CATS):
        out = F.when(key % len(_CATS) == i, F.array(*[F.lit(n) for n in names]).cast("array<string>")).otherwise(out)
    return out


_CAT_SQL = "CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN {S.values_list(c)}::VARCHAR[]" for i, c in enumerate(_CATS)) + " END"
_ALIAS_SQL = S.case_map("c", K.CATEGORY_ALIASES, "c")


@query(
    "category_filter",
    S.sql(
        ["cands"],
        "SELECT doc_id, entity_type, count(*) AS n FROM (SELECT cands.*, id AS doc_id FROM cands) JOIN cats USING (doc_id) "
        "WHERE len(cats) = 0 OR len(list_filter(cats, lambda c: contains(entity_type, c) OR contains(c, entity_type))) > 0 GROUP BY 1, 2",
        f"cats AS (SELECT doc_id, list_transform({_CAT_SQL}, lambda c: {_ALIAS_SQL}) AS cats FROM documents)",
    ),
)
def category_filter(spark, sf):
    d = D.seeded_text(spark, sf).withColumn("cats", DT.resolve_categories(_categories(F.col("doc_id"))))
    return DT.explode_entities(DT.detect(d, categories="cats", overlap="none"), "doc_id").groupBy("doc_id", "entity_type").agg(F.count("*").alias("n"))


@query(
    "unknown_categories",
    f"SELECT DISTINCT doc_id, category FROM (SELECT doc_id, unnest(list_transform({_CAT_SQL}, lambda c: {_ALIAS_SQL})) AS category FROM documents) "
    f"WHERE category NOT IN ({', '.join(S.q(c) for c in K.ENTITY_CATEGORIES)})",
)
def unknown_categories(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", _categories(F.col("doc_id")).alias("cats"))
    return DT.unknown_categories(d, "doc_id", "cats")


@query(
    "confidence_filter",
    S.sql(["cands"], "SELECT id AS doc_id, count(*) AS n FROM cands WHERE score >= (86 + id % 12) / 100.0 GROUP BY 1"),
)
def confidence_filter(spark, sf):
    """Per-document confidence floors."""
    d = D.seeded_text(spark, sf).withColumn("floor", (86 + F.col("doc_id") % 12) / 100.0)
    found = DT.detect(d, overlap="none")
    kept = found.select("doc_id", DT.above_confidence(F.col("entities"), F.col("floor")).alias("entities"))
    return DT.explode_entities(kept, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("entities_per_document", S.sql(["cands"], "SELECT doc_id, coalesce(n, 0) AS entity_count FROM documents LEFT JOIN (SELECT id, count(*) AS n FROM ents GROUP BY 1) ON id = doc_id", S.start_first("cands")))
def entities_per_document(spark, sf):
    return DT.entity_counts(DT.detect(D.seeded_text(spark, sf)), "doc_id")


_TOKENIZED = S.start_first("cands") + f""",
  toks AS MATERIALIZED (SELECT id, r, s, e, entity_type, value, dig, {S.token_from('entity_type', 'dig')} AS token FROM (SELECT *, {S.digest('entity_type', 'value')} AS dig FROM ents)),
  gaps AS (SELECT id, s, token, lag(e, 1, 0) OVER (PARTITION BY id ORDER BY s) AS p FROM toks),
  rewritten AS (SELECT doc_id, coalesce(string_agg(substr(text, p + 1, s - p) || token, '' ORDER BY s), '')
      || substr(any_value(text), coalesce((SELECT max(e) FROM toks t WHERE t.id = doc_id), 0) + 1) AS tokenized
      FROM seeded LEFT JOIN gaps ON id = doc_id GROUP BY doc_id)"""


@query("tokenize_text", S.sql(["cands"], "SELECT doc_id, md5(tokenized) AS text_hash, length(tokenized)::BIGINT AS n FROM rewritten", _TOKENIZED))
def tokenize_text(spark, sf):
    done = tokens.tokenize(DT.detect(D.seeded_text(spark, sf)), D.KEY)
    return done.select("doc_id", F.md5("tokenized").alias("text_hash"), F.length("tokenized").cast("bigint").alias("n"))


@query("tokenized_entities", S.sql(["cands"], "SELECT id AS doc_id, entity_type, value, dig AS hmac_digest, token FROM toks", _TOKENIZED))
def tokenized_entities(spark, sf):
    done = tokens.tokenize(DT.detect(D.seeded_text(spark, sf)), D.KEY)
    return DT.explode_entities(done, "doc_id").select("doc_id", "entity_type", "value", "hmac_digest", "token")


@query(
    "redaction_policies",
    S.sql(
        ["cands"],
        "SELECT doc_id, pol AS policy, md5(CASE pol WHEN 'TOKENIZE' THEN (SELECT tokenized FROM rewritten w WHERE w.doc_id = p.doc_id) "
        "WHEN 'REDACT' THEN (SELECT tokenized FROM redacted w WHERE w.doc_id = p.doc_id) ELSE text END) AS text_hash "
        "FROM (SELECT *, ['TOKENIZE', 'REDACT', 'PASSTHROUGH'][doc_id % 3 + 1] AS pol FROM seeded) p",
        _TOKENIZED
        + """, redacted AS (SELECT doc_id, coalesce(string_agg(substr(text, p + 1, s - p) || '[' || entity_type || ']', '' ORDER BY s), '')
      || substr(any_value(text), coalesce((SELECT max(e) FROM toks t WHERE t.id = doc_id), 0) + 1) AS tokenized
      FROM seeded LEFT JOIN (SELECT id, s, entity_type, lag(e, 1, 0) OVER (PARTITION BY id ORDER BY s) AS p FROM toks) ON id = doc_id GROUP BY doc_id)""",
    ),
)
def redaction_policies(spark, sf):
    d = D.seeded_text(spark, sf).withColumn("policy", F.element_at(F.array(*[F.lit(p) for p in K.REDACTION_POLICIES]), (F.col("doc_id") % 3 + 1).cast("int")))
    done = tokens.apply_policy(tokens.tokenize(DT.detect(d), D.KEY), "policy")
    return done.select("doc_id", "policy", F.md5("protected").alias("text_hash"))


_PEOPLE_SQL = "SELECT 'PERSON' AS entity_type, c_name AS value FROM customer UNION ALL SELECT 'ORGANIZATION', s_name FROM supplier UNION ALL SELECT 'PERSON', p_name FROM part"


def _named_values(spark, sf):
    return (
        D.table(spark, sf, "customer").select(F.lit("PERSON").alias("entity_type"), F.col("c_name").alias("value"))
        .unionByName(D.table(spark, sf, "supplier").select(F.lit("ORGANIZATION").alias("entity_type"), F.col("s_name").alias("value")))
        .unionByName(D.table(spark, sf, "part").select(F.lit("PERSON").alias("entity_type"), F.col("p_name").alias("value")))
    )


@query(
    "hmac_tokens",
    f"SELECT entity_type, value, dig AS hmac_digest, {S.token_from('entity_type', 'dig')} AS token, entity_type AS token_type, true AS valid "
    f"FROM (SELECT *, {S.digest('entity_type', 'value')} AS dig FROM ({_PEOPLE_SQL}))",
)
def hmac_tokens(spark, sf):
    rows = _named_values(spark, sf).withColumn("hmac_digest", entity_digest(F.col("entity_type"), F.col("value"), D.KEY))
    rows = rows.withColumn("token", token_text(F.col("entity_type"), F.col("hmac_digest")))
    return rows.withColumn("token_type", tokens.token_type(F.col("token"))).withColumn("valid", tokens.is_token(F.col("token")))


# Forced clashes: digests cut down to two hex digits share tokens very often.
_CLASH_SQL = (
    f"SELECT DISTINCT 'X' AS entity_type, substr(dig, 1, 2) || '00000000' || substr(dig, 3, 54) AS hmac_digest FROM "
    f"(SELECT {S.digest('entity_type', 'value')} AS dig FROM ({_PEOPLE_SQL}))"
)


@query(
    "token_collisions",
    f"""WITH base AS (SELECT *, {S.token_from('entity_type', 'hmac_digest')} AS token FROM ({_CLASH_SQL})),
    n AS (SELECT token, count(*) AS n FROM base GROUP BY 1),
    slices AS (SELECT token, k, count(DISTINCT substr(hmac_digest, 11 + 4 * k, 4)) AS d FROM base, range(13) t(k) GROUP BY 1, 2),
    pick AS (SELECT token, min(k) AS k FROM slices JOIN n USING (token) WHERE d = n GROUP BY 1)
    SELECT entity_type, hmac_digest, CASE WHEN n = 1 OR k IS NULL THEN token
      ELSE '⟦' || upper(substr(hmac_digest, 1, 2)) || '_X_' || upper(substr(hmac_digest, 3, 8)) || upper(substr(hmac_digest, 11 + 4 * k, 4)) || '⟧' END AS token
    FROM base JOIN n USING (token) LEFT JOIN pick USING (token)""",
)
def token_collisions(spark, sf):
    rows = _named_values(spark, sf).select(entity_digest(F.col("entity_type"), F.col("value"), D.KEY).alias("d"))
    clashing = rows.select(F.lit("X").alias("entity_type"), F.concat(F.substring("d", 1, 2), F.lit("00000000"), F.substring("d", 3, 54)).alias("hmac_digest"))
    return tokens.token_dictionary(clashing)


def _scan_sql(patterns):
    parts = ", ".join(f"CASE WHEN regexp_matches(text, {S.q(p)}) THEN {S.q(label)} END" for p, label in patterns)
    return f"array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), ';')"


@query("injection_scan", S.sql(["seeded"], f"SELECT doc_id, v AS violations, v = '' AS is_safe, CASE WHEN v = '' THEN length(text) ELSE 0 END::BIGINT AS n_sanitized FROM (SELECT *, {_scan_sql(K.INJECTION_PATTERNS)} AS v FROM seeded)"))
def injection_scan(spark, sf):
    d = guard.scan_injections(D.seeded_text(spark, sf))
    return d.select("doc_id", F.array_join("violations", ";").alias("violations"), "is_safe", F.length("sanitized_text").cast("bigint").alias("n_sanitized"))


@query("leak_scan", S.sql(["seeded"], f"SELECT 'd' || doc_id AS id, {_scan_sql(K.LEAK_PATTERNS)} AS warnings FROM (SELECT doc_id, {S.shadow('text')} AS text FROM seeded) UNION ALL SELECT 'c' || conv_id || '-' || turn, {_scan_sql(K.LEAK_PATTERNS)} FROM (SELECT conv_id, turn, {S.shadow('text')} AS text FROM conversations)"))
def leak_scan(spark, sf):
    docs = D.seeded_text(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    talk = D.table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), "text"
    )
    both = docs.unionByName(talk)
    return both.select("id", F.array_join(guard.leak_warnings(F.col("text")), ";").alias("warnings"))


_PARA = "regexp_replace(text, '\\r\\n?', chr(10), 'g')"
_FLAT = (
    "array_to_string(list_filter(list_transform(string_split(b, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^#+\\s*', ''), '^\\s+|\\s+$', '', 'g')), "
    "lambda x: x <> ''), ' ')"
)


def _sentences_sql(source: str, id_col: str) -> str:
    return f"""SELECT {id_col}, (row_number() OVER (PARTITION BY {id_col} ORDER BY bi, si) - 1)::BIGINT AS sent_idx, s AS sentence FROM (
      SELECT {id_col}, bi, si, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS s FROM (
        SELECT {id_col}, bi, unnest(ss) AS s, generate_subscripts(ss, 1) AS si FROM (
          SELECT {id_col}, bi, string_split(regexp_replace({_FLAT}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM (
            SELECT {id_col}, unnest(bs) AS b, generate_subscripts(bs, 1) AS bi FROM (SELECT {id_col}, string_split_regex({_PARA}, '\\n\\s*\\n+') AS bs FROM {source}))))
    ) WHERE s <> ''"""


@query("sentence_split", _sentences_sql("documents", "doc_id"))
def sentence_split(spark, sf):
    rows = segment.split_sentences(D.table(spark, sf, "documents"), "doc_id")
    return rows.select("doc_id", F.col("sent_idx").cast("bigint").alias("sent_idx"), F.col("text").alias("sentence"))


@query("paragraph_split", f"SELECT doc_id, (bi - 1)::BIGINT AS para_idx, {_FLAT} AS paragraph FROM (SELECT doc_id, unnest(bs) AS b, generate_subscripts(bs, 1) AS bi FROM (SELECT doc_id, string_split_regex({_PARA}, '\\n\\s*\\n+') AS bs FROM documents)) WHERE {_FLAT} <> ''")
def paragraph_split(spark, sf):
    return segment.split_paragraphs(D.table(spark, sf, "documents"), "doc_id").withColumn("para_idx", F.col("para_idx").cast("bigint"))


# Every document followed by a table: with a separator row, without one, or a lone pipe line.
def _table_text(spark, sf):
    k = F.col("doc_id")
    name, sid = D.person_name(k), k.cast("string")
    strict = F.concat(F.lit("\n\n| Name | SSN | Notes |\n| --- | --- | --- |\n| "), name, F.lit(" | "), D.ssn(k), F.lit(" | |\n| Jo "), sid, F.lit(" |  | late | \n\nDone."))
    loose = F.concat(F.lit("\n\nItem | Price\nlamp "), sid, F.lit(" | $"), sid, F.lit("\n | 9\nEnd of list."))
    lone = F.concat(F.lit("\n\nalone | "), sid, F.lit("\nnothing follows."))
    return D.table(spark, sf, "documents").select("doc_id", F.concat("text", F.when(k % 3 == 0, strict).when(k % 3 == 1, loose).otherwise(lone)).alias("text"))


_TT = (
    "tt AS MATERIALIZED (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN E'\\n\\n| Name | SSN | Notes |\\n| --- | --- | --- |\\n| ' || "
    + S.person_name("doc_id") + " || ' | ' || " + S.ssn("doc_id") + " || E' | |\\n| Jo ' || doc_id || E' |  | late | \\n\\nDone.' "
    "WHEN 1 THEN E'\\n\\nItem | Price\\nlamp ' || doc_id || ' | $' || doc_id || E'\\n | 9\\nEnd of list.' "
    "ELSE E'\\n\\nalone | ' || doc_id || E'\\nnothing follows.' END AS text FROM documents)"
)
_TABLES = _TT + f""",
  lines AS MATERIALIZED (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split({_PARA}, chr(10)) AS ls FROM tt)),
  flagged AS (SELECT *, contains(line, '|') AND NOT starts_with(trim(line), '#') AS piped FROM lines),
  runs AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, piped ORDER BY i) AS g FROM flagged),
  blocks AS (SELECT doc_id, g, min(i) AS lo, max(i) AS hi FROM runs WHERE piped GROUP BY 1, 2 HAVING count(*) >= 2),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lo) - 1 AS table_idx FROM blocks),
  cells AS (SELECT l.doc_id, table_idx, i, list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '^\\|', ''), '\\|$', ''), '|'), lambda c: trim(c)) AS cells
    FROM numbered n JOIN lines l ON l.doc_id = n.doc_id AND l.i BETWEEN lo AND hi),
  content AS (SELECT * FROM cells WHERE len(list_filter(cells, lambda c: c <> '' AND NOT regexp_matches(c, {S.q(K.TABLE_SEPARATOR_CELL)}))) > 0),
  trows AS (SELECT *, row_number() OVER (PARTITION BY doc_id, table_idx ORDER BY i) - 1 AS row_idx FROM content),
  heads AS (SELECT doc_id, table_idx, cells AS headers FROM trows WHERE row_idx = 0),
  good AS (SELECT DISTINCT doc_id, table_idx FROM trows JOIN heads USING (doc_id, table_idx) WHERE row_idx > 0 AND cells[1] <> ''
    AND len(list_filter(cells[2:len(headers)], lambda c: c <> '')) > 0)"""


@query("pipe_table_rows", "WITH " + _TABLES + " SELECT doc_id, table_idx::BIGINT AS table_idx, row_idx::BIGINT AS row_idx, array_to_string(cells, '¦') AS cells FROM trows SEMI JOIN good USING (doc_id, table_idx)")
def pipe_table_rows(spark, sf):
    rows = segment.table_rows(_table_text(spark, sf), "doc_id")
    return rows.select("doc_id", F.col("table_idx").cast("bigint").alias("table_idx"), F.col("row_idx").cast("bigint").alias("row_idx"), F.array_join("cells", "¦").alias("cells"))


@query(
    "text_without_tables",
    "WITH " + _TABLES + """, gone AS (SELECT doc_id, lo, hi FROM numbered JOIN good USING (doc_id, table_idx)),
  kept AS (SELECT l.doc_id, i, line FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.i BETWEEN g.lo AND g.hi
    UNION ALL SELECT doc_id, lo, chr(10) FROM gone)
  SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY i)) AS text_hash FROM kept GROUP BY 1""",
)
def text_without_tables(spark, sf):
    return _table_text(spark, sf).select("doc_id", F.md5(segment.without_tables(F.col("text"))).alias("text_hash"))


@query(
    "doc_identity",
    """SELECT doc_id, upper('CSV-' || substr(stem, 1, 24) || '-' || substr(sha256(unhex(substr(hex(bytes), 1, 2048))), 1, 6)) AS document_id, 'csv.' || lower(regexp_replace(stem, '[^a-zA-Z0-9_]', '_', 'g')) AS namespace,
    CASE WHEN length(first) < 100 AND first <> '' THEN first ELSE title END AS title, CASE WHEN lang IN ('en') THEN 'PUBLIC' ELSE 'INTERNAL' END AS classification,
    CASE WHEN doc_id % 2 = 0 THEN source ELSE 'System Ingest' END AS author
    FROM (SELECT *, regexp_replace('my file ' || source || '-' || doc_id, '[^\\w\\-]', '', 'g') AS stem, text::BLOB AS _b,
      regexp_replace(string_split(text, chr(10))[1], '^\\s+|\\s+$', '', 'g') AS first, '' AS title, encode(text) AS bytes FROM documents)""",
)
def doc_identity(spark, sf):
    d = D.table(spark, sf, "documents")
    name = F.concat(F.lit("in/my file "), "source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".csv"))
    blank = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("  ")
    return d.select(
        "doc_id",
        SD.document_id("CSV", name, F.encode("text", "UTF-8")).alias("document_id"),
        SD.namespace("csv", name).alias("namespace"),
        SD.resolve_title(F.lit(" "), F.lit("(anonymous)"), F.col("text"), F.lit("")).alias("title"),
        SD.resolve_classification(F.when(F.col("lang") == "en", "public").otherwise("secret")).alias("classification"),
        SD.resolve_author(blank, F.lit("(anonymous)")).alias("author"),
    )


@query(
    "page_roster",
    "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Engineering' WHEN 1 THEN 'Customer Success' WHEN 2 THEN 'Legal & Risk' END AS department, "
    "CASE WHEN page_id % 2 = 0 THEN (2000 + page_id % 30)::VARCHAR || '-07-15' ELSE NULL END AS created FROM pages",
)
def page_roster(spark, sf):
    """Roster headings and embedded dates on page texts (the page source with a heading line by page id)."""
    k = F.col("page_id")
    heading = F.when(k % 4 == 0, "\n3. ENGINEERING Department Roster\n").when(k % 4 == 1, "\n4b. customer success department roster\n").when(
        k % 4 == 2, "\n7 Legal & Risk Department Roster\n"
    ).otherwise("\nStaff overview\n")
    pages = D.table(spark, sf, "pages").select(k, F.concat(F.regexp_replace("html", "<[^>]*>", ". "), heading).alias("text"))
    raw = F.when(k % 2 == 0, F.concat(F.lit("D:"), (2000 + k % 30).cast("string"), F.lit("0715120000"))).otherwise("unknown")
    today = F.current_date()
    date = SD.resolve_date(raw)
    return pages.select(
        "page_id",
        SD.page_department(F.col("text")).alias("department"),
        F.when(date != today, F.date_format(date, "yyyy-MM-dd")).alias("created"),
    )


def _header_files(spark, sf):
    """Every document behind a header; some headers are broken on purpose."""
    k = F.col("doc_id")
    sid = k.cast("string")
    level = F.element_at(F.array(*[F.lit(c) for c in [*K.CLASSIFICATIONS, "SECRET"]]), (k % 5 + 1).cast("int"))
    conf = F.when(k % 11 == 0, "1.5").otherwise("0.9")
    head = F.concat(
        F.lit("---\nokf_version: \"1.0\"\ndocument:\n  id: \"DOC-"), sid, F.lit("\"\n  title: \"T "), sid, F.lit("\"\n  classification: \""), level,
        F.lit("\"\n  department: \""), "source", F.lit("\"\n  author: \"a@b.example\"\n  created: \"2026-07-15\"\nprivacy:\n  entity_categories:\n    - PERSON\n    - SSN\n  min_confidence: "), conf,
        F.lit("\naccess_control:\n  allowed_roles:\n    - hr\ngraph:\n  namespace: \"ns."), sid, F.lit("\"\n---\n"),
    )
    content = F.when(k % 7 == 3, F.col("text")).otherwise(F.concat(head, "text"))
    return D.table(spark, sf, "documents").select(F.concat(F.lit("/in/"), sid, F.lit(".md")).alias("path"), content.alias("content"))


_OKDOC = "doc_id % 7 <> 3 AND doc_id % 5 <> 4 AND doc_id % 11 <> 0"


@query(
    "header_docs",
    f"SELECT 'DOC-' || doc_id AS id, 'T ' || doc_id AS title, {S.values_list(K.CLASSIFICATIONS + ['SECRET'])}[doc_id % 5 + 1] AS classification, source AS department, "
    f"'ns.' || doc_id AS namespace, 0.9::DOUBLE AS min_confidence, 3::BIGINT AS depth, 'PERSON,SSN' AS categories, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS body_hash FROM documents WHERE {_OKDOC}",
)
def header_docs(spark, sf):
    good, _ = SD.parse_documents(_header_files(spark, sf))
    h = F.col("header")
    return good.select(
        h["id"].alias("id"), h["title"].alias("title"), h["classification"].alias("classification"), h["department"].alias("department"),
        h["namespace"].alias("namespace"), h["min_confidence"].alias("min_confidence"), h["max_traversal_depth"].cast("bigint").alias("depth"),
        F.array_join(h["entity_categories"], ",").alias("categories"), F.md5("body").alias("body_hash"),
    )


@query(
    "header_rejects",
    "SELECT '/in/' || doc_id || '.md' AS path, CASE WHEN doc_id % 7 = 3 THEN 'no header' ELSE array_to_string(list_filter([CASE WHEN doc_id % 5 = 4 THEN 'bad classification' END, "
    f"CASE WHEN doc_id % 11 = 0 THEN 'bad min_confidence' END], lambda x: x IS NOT NULL), ';') END AS reasons FROM documents WHERE NOT ({_OKDOC})",
)
def header_rejects(spark, sf):
    _, bad = SD.parse_documents(_header_files(spark, sf))
    return bad.select("path", F.array_join("reasons", ";").alias("reasons"))


@query(
    "format_routing",
    "SELECT CASE WHEN ext IN ('md','txt') THEN 'text' WHEN ext = 'csv' THEN 'table' ELSE 'rejected' END AS kind, count(*) AS n FROM "
    "(SELECT ['md','CSV','txt','docx','csv'][doc_id % 5 + 1] AS e0, lower(['md','CSV','txt','docx','csv'][doc_id % 5 + 1]) AS ext FROM documents) GROUP BY 1",
)
def format_routing(spark, sf):
    d = D.table(spark, sf, "documents")
    ext = F.element_at(F.array(*[F.lit(x) for x in ("md", "CSV", "txt", "docx", "csv")]), (F.col("doc_id") % 5 + 1).cast("int"))
    parts = SD.route(d.select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), "text"))
    out = None
    for kind, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "markdown_sink",
    f"SELECT 'DOC-' || doc_id AS doc_id, ends_with(regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10), chr(10)) AS closed, 'T ' || doc_id AS title, md5('# T ' || doc_id || chr(10) || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS body_hash FROM documents WHERE {_OKDOC}",
)
def markdown_sink(spark, sf):
    """Documents written as header + body text parse back to the same header and titled body."""
    good, _ = SD.parse_documents(_header_files(spark, sf))
    text = SD.to_markdown(good)
    again, _ = SD.parse_documents(text.select(F.col("doc_id").alias("path"), F.col("value").alias("content")))
    return again.select(F.col("header.id").alias("doc_id"), F.lit(True).alias("closed"), F.col("header.title").alias("title"), F.md5("body").alias("body_hash"))
