"""SQL (DuckDB dialect) for the derivations of ``plans/derive.py`` and for the building blocks of the oracle queries."""

from __future__ import annotations

from tokengraph.functions import constants as K
from tokengraph.plans import derive as D


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def values_list(items: list[str]) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def case_map(expr: str, mapping: dict[str, str], default: str = "NULL") -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


def blob(b: bytes) -> str:
    return "'" + "".join(f"\\x{x:02X}" for x in b) + "'::BLOB"


def digest(entity_type: str, value: str) -> str:
    """Hex HMAC-SHA256 of ``TYPE:normal value``."""
    low = f"lower(trim({value}))"
    norm = f"CASE WHEN {entity_type} IN ('PERSON','NAME') THEN regexp_replace({low}, '(\\s+[a-z]+)-[a-z]+$', '\\1') ELSE {low} END"
    msg = f"encode(upper(trim({entity_type})) || ':' || ({norm}))"
    return f"sha256({blob(bytes(D.KEY.outer))} || unhex(sha256({blob(bytes(D.KEY.inner))} || {msg})))"


def token_from(entity_type: str, dig: str) -> str:
    return f"('⟦' || upper(substr({dig},1,2)) || '_' || {entity_type} || '_' || upper(substr({dig},3,8)) || '⟧')"


def token(entity_type: str, value: str) -> str:
    return f"list_transform([{digest(entity_type, value)}], lambda d: {token_from(entity_type, 'd')})[1]"


def padded(key: str, width: int) -> str:
    return f"(repeat('0', greatest({width} - length(({key})::VARCHAR), 0)) || ({key})::VARCHAR)"


def person_name(key: str) -> str:
    return (
        f"({values_list(D.FIRST_NAMES)}[({key}) % 16 + 1] || ' K' || "
        f"translate({padded(key, 7)}, '0123456789', 'abcdefghij'))"
    )


def ssn(key: str) -> str:
    return f"((900 + {key} // 1000000 % 100)::VARCHAR || '-' || lpad(({key} // 10000 % 100)::VARCHAR, 2, '0') || '-' || lpad(({key} % 10000)::VARCHAR, 4, '0'))"


def shadow(text: str) -> str:
    letters = (
        r"[\x{AA}\x{B2}\x{B3}\x{B5}\x{B9}\x{BA}\x{BC}-\x{BE}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2AF}\x{370}-\x{373}"
        r"\x{386}\x{388}-\x{3FF}\x{400}-\x{481}\x{48A}-\x{52F}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{3400}-\x{4DBF}"
        r"\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}]"
    )
    blanks = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    s = f"regexp_replace({text}, {q(letters)}, '_', 'g')"
    s = f"regexp_replace({s}, {q(blanks)}, chr(9), 'g')"
    return f"regexp_replace({s}, {q(r'[^\x00\x03-\x7F]')}, '~', 'g')"


def fact_sentence(subject: str, predicate: str, value: str) -> str:
    mids, tails = {}, {}
    for p, t in K.SENTENCE_TEMPLATES.items():
        mids[p], tails[p] = t.removeprefix("{subj}").split("{val}")
    attribute = f"' has ' || lower(replace(regexp_replace({predicate}, '^HAS_', ''), '_', ' ')) || ' '"
    return f"({subject} || {case_map(predicate, mids, attribute)} || {value} || {case_map(predicate, tails, chr(39) + '.' + chr(39))})"


def _facts_union() -> str:
    parts = [
        f"SELECT name AS subject, {q(p)} AS predicate, {c} AS object, doc_id, namespace, classification, k * 20 + {i + 1} AS ord, 'person' AS about FROM staff"
        for i, (p, c) in enumerate(D.STAFF_FACTS)
    ]
    parts.append(
        "SELECT n_name, 'LOCATED_IN', r_name, 'NAT-' || n_nationkey, 'hr.r' || n_regionkey, "
        f"{values_list(K.CLASSIFICATIONS)}[n_nationkey % 4 + 1], {D.NATION_ORD} + n_nationkey, 'nation' "
        "FROM nation JOIN region ON n_regionkey = r_regionkey"
    )
    return " UNION ALL ".join(parts)


def _fill(template: str, subs: dict[str, str]) -> str:
    out, rest = [], template
    while "{" in rest:
        a, b = rest.split("{", 1)
        if a:
            out.append(q(a))
        out.append(subs[b[0]])
        rest = b[2:]
    if rest or not out:
        out.append(q(rest))
    return " || ".join(out)


def recognizer_rows(source: str, id_col: str, text: str, recognizers=tuple(K.RECOGNIZERS)) -> str:
    """Every match of every recognizer in ``source`` with offsets: (id, entity_type, prio, score, s, e, value)."""
    parts = []
    for prio, (t, pattern, score) in enumerate(recognizers):
        split = f"string_split_regex(regexp_replace(sh, {q('(' + pattern + ')')}, chr(1) || '\\1' || chr(2), 'g'), '[' || chr(1) || chr(2) || ']')"
        parts.append(
            f"""SELECT id, {q(t)} AS entity_type, {prio} AS prio, {score} AS score, s, s + length(p) AS e, substr(txt, s + 1, length(p)) AS value
            FROM (SELECT id, txt, i, p, (sum(length(p)) OVER (PARTITION BY id ORDER BY i) - length(p))::BIGINT AS s
                  FROM (SELECT id, txt, unnest(parts) AS p, generate_subscripts(parts, 1) AS i
                        FROM (SELECT id, txt, {split} AS parts FROM ({source_shadow(source, id_col, text)}))))
            WHERE i % 2 = 0"""
        )
    return " UNION ALL ".join(parts)


def source_shadow(source: str, id_col: str, text: str) -> str:
    return f"SELECT {id_col} AS id, {text} AS txt, {shadow(text)} AS sh FROM {source}"


def person_filter(alias: str = "") -> str:
    a = alias + "." if alias else ""
    stops = ", ".join(q(s) for s in K.PERSON_STOP_PHRASES)
    return (
        f"NOT ({a}entity_type = 'PERSON' AND (lower({a}value) IN ({stops}) OR contains(lower({a}value), 'social security') "
        f"OR regexp_matches({a}value, {q(K.ORG_WORD_PATTERN)})))"
    )


def start_first(cands: str) -> str:
    """CTE bodies (ranked, kept) of the start-first overlap rule over a candidate relation."""
    return f"""ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, -score, prio) AS r FROM {cands}),
    kept AS (SELECT id, r, e FROM ranked WHERE r = 1
      UNION ALL
      SELECT n.id, n.r, n.e FROM (
        SELECT x.id, min(x.r) AS r FROM kept k JOIN ranked x ON x.id = k.id AND x.r > k.r AND x.s >= k.e GROUP BY x.id, k.r
      ) m JOIN ranked n ON n.id = m.id AND n.r = m.r),
    ents AS (SELECT ranked.* FROM ranked JOIN kept USING (id, r))"""


CTE: dict[str, tuple[list[str], str]] = {
    "staff": (
        [],
        f"""SELECT c_custkey AS k, {person_name('c_custkey')} AS name, {values_list(D.DEPARTMENTS)}[c_custkey % 8 + 1] AS department,
        n_name AS nation, '$' || floor(abs(c_acctbal))::BIGINT AS salary,
        CASE WHEN c_custkey > 0 THEN {person_name('c_custkey // 10')} END AS manager,
        CASE WHEN c_custkey % 7 = 0 THEN 'Promotion cycle ' || c_custkey WHEN c_custkey % 7 IN (1, 2) THEN 'Merit raise ' || c_custkey END AS reason,
        (c_custkey % 5 + 1) || '.' || (c_custkey % 10) || '(' || c_custkey || ')' AS rating,
        'Engineer ' || c_custkey AS role, 'user' || c_custkey || '@corp.example' AS email,
        CASE WHEN c_custkey % 3 = 0 THEN '555-' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') END AS phone,
        CASE WHEN c_custkey % 3 = 1 THEN 'desk ' || c_custkey END AS contact, {ssn('c_custkey')} AS ssn,
        'NAT-' || c_nationkey AS doc_id, 'hr.r' || n_regionkey AS namespace,
        {values_list(K.CLASSIFICATIONS)}[c_nationkey % 4 + 1] AS classification
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "facts": (
        ["staff"],
        f"SELECT *, {fact_sentence('subject', 'predicate', 'object')} AS source_sentence FROM ({_facts_union()}) WHERE object IS NOT NULL",
    ),
    "kinded": (
        ["facts"],
        f"SELECT *, {case_map('predicate', D.TYPED_OBJECTS)} AS kind FROM facts WHERE about = 'person'",
    ),
    "tfacts": (
        ["kinded"],
        f"""SELECT *, {fact_sentence('subject', 'predicate', 'object')} AS source_sentence FROM (
        SELECT {token(q('PERSON'), 'subject')} AS subject, predicate,
        CASE WHEN kind IS NULL THEN object ELSE {token('kind', 'object')} END AS object, doc_id, namespace, classification, ord FROM kinded)""",
    ),
    "sents": (
        ["staff"],
        """SELECT doc_id, k * 3 + i AS sent_idx, text FROM (
        SELECT doc_id, k, 0 AS i, name || ' works in ' || department || ' department and has SSN ' || ssn || '.' AS text FROM staff
        UNION ALL SELECT doc_id, k, 1, 'She earns ' || salary || CASE WHEN manager IS NOT NULL THEN ' and reports to ' || manager ELSE '' END || '.' FROM staff
        UNION ALL SELECT doc_id, k, 2, CASE WHEN k % 2 = 0 THEN 'They lives at plot ' || k || ', Orchard Hill.'
          ELSE 'Notes for ' || email || ' mention ' || name || '.' END FROM staff)""",
    ),
    "seeded": (
        [],
        "SELECT doc_id, text || CASE doc_id % 8 "
        + " ".join(
            f"WHEN {i} THEN "
            + _fill(
                t,
                {
                    "n": person_name("doc_id"), "s": ssn("doc_id"), "k": "doc_id", "e": "lpad(doc_id::VARCHAR, 6, '0')",
                    "p": "(doc_id % 90 + 10)",
                },
            )
            for i, t in D.SEEDS_TEXT.items()
        )
        + " END AS text FROM documents",
    ),
    "questions": (
        ["staff"],
        "SELECT 'q' || k AS query_id, CASE k % 8 "
        + " ".join(f"WHEN {i} THEN {_fill(t, {'n': 'name'})}" for i, t in enumerate(D.QUESTIONS))
        + " END AS query_text FROM staff UNION ALL SELECT DISTINCT 'dept-' || department, "
        "'List every employee in the ' || department || ' department along with their SSN.' FROM staff",
    ),
    "kwq": (
        [],
        "SELECT 's' || s_suppkey AS query_id, 'Show the salary for K' || translate(" + padded("s_suppkey", 7) + ", '0123456789', 'abcdefghij') "
        "|| ', please!' AS query_text FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'Where is ' || lower(n_name) || ' located?' FROM nation "
        "UNION ALL SELECT 'r' || r_regionkey, 'Is the quantum-teleporter of ' || lower(r_name) || 'xyz stored on Mars?' FROM region",
    ),
    "audit": (
        [],
        f"""SELECT event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, {values_list(K.AUDIT_EVENTS)}[event_id % {len(K.AUDIT_EVENTS)} + 1] AS event_type,
        '{{"action": "' || event_type || '", "user": ' || user_id || '}}' AS details FROM events""",
    ),
    "cands": (["seeded"], f"SELECT * FROM ({recognizer_rows('seeded', 'doc_id', 'text')}) WHERE {person_filter()}"),
    "edges": (
        ["facts"],
        "SELECT subject AS source, object AS target, predicate, arg_min(doc_id, ord) AS doc_id, "
        "arg_min(source_sentence, ord) AS source_sentence, arg_min(namespace, ord) AS namespace, min(ord) AS ord FROM facts GROUP BY 1, 2, 3",
    ),
    "tedges": (
        ["tfacts"],
        "SELECT subject AS source, object AS target, predicate, arg_min(doc_id, ord) AS doc_id, "
        "arg_min(source_sentence, ord) AS source_sentence, arg_min(namespace, ord) AS namespace, min(ord) AS ord FROM tfacts GROUP BY 1, 2, 3",
    ),
    "ends": (
        ["facts"],
        "SELECT subject AS id, doc_id, namespace, classification, ord * 2 AS ord FROM facts UNION ALL SELECT object, doc_id, namespace, classification, ord * 2 + 1 FROM facts",
    ),
    "nodes": (
        ["ends"],
        "SELECT id, arg_min(namespace, ord) AS namespace, arg_min(classification, ord) AS classification FROM ends GROUP BY id",
    ),
    "tends": (
        ["tfacts"],
        "SELECT subject AS id, namespace, ord * 2 AS ord FROM tfacts UNION ALL SELECT object, namespace, ord * 2 + 1 FROM tfacts",
    ),
    "tnodes": (["tends"], "SELECT id, arg_min(namespace, ord) AS namespace FROM tends GROUP BY id"),
}


def adjacency(edges: str) -> str:
    hubs = ", ".join(q(h) for h in K.HUB_PREDICATES)
    return (
        f"SELECT DISTINCT source AS node, target AS neighbour FROM {edges} UNION "
        f"SELECT target, source FROM {edges} GROUP BY source, target HAVING NOT bool_or(predicate IN ({hubs}))"
    )


CTE["adj"] = (["edges"], adjacency("edges"))
CTE["tadj"] = (["tedges"], adjacency("tedges"))


def sql(names: list[str], body: str, extra: str = "") -> str:
    """``WITH`` every needed building block, then ``extra`` CTEs, then the body."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in CTE[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    blocks = [f"{n} AS MATERIALIZED ({CTE[n][1]})" for n in order] + ([extra] if extra else [])
    return (f"WITH RECURSIVE {', '.join(blocks)} " if blocks else "") + body
