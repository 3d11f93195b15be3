"""Subject-predicate-object triples from tokenized sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokengraph.functions import constants as K
from tokengraph.functions.ordered import carry_forward
from tokengraph.functions.text import literal_pairs, py_trim, strip_chars
from tokengraph.operators.composite import let
from tokengraph.operators.tokens import find_tokens
from tokengraph.session import cut

TRIPLE_TYPE = "array<struct<subject:string,predicate:string,object:string>>"
# What a clause says before its subject is known: own = token before the verb, objects = tokens after it.
CLAUSE_TYPE = "struct<verb:string,predicate:string,own:string,objects:array<string>,literal:string>"


def clauses(sentence: Column) -> Column:
    return F.transform(F.split(sentence, K.CLAUSE_PATTERN), py_trim)


def _position(part: Column, text: Column) -> Column:
    return F.call_function("locate", part, text)


def verb_phrase(low: Column, match: str = "word") -> Column:
    """Struct (phrase, predicate, pos) of the first phrase of the priority list contained in a lower-case clause.

    ``word`` asks for word boundaries, so that "are" is not found in "software" and "is a" not in "is an";
    ``substring`` is the plain containment test.
    """
    phrases = literal_pairs(list(K.VERB_PREDICATES.items()))
    if match == "substring":
        hay, pad = low, F.lit("")
    elif match == "word":
        # Same length as the clause, every non-word character a blank, one blank added on each side.
        hay, pad = F.concat(F.lit(" "), F.regexp_replace(low, r"(?U)[^\w]", " "), F.lit(" ")), F.lit(" ")
    else:
        raise ValueError(f"unknown match rule {match!r}")

    def pick(text: Column) -> Column:
        hit = F.get(F.filter(phrases, lambda p: F.contains(text, F.concat(pad, p["k"], pad))), F.lit(0))
        return let(
            hit,
            lambda h: F.when(
                h.isNotNull(),
                F.struct(
                    h["k"].alias("phrase"),
                    h["v"].alias("predicate"),
                    _position(F.concat(pad, h["k"], pad), text).alias("pos"),
                ),
            ),
        )

    return let(hay, pick)


def clause_fact(clause: Column, match: str = "word") -> Column:
    """Parse one trimmed clause into ``CLAUSE_TYPE``; null when it holds no verb phrase."""

    def build(v: Column) -> Column:
        tokens = find_tokens(clause)
        after = F.substring(clause, v["pos"] + F.length(v["phrase"]), F.length(clause))
        rest = strip_chars(py_trim(after), ".!?,")
        plain = py_trim(F.regexp_replace(rest, r"(?i)\s+department\b", ""))
        literal = F.when(v["predicate"] == "HAS_ADDRESS", rest).otherwise(plain)
        return F.when(
            v.isNotNull(),
            F.struct(
                v["phrase"].alias("verb"),
                v["predicate"].alias("predicate"),
                F.get(F.filter(tokens, lambda t: _position(t, clause) < v["pos"]), F.lit(0)).alias("own"),
                F.filter(tokens, lambda t: _position(t, clause) > v["pos"]).alias("objects"),
                F.nullif(literal, F.lit("")).alias("literal"),
            ),
        )

    return let(verb_phrase(F.lower(clause), match), build)


def _clause_triples(c: Column, subject: Column) -> Column:
    """Triples of one parsed clause for a given subject."""

    def triple(o: Column) -> Column:
        return F.struct(subject.alias("subject"), c["predicate"].alias("predicate"), o.alias("object"))

    text_object = F.when(c["literal"].isNotNull(), F.array(triple(c["literal"]))).otherwise(F.array().cast(TRIPLE_TYPE))
    linked = F.transform(F.filter(c["objects"], lambda o: o != subject), triple)
    return (
        F.when(c.isNull() | subject.isNull(), F.array().cast(TRIPLE_TYPE))
        .when((c["predicate"] == "HAS_ADDRESS") | (F.size(c["objects"]) == 0), text_object)
        .otherwise(linked)
    )


def retention_triples(sentence: Column) -> Column:
    """Retention terms for every executive role and every token named in the sentence."""
    low = F.lower(sentence)
    terms = py_trim(F.regexp_extract(sentence, K.RETENTION_PATTERN, 1))
    terms = F.when(
        low.contains("deal close") & ~F.lower(terms).contains("deal close"), F.concat(terms, F.lit(" upon deal close"))
    ).otherwise(terms)
    roles = [
        F.when(low.contains(words) | low.rlike(rf"\b{role.lower()}\b"), F.lit(role)) for role, words in K.RETENTION_ROLES
    ]
    named = F.concat(F.array_compact(F.array(*roles)), find_tokens(sentence))
    built = let(
        terms,
        lambda v: F.transform(
            named,
            lambda s: F.struct(s.alias("subject"), F.lit("HAS_RETENTION_BONUS").alias("predicate"), v.alias("object")),
        ),
    )
    applies = (low.contains("retention bonus") | low.contains("retention package")) & sentence.rlike(K.RETENTION_PATTERN)
    return F.when(applies, built).otherwise(F.array().cast(TRIPLE_TYPE))


def starts_with_pronoun(sentence: Column) -> Column:
    return F.lower(py_trim(sentence)).rlike(f"^(?:{'|'.join(K.PRONOUNS)})[ ,]")


def _sentence_triples(parsed: Column, whole: Column, tokens: Column, retention: Column, effective: Column) -> Column:
    """Clause triples, else the whole-sentence verb scan, then retention, then the proximity fallbacks."""
    by_clause = F.flatten(F.transform(parsed, lambda c: _clause_triples(c, F.coalesce(c["own"], effective))))

    def second(found: Column) -> Column:
        scan = F.when((F.size(found) == 0) & effective.isNotNull(), _clause_triples(whole, effective)).otherwise(found)
        return F.concat(scan, retention)

    def third(found: Column) -> Column:
        hub = F.transform(
            F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))),
            lambda o: F.struct(
                F.get(tokens, F.lit(0)).alias("subject"), F.lit("RELATED_TO").alias("predicate"), o.alias("object")
            ),
        )
        lone = F.when(
            (F.size(tokens) == 1) & (effective != F.get(tokens, F.lit(0))),
            F.array(
                F.struct(
                    effective.alias("subject"),
                    F.lit("RELATED_TO").alias("predicate"),
                    F.get(tokens, F.lit(0)).alias("object"),
                )
            ),
        ).otherwise(F.array().cast(TRIPLE_TYPE))
        return F.when(F.size(found) > 0, found).when(F.size(tokens) >= 2, hub).otherwise(lone)

    return let(let(by_clause, second), third)


def parse_sentences(sentences: DataFrame, text: str = "text", match: str = "word") -> DataFrame:
    """Add the per-sentence parse (tokens, pronoun flag, clauses, whole-sentence scan, retention triples)."""
    s = F.col(text)
    staged = sentences.withColumn("_tokens", find_tokens(s)).withColumn("_pronoun", starts_with_pronoun(s))
    relevant = (F.size("_tokens") > 0) | F.col("_pronoun")
    return (
        staged.withColumn(
            "_clauses",
            F.when(relevant, F.transform(clauses(s), lambda c: clause_fact(c, match))).otherwise(
                F.array().cast(f"array<{CLAUSE_TYPE}>")
            ),
        )
        .withColumn("_whole", F.when(relevant, clause_fact(py_trim(s), match)))
        .withColumn("_retention", retention_triples(s))
    )


def carried_subjects(parsed: DataFrame, doc: str = "doc_id", order: str = "sent_idx") -> DataFrame:
    """Add ``prev_subject``: the first triple's subject of the latest earlier sentence that gave triples.

    A sentence that opens with a pronoun passes the carried subject on unless it names one itself, so each sentence
    is a constant or a pass-through; carrying is then a last-non-null scan per document, done block-wise.
    """
    first_token = F.get("_tokens", F.lit(0))
    own = _sentence_triples(
        F.col("_clauses"), F.col("_whole"), F.col("_tokens"), F.col("_retention"), first_token
    )
    lead = parsed.withColumn("_alone", F.get(own, F.lit(0))["subject"])

    # The subject a pronoun sentence sets for itself: its first productive clause has a token before the verb.
    productive = F.filter(
        F.col("_clauses"),
        lambda c: c.isNotNull()
        & F.when(
            (c["predicate"] == "HAS_ADDRESS") | (F.size(c["objects"]) == 0), c["literal"].isNotNull()
        ).otherwise(F.exists(c["objects"], lambda o: c["own"].isNull() | (o != c["own"]))),
    )
    whole = F.col("_whole")
    scan = whole.isNotNull() & (
        whole["literal"].isNotNull() | ((whole["predicate"] != "HAS_ADDRESS") & (F.size(whole["objects"]) > 0))
    )
    head = F.get(productive, F.lit(0))
    fallback = F.when(F.size("_retention") > 0, F.get("_retention", F.lit(0))["subject"]).when(
        F.size("_tokens") >= 2, first_token
    )
    named = F.when(head.isNotNull(), head["own"]).when(~F.coalesce(scan, F.lit(False)), fallback)
    lead = lead.withColumn("_named", F.when(F.col("_pronoun"), named).otherwise(F.col("_alone")))
    # A sentence that names a subject after a pronoun names it without one too, so the last named subject, else the
    # first subject of the document, is what the next sentence sees.
    # The carry reads the parse for its windows and for its summaries: stored, every sentence is parsed once.
    return carry_forward(cut(lead), [doc], order, "_named", "prev_subject", first_of="_alone").drop("_alone", "_named")


def extract_triples(
    sentences: DataFrame,
    doc: str = "doc_id",
    order: str = "sent_idx",
    text: str = "text",
    *,
    coreference: bool = True,
    match: str = "word",
) -> DataFrame:
    """(doc, sent_idx, triple_idx, subject, predicate, object, source_sentence) from tokenized sentences."""
    parsed = parse_sentences(sentences, text, match)
    if coreference:
        parsed = carried_subjects(parsed, doc, order)
    else:
        parsed = parsed.withColumn("prev_subject", F.lit(None).cast("string"))
    effective = F.when(F.col("_pronoun") & F.col("prev_subject").isNotNull(), F.col("prev_subject")).otherwise(
        F.get("_tokens", F.lit(0))
    )
    triples = _sentence_triples(
        F.col("_clauses"), F.col("_whole"), F.col("_tokens"), F.col("_retention"), F.col("_effective")
    )
    rows = parsed.withColumn("_effective", effective).select(
        doc, order, F.col(text).alias("source_sentence"), F.posexplode_outer(triples).alias("triple_idx", "_t")
    )
    return rows.filter(F.col("_t").isNotNull()).select(doc, order, "triple_idx", "_t.*", "source_sentence")


def triple_counts(triples: DataFrame, doc: str = "doc_id") -> DataFrame:
    return triples.groupBy(doc).agg(F.count("*").alias("triple_count"))
