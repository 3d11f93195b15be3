"""Retrieval for a whole table of questions at once: seeds, expansion, context, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokengraph.functions import constants as K
from tokengraph.functions.hashing import TokenKey
from tokengraph.functions.text import contains_any, first_word_hit, literal_array, strip_chars
from tokengraph.operators import graph as G
from tokengraph.operators import vault as V
from tokengraph.operators.detect import detect, explode_entities
from tokengraph.operators.facts import BlockFacts, block_facts
from tokengraph.operators.tokens import find_tokens, settle, tokenize
from tokengraph.session import cut


def prepare_queries(queries: DataFrame, key: TokenKey, store: bool = True, changed: DataFrame | None = None) -> DataFrame:
    """Add ``entities``, ``tokenized``, ``tokens``, ``keywords``, ``department``, ``depth`` to (query_id, query_text).

    The result is joined many times downstream, so it is materialised in the shared folder unless ``store`` is off.
    ``changed`` (hmac_digest, token) holds the lengthened tokens of the vault.
    """
    done = tokenize(detect(queries, "query_text"), key, "query_text")
    if changed is not None:
        done = settle(done, changed, ["query_id"], "query_text")
    low = F.lower("tokenized")
    ready = (
        done.withColumn("tokens", F.array_distinct(find_tokens(F.col("tokenized"))))
        .withColumn("keywords", keywords(F.col("tokenized")))
        .withColumn("department", department_named(low))
        .withColumn("depth", traversal_depth(low))
    )
    return cut(ready) if store else ready


def query_vault_rows(prepared: DataFrame) -> DataFrame:
    """Entities of the questions as vault input, owned by the pseudo document ``query``."""
    rows = explode_entities(prepared, "query_id")
    return rows.select("token", "entity_type", "value", "hmac_digest", F.lit("query").alias("doc_id"), "query_id", "entity_idx")


def keywords(query: Column) -> Column:
    """Lower-case words without stop words and short words; parts of hyphenated words are added."""
    stop = literal_array(K.STOP_WORDS)

    def wanted(w: Column) -> Column:
        return (F.length(w) > 2) & ~F.array_contains(stop, w)

    words = F.transform(F.split(F.lower(query), r"\s+"), lambda w: strip_chars(w, "?.!,;:'\""))
    base = F.filter(words, wanted)
    parts = F.flatten(
        F.transform(
            base,
            lambda w: F.when(F.contains(w, F.lit("-")), F.filter(F.split(w, "-"), wanted)).otherwise(
                F.array().cast("array<string>")
            ),
        )
    )
    return F.array_distinct(F.concat(base, parts))


def department_named(low: Column) -> Column:
    """First department of the list whose name occurs in a lower-case question."""
    return first_word_hit(low, [(d, d) for d in K.DEPARTMENTS])


def traversal_depth(low: Column, default: int = 3) -> Column:
    """One hop, or ``max(3, default)`` when the question asks about a hierarchy."""
    return F.when(contains_any(low, K.HIERARCHY_WORDS), F.lit(max(3, default))).otherwise(F.lit(1))


def _trigrams(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3))))


def match_nodes(words: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (query_id, node) where the node id contains a keyword of the query, any case.

    ``words``: query_id, keyword (three characters or more). A node that contains a keyword contains each of its
    trigrams, so words meet nodes by an equi-join on the keyword's rarest trigram and containment is checked after;
    no query is compared with every node. Words and their rarest trigrams are materialised: where they are few, as the
    planner then knows, the nodes' trigrams stay where they are.
    """
    low = F.lower("id")
    words = cut(words.select("query_id", "keyword"))
    grams = nodes.select("id", F.explode(F.when(F.length("id") >= 3, _trigrams(low)).otherwise(F.array().cast("array<string>"))).alias("gram"))
    kws = words.select("keyword").distinct()
    kw_grams = kws.select("keyword", F.explode(_trigrams(F.col("keyword"))).alias("gram"))
    asked = kw_grams.select("gram").distinct()
    frequency = grams.join(asked, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    anchor = cut(
        kw_grams.join(frequency, "gram", "left")
        .groupBy("keyword")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("a"))
        .select("keyword", "a.gram")
    )
    hits = grams.join(anchor, "gram").filter(F.contains(low, F.col("keyword"))).select("keyword", F.col("id").alias("node"))
    return words.join(hits, "keyword").select("query_id", "node").distinct()


def department_members(edges: DataFrame) -> DataFrame:
    """Distinct (department, node) for subjects of IN_DEPARTMENT edges, per listed department the object names."""
    names = literal_array(K.DEPARTMENTS)
    return (
        edges.filter(F.col("predicate") == "IN_DEPARTMENT")
        .select(
            F.col("source").alias("node"),
            F.explode(F.filter(names, lambda d: F.contains(F.lower(F.col("target")), d))).alias("department"),
        )
        .distinct()
    )


def find_seeds(prepared: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (query_id, depth, node): named tokens, limited to or replaced by a department, else keyword matches."""
    members = cut(department_members(edges))  # read three times
    active = members.select("department").distinct().withColumn("_active", F.lit(True))
    q = prepared.select("query_id", "tokens", "keywords", "department", "depth").join(active, "department", "left")
    named = q.select("query_id", "depth", "department", "_active", F.explode("tokens").alias("node"))
    free = named.filter(F.col("_active").isNull()).select("query_id", "depth", "node")
    inside = named.filter(F.col("_active")).join(members, ["department", "node"], "left_semi").select("query_id", "depth", "node")
    roster = (
        q.filter(F.col("_active") & (F.size("tokens") == 0)).select("query_id", "depth", "department")
        .join(members, "department").select("query_id", "depth", "node")
    )
    direct = free.unionByName(inside).unionByName(roster)
    left = q.join(direct.select("query_id").distinct(), "query_id", "left_anti")
    words = left.select("query_id", F.explode("keywords").alias("keyword"))
    matched = match_nodes(words, nodes).join(q.select("query_id", "depth"), "query_id").select("query_id", "depth", "node")
    return direct.unionByName(matched).distinct()


def retrieve(prepared: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = 3, carry: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(seeds, reached nodes with their namespace per query, subgraph edges per query); each node and edge once per query.

    Every distinct seed is walked once, however many questions name it or list its department; the questions join last.
    ``carry`` names columns of the edges that the subgraph keeps beside its own.
    """
    seeds = cut(find_seeds(prepared, nodes, edges))
    done = G.walk_graph(edges, nodes, seeds, max_depth)
    reached = G.reached_by(seeds, done, ["query_id"], "depth", nodes).select("query_id", "node", "namespace")
    return seeds, reached, G.induced_by(seeds, done, edges, ["query_id"], "depth", carry=carry)


def retrieve_facts(prepared: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = 3, store: bool = True) -> BlockFacts:
    """The subgraph edges of ``retrieve`` as facts that are kept per block of seeds and not per question."""
    seeds = cut(find_seeds(prepared, nodes, edges))
    return block_facts(seeds, G.walk_graph(edges, nodes, seeds, max_depth), edges, "depth", store)


def unmatched(prepared: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, context) with the fixed message for questions without any seed."""
    return prepared.join(seeds, "query_id", "left_anti").select("query_id", F.lit(K.NO_MATCH_CONTEXT).alias("context"))


def build_context(reached: DataFrame, subgraph: DataFrame, ordered: bool = True) -> DataFrame:
    """Context lines (query_id, section, line[, ord]) of every matched question, from what ``retrieve`` gives.

    Lines come with their place unless ``ordered`` is off, for those that count or list them: their rows then stay where
    they are.
    """
    return (G.context_lines if ordered else G.unordered_lines)(reached, subgraph, ["query_id"])


def citations(subgraph: DataFrame, once: bool = False) -> DataFrame:
    """One row per (query_id, doc_id, predicate, source, target) with the sentence it came from.

    ``once`` says that the subgraph names an edge once per query, as that of ``retrieve`` does: no row is exchanged.
    """
    spoken = F.when(F.col("source_sentence") != "", F.col("source_sentence"))
    fallback = F.concat("source", F.lit(" --["), "predicate", F.lit("]--> "), "target")
    told = subgraph.filter(F.col("doc_id").isNotNull() & (F.col("doc_id") != ""))
    if once:
        return told.select("query_id", "doc_id", "predicate", "source", "target", "ord", F.coalesce(spoken, fallback).alias("snippet"))
    return (
        told.groupBy("query_id", "doc_id", "predicate", "source", "target")
        .agg(F.min(F.struct("ord", F.coalesce(spoken, fallback).alias("snippet"))).alias("_f"))
        .select("query_id", "doc_id", "predicate", "source", "target", "_f.ord", "_f.snippet")
    )


def enrich_citations(cites: DataFrame, registry: DataFrame, values: DataFrame) -> DataFrame:
    """Add title, department and classification from the registry, and the snippet with tokens swapped back."""
    meta = registry.select(
        "doc_id", F.col("title").alias("_t"), F.col("department").alias("_d"), F.col("classification").alias("_c")
    )
    stem = F.initcap(F.replace(F.regexp_replace("doc_id", r"\.[^.]+$", ""), F.lit("_"), F.lit(" ")))
    joined = cites.join(meta, "doc_id", "left").select(
        *cites.columns,
        F.coalesce("_t", stem).alias("title"),
        F.coalesce("_d", F.lit("General")).alias("department"),
        F.coalesce("_c", F.lit("INTERNAL")).alias("classification"),
    )
    # A sentence is cited by many questions: restore each distinct snippet once.
    snippets = joined.select("snippet").distinct()
    restored = V.reconstruct(snippets, values, "snippet", "snippet", "_plain").select("snippet", "_plain")
    return joined.join(restored, "snippet").withColumn("snippet", F.col("_plain")).drop("_plain")


def citations_per_document(cites: DataFrame) -> DataFrame:
    """The last citation of each document in a question."""
    rest = [c for c in cites.columns if c not in ("query_id", "doc_id", "ord")]
    return (
        cites.groupBy("query_id", "doc_id")
        .agg(F.max(F.struct("ord", *rest)).alias("_l"))
        .select("query_id", "doc_id", *[f"_l.{c}" for c in rest])
    )
