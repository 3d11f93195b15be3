"""The two end-to-end flows composed from the operators: documents to stores, questions to answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokengraph.functions import constants as K
from tokengraph.functions.hashing import TokenKey
from tokengraph.functions.ordered import number_rows
from tokengraph.functions.text import py_trim
from tokengraph.operators import answer as A
from tokengraph.operators import detect as DT
from tokengraph.operators import graph as G
from tokengraph.operators import guard, registry, segment, tables, tokens, triples
from tokengraph.operators import retrieve as R
from tokengraph.operators import vault as V
from tokengraph.operators.audit import append_events, json_string
from tokengraph.operators.composite import header_predicate
from tokengraph.session import cut
from tokengraph.sources import documents as SD
from tokengraph.sources.live import LiveStore
from tokengraph.sources.many_tables import content_heads, read_tables


@dataclass
class Ingested:
    """Tables made from one batch of documents; ``vault`` is sealed, everything else holds tokens only."""

    rejects: DataFrame
    sentences: DataFrame
    vault: DataFrame
    references: DataFrame
    triples: DataFrame
    edges: DataFrame
    nodes: DataFrame
    node_docs: DataFrame
    registry: DataFrame
    entities: DataFrame


def document_sentences(docs: DataFrame, department: str | None = None, strip_headings: bool = True, parts: str | None = None) -> DataFrame:
    """(doc_id, sent_idx, text) of (doc_id, body): prose sentences, then one sentence per table fact; places count from 0 per document.

    ``parts`` names a column that orders several bodies of one document. ``department`` names a column that rows of a
    table belong to when they state none.
    """
    base = docs.select("doc_id", "body", (F.col(parts) if parts else F.lit(0)).alias("part"), (F.col(department) if department else F.lit(None).cast("string")).alias("department"))
    spans = base.withColumn("_key", F.struct("doc_id", "part", "department"))
    prose = segment.split_sentences(spans.select("_key", segment.without_tables(F.col("body")).alias("body")), "_key", "body", strip_headings)
    rows = segment.table_rows(spans, "_key", "body").filter("row_idx > 0").select("_key.*", "table_idx", "row_idx", "cells", "headers")
    key = ["doc_id", "part", "department", "table_idx", "row_idx"]
    facts = tables.expand_facts(tables.unpivot_rows(rows, key), key)
    worded = tables.row_sentences(facts, ["doc_id", "part", "table_idx", "row_idx"], "department" if department else None)
    zero = F.lit(0)
    placed = prose.select("_key.doc_id", "text", zero.alias("kind"), F.col("_key.part").alias("part"), zero.alias("t"), zero.alias("r"), F.col("sent_idx").alias("c"), zero.alias("p")).unionByName(
        worded.select("doc_id", "text", F.lit(1).alias("kind"), "part", F.col("table_idx").alias("t"), F.col("row_idx").alias("r"), F.col("col_idx").alias("c"), F.col("part_idx").alias("p"))
    )
    return number_rows(placed, ["kind", "part", "t", "r", "c", "p"], "sent_idx", ["doc_id"]).select("doc_id", "sent_idx", "text")


@dataclass
class Prepared:
    """What the sources make of their files: documents with settings, their sentences with known spans, and what was refused.

    ``docs``: doc_id, title, classification, department, author, created, namespace, categories, min_confidence.
    """

    docs: DataFrame
    sentences: DataFrame
    rejects: DataFrame


def prepare_documents(files: DataFrame) -> Prepared:
    """Header + body files (path, content)."""
    good, rejects = SD.parse_documents(files)
    h = F.col("header")
    docs = cut(
        good.select(
            h["id"].alias("doc_id"), "body", h["title"].alias("title"), h["classification"].alias("classification"), h["department"].alias("department"),
            h["author"].alias("author"), F.try_to_date(h["created"]).alias("created"), h["namespace"].alias("namespace"),
            DT.resolve_categories(h["entity_categories"]).alias("categories"), h["min_confidence"].alias("min_confidence"),
        )
    )
    return Prepared(docs.drop("body"), _unhinted(document_sentences(docs)), rejects)


def _unhinted(sentences: DataFrame) -> DataFrame:
    return sentences.withColumn("hints", F.lit(None).cast("array<struct<start:int,end:int,entity_type:string>>"))


# What is looked for in files that bring no settings of their own.
DEFAULT_CATEGORIES = ["PERSON", "EMAIL", "PHONE", "SSN", "SALARY", "LOCATION", "ORGANIZATION", "CREDIT_CARD"]


def _settings() -> list[Column]:
    return [DT.resolve_categories(F.array(*[F.lit(c) for c in DEFAULT_CATEGORIES])).alias("categories"), F.lit(K.DEFAULT_MIN_CONFIDENCE).alias("min_confidence")]


def prepare_tables(spark: SparkSession, path: str, department: str | None = None, author: str | None = None, classification: str | None = None) -> Prepared:
    """Delimited tables below ``path``: a document per file, a sentence per fact, spans typed by their columns.

    A column's type comes from its header and its first rows; facts unpacked from a composite cell bring their own.
    """
    rows, rejects = read_tables(spark, path)
    rows = cut(rows)
    name = F.regexp_replace(F.coalesce(F.try_url_decode("path"), "path"), r"^.*/", "")
    docs = cut(
        content_heads(spark, path).join(rows.filter("row_idx = 0").select("path"), "path").select(
            "path", SD.document_id("CSV", name, F.col("head")).alias("doc_id"), SD.title_from_name(name).alias("title"),
            SD.resolve_classification(F.lit(classification)).alias("classification"), SD.resolve_department(F.lit(department)).alias("department"),
            SD.resolve_author(F.lit(author), F.lit(None).cast("string")).alias("author"), F.current_date().alias("created"), SD.namespace("csv", name).alias("namespace"), *_settings(),
        )
    )
    kinds = tables.column_types(rows, ["path"], K.SAMPLE_ROWS).withColumn("predicate", header_predicate(F.col("header")))
    # A row per table, as long as its header; of columns with one predicate the last one's type holds.
    last = kinds.filter("col_idx > 0 AND entity_type IS NOT NULL").groupBy("path", "predicate").agg(F.max_by("entity_type", "col_idx").alias("t"))
    typed = last.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("predicate", "t"))).alias("types"))
    subject = kinds.filter("col_idx = 0").select("path", F.col("entity_type").alias("subject_type"))
    info = docs.select("path", "doc_id").join(typed, "path", "left").join(subject, "path", "left")
    key = ["doc_id", "row_idx", "types", "subject_type"]
    facts = tables.expand_facts(tables.unpivot_rows(rows.join(info, "path"), key), key)
    text = tables.fact_sentence(F.col("subject"), F.col("predicate"), F.col("value"))
    kind = F.when(F.col("composite"), F.col("fact_type")).otherwise(F.try_element_at("types", F.col("predicate")))
    worded = facts.withColumn("text", text).select(
        "doc_id", "row_idx", "col_idx", "part_idx", "text", tables.typed_spans(F.col("text"), F.col("subject"), F.col("value"), F.col("subject_type"), kind).alias("hints")
    )
    placed = cut(number_rows(worded, ["row_idx", "col_idx", "part_idx"], "sent_idx", ["doc_id"]).select("doc_id", "sent_idx", "text", "hints"))
    return Prepared(docs.drop("path"), placed, rejects.select("path", F.array("reason").alias("reasons")))


def prepare_pages(pages: DataFrame) -> Prepared:
    """Page texts (path, page, text, title, author, creation_date): a document per path, tables of a roster page bound to its department."""
    first = pages.groupBy("path").agg(
        F.min_by(F.struct("text", "title", "author", "creation_date"), "page").alias("f"), F.max(F.trim(F.coalesce("text", F.lit(""))) != "").alias("filled")
    )
    name = F.regexp_replace("path", r"^.*/", "")
    nothing = F.lit(None).cast("string")
    docs = cut(
        first.filter("filled").select(
            "path", SD.document_id("PDF", name, F.encode(F.coalesce("f.text", F.lit("")), "UTF-8")).alias("doc_id"),
            SD.resolve_title(nothing, F.col("f.title"), py_trim(F.coalesce("f.text", F.lit(""))), name).alias("title"), SD.resolve_classification(nothing).alias("classification"),
            SD.resolve_department(nothing).alias("department"), SD.resolve_author(nothing, F.col("f.author")).alias("author"),
            SD.resolve_date(F.col("f.creation_date")).alias("created"), SD.namespace("pdf", name).alias("namespace"), *_settings(),
        )
    )
    bodies = pages.join(docs.select("path", "doc_id"), "path").select("doc_id", "page", F.col("text").alias("body"), SD.page_department(F.col("text")).alias("section"))
    sentences = document_sentences(bodies, "section", strip_headings=False, parts="page")
    rejects = first.filter("NOT filled").select("path", F.array(F.lit("no text")).alias("reasons"))
    return Prepared(docs.drop("path"), cut(_unhinted(sentences)), rejects)


def ingest_documents(
    files: DataFrame | Prepared, key: TokenKey, vault_key: bytes, edge_limit: int | None = K.EDGE_LIMIT, stored: DataFrame | Callable[[DataFrame], DataFrame] | None = None
) -> Ingested:
    """Header + body files (path, content), or what ``prepare_tables`` or ``prepare_pages`` made, to vault, graph and registry.

    ``stored`` is the sealed vault so far, or gives the part of it that may clash with some entities: its tokens stay as
    they are, and new values whose token would clash with one of them, or with each other, get longer tokens before any
    text is rewritten.

    The tokenized sentences are materialised once; vault, triples and counts all read that table. With ``edge_limit``
    the graph is checked before anything is returned for publishing.
    """
    ready = files if isinstance(files, Prepared) else prepare_documents(files)
    docs, rejects = ready.docs, ready.rejects
    meta = docs.select("doc_id", "categories", "min_confidence")
    found = DT.detect(ready.sentences.join(meta, "doc_id"), categories="categories", min_confidence="min_confidence", hints="hints")
    place = ["doc_id", "sent_idx"]
    raw = cut(tokens.tokenize(found, key).select(*place, "text", "entities", "tokenized"))
    seen = DT.explode_entities(raw, *place)
    changed = cut(tokens.lengthened(tokens.token_dictionary(seen, stored(seen) if callable(stored) else stored)))
    done = cut(tokens.settle(raw, changed, place).select(*place, "entities", F.col("tokenized").alias("text")))

    # A total order over all entities and triples: documents by id, then sentence, then position.
    ents = DT.explode_entities(done, "doc_id", "sent_idx").withColumn("ord", F.struct("doc_id", "sent_idx", "entity_idx"))
    found_triples = cut(triples.extract_triples(done.select("doc_id", "sent_idx", "text")))
    owned = found_triples.join(docs.select("doc_id", "namespace", "classification"), "doc_id").withColumn(
        "ord", F.struct("doc_id", "sent_idx", "triple_idx")
    )
    edges = cut(G.edges_from(owned))
    if edge_limit is not None:
        G.check_breaker(edges, edge_limit)
    reg = registry.register(
        docs.select("doc_id", "title", "classification", "department", "author", "created", F.lit(0).alias("ord")),
        DT.entity_counts(done, "doc_id"),
        triples.triple_counts(found_triples),
    )
    return Ingested(
        rejects=rejects,
        sentences=done.select("doc_id", "sent_idx", "text"),
        vault=V.seal(V.upsert(ents), vault_key),
        references=V.references(ents),
        triples=owned,
        edges=edges,
        nodes=G.nodes_from(edges.withColumnsRenamed({"source": "subject", "target": "object"})),
        node_docs=G.node_documents(owned),
        registry=reg,
        entities=ents,
    )


def ingested_events(registered: DataFrame) -> DataFrame:
    """(seq, ts, event_type, details) of one DOCUMENT_INGESTED event per registry row, in order of the document id.

    Details are JSON with sorted keys and spaces after separators, the form that entry hashes are taken of.
    """
    numbered = number_rows(registered.select("doc_id", "title", "entity_count", "triple_count"), ["doc_id"], "seq")
    details = F.concat(
        F.lit('{"doc_id": '), json_string(F.col("doc_id")), F.lit(', "entities_detected": '), F.col("entity_count").cast("string"),
        F.lit(', "title": '), json_string(F.col("title")), F.lit(', "triples_extracted": '), F.col("triple_count").cast("string"), F.lit("}"),
    )
    return numbered.select("seq", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), F.lit("DOCUMENT_INGESTED").alias("event_type"), details.alias("details"))


def append_audit(store: LiveStore, events: DataFrame) -> tuple[DataFrame, list[int]]:
    """New content of the buckets of the log that ``events`` (seq from 0 on) are appended to; only its last bucket is read."""
    held = [b for n, b in store.buckets_of() if n == "audit"]
    open_end = store.read("audit", [max(held)]) if held else store.read("audit", [])
    fresh = cut(append_events(open_end, events))
    buckets = store.touched("audit", fresh)
    return store.read("audit", buckets).unionByName(fresh), buckets


def ingest_batch(store: LiveStore, files: DataFrame | Prepared, key: TokenKey, vault_key: bytes, batch: int, edge_limit: int | None = K.EDGE_LIMIT) -> Ingested | None:
    """One batch of files into all stores, published together; None if the pointer names this batch or a later one.

    Stored rows stay the first writers of tokens, edges and nodes. Of every table only the buckets that the batch touches
    are read and written. The breaker counts stored and new edges; when it trips, nothing is published.
    """
    if store.pointer()[1] >= batch:
        return None
    made = ingest_documents(files, key, vault_key, None, stored=lambda seen: store.read("vault", store.touched("vault", seen)))
    ents, node_docs = cut(made.entities), cut(made.node_docs)
    changed: dict[str, tuple[DataFrame, list[int]]] = {}

    def old(name: str, rows: DataFrame) -> tuple[DataFrame, list[int]]:
        buckets = store.touched(name, rows)
        return store.read(name, buckets), buckets

    def add(name: str, rows: DataFrame, keys: list[str]) -> None:
        kept, buckets = old(name, rows)
        changed[name] = (kept.unionByName(rows.join(kept, keys, "left_anti").select(*kept.columns)), buckets)

    kept, buckets = old("vault", ents)
    changed["vault"] = (V.merge(kept, ents, vault_key), buckets)
    add("references", V.references(ents), ["token", "doc_id"])
    add("node_docs", node_docs, ["id", "doc_id"])

    ends = ["source", "target", "predicate"]
    edges = made.edges.withColumn("ord", F.struct(F.lit(batch).cast("bigint").alias("batch"), "ord.doc_id", "ord.sent_idx", "ord.triple_idx"))
    kept, buckets = old("edges", edges)
    added = cut(edges.join(kept, ends, "left_anti").select(*kept.columns))
    changed["edges"] = (kept.unionByName(added), buckets)
    sides = added.select(F.explode(F.array("source", "target")).alias("id"))
    kept, buckets = old("degrees", sides)
    if edge_limit is not None:
        G.check_breaker(added, edge_limit, kept)
    changed["degrees"] = (G.add_degrees(kept, added), buckets)
    add("nodes", G.nodes_from(added.withColumnsRenamed({"source": "subject", "target": "object"})), ["id"])

    registered = cut(made.registry)
    kept, buckets = old("registry", registered)
    changed["registry"] = (registry.upsert_registry(kept, registered).select(*kept.columns), buckets)
    changed["audit"] = append_audit(store, ingested_events(registered))
    add("rejects", cut(made.rejects.withColumn("batch", F.lit(batch).cast("bigint"))), ["path", "batch"])
    store.commit(batch, changed)
    return made


def delete_from_store(store: LiveStore, doc_ids: DataFrame) -> DataFrame:
    """Take documents out of all stores, and return (metric, value) counts; a DOCUMENT_DELETED event goes to the log.

    Edges, node documents, tokens and registry rows are found by their document; a node goes when its stored degree falls
    to zero and no document is left for it, so no other edge has to be read. Only buckets with something to remove are
    written.
    """
    gone = cut(doc_ids.select("doc_id").distinct())
    changed: dict[str, tuple[DataFrame, list[int]]] = {}
    counts = []

    def leave(name: str, dead: DataFrame, keys: list[str]) -> DataFrame:
        buckets = store.touched(name, dead)
        kept = store.read(name, buckets).join(dead.select(*keys).distinct(), keys, "left_anti").select(*store.read(name, []).columns)
        changed[name] = (kept, buckets)
        return kept

    edges = cut(store.read("edges").join(gone, "doc_id", "left_semi").select(*store.read("edges", []).columns))
    docs = cut(store.read("node_docs").join(gone, "doc_id", "left_semi").select("id", "doc_id"))
    tokens_gone = cut(store.read("vault").join(gone, F.col("first_doc_id") == F.col("doc_id"), "left_semi").select("token", "entity_type", "hmac_digest"))
    leave("edges", edges, ["source", "target", "predicate"])
    leave("vault", tokens_gone, ["token"])
    leave("references", cut(store.read("references").join(gone, "doc_id", "left_semi")), ["token", "doc_id"])
    registered = cut(store.read("registry").join(gone, "doc_id", "left_semi"))
    leave("registry", registered, ["doc_id"])
    leave("node_docs", docs, ["id", "doc_id"])

    ends = cut(docs.select("id").unionByName(edges.select(F.explode(F.array("source", "target")).alias("id"))).distinct())
    buckets = store.touched("degrees", ends)
    degrees = cut(G.add_degrees(store.read("degrees", buckets), edges, -1))
    changed["degrees"] = (degrees, buckets)
    left = store.read("node_docs").join(ends, "id", "left_semi").join(gone, "doc_id", "left_anti").select("id")
    dead = cut(ends.join(degrees, "id", "left_anti").join(left, "id", "left_anti").join(store.read("nodes", store.touched("nodes", ends)), "id", "left_semi"))
    leave("nodes", dead, ["id"])
    for metric, rows in (("documents_removed", registered), ("edges_removed", edges), ("nodes_removed", dead), ("tokens_purged", tokens_gone)):
        counts.append(rows.agg(F.count("*").alias("value")).select(F.lit(metric).alias("metric"), "value"))
    found = counts[0]
    for c in counts[1:]:
        found = found.unionByName(c)
    found = cut(found)
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    event = registry.deletion_event(found).select(F.lit(0).cast("bigint").alias("seq"), stamp.alias("ts"), "event_type", "details")
    changed["audit"] = append_audit(store, event)
    store.commit(store.pointer()[1], changed)
    return found


def answer_questions(queries: DataFrame, nodes: DataFrame, edges: DataFrame, vault: DataFrame, key: TokenKey, vault_key: bytes) -> tuple[DataFrame, DataFrame]:
    """(answers, blocked audit rows) for (query_id, query_text); answers carry plain values again."""
    prepared = R.prepare_queries(queries, key, changed=tokens.lengthened(vault))
    _, reached, subgraph = R.retrieve(prepared, nodes, edges)
    sub = cut(subgraph)
    unsafe = cut(guard.unsafe_queries(R.build_context(reached, sub)))
    allowed, blocked = guard.block_queries(prepared, unsafe)
    said = cut(A.answer_queries(allowed, sub.join(unsafe, "query_id", "left_anti")))
    asked = said.select(F.explode(F.array_distinct(tokens.find_tokens(F.col("answer")))).alias("token"))
    # The question's own values are in the vault under "query"; add them for names that no document holds.
    own = V.upsert(R.query_vault_rows(prepared).withColumn("ord", F.xxhash64("query_id", "entity_idx"))).select("token", "value")
    known = V.lookup(asked, vault, vault_key)
    values = known.unionByName(own.join(known, "token", "left_anti"))
    keyed = said.withColumn("_row", F.concat_ws("|", "query_id", "route", F.col("chunk").cast("string")))
    plain = V.reconstruct(keyed, values, "_row", "answer", "plain")
    return plain.select("query_id", "route", "chunk", F.col("plain").alias("answer"), "n_reconstructed"), blocked
