"""Edge and node tables of a directed multigraph, bounded traversal, serialisation, deletion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokengraph.functions import constants as K
from tokengraph.functions.ordered import chunked_in_place, chunked_text, nth_per_group
from tokengraph.operators.tokens import token_type
from tokengraph.operators.traverse import Walk, walk
from tokengraph.session import cut

EDGE_COLUMNS = ["source", "target", "predicate", "source_sentence", "doc_id", "namespace", "classification", "ord"]


def edges_from(triples: DataFrame) -> DataFrame:
    """Unique (source, target, predicate) edges with the provenance of the first assertion.

    ``triples``: subject, predicate, object, source_sentence, doc_id, namespace, classification, ord; ``ord`` is a
    number or a struct that orders all assertions, for example (doc_id, sent_idx, triple_idx). The minimum of
    a struct combines map-side, so an edge asserted by very many documents reaches the shuffle once per task.
    """
    first = F.min(F.struct("ord", "doc_id", "source_sentence", "namespace", "classification")).alias("_f")
    return (
        triples.groupBy(F.col("subject").alias("source"), F.col("object").alias("target"), "predicate")
        .agg(first)
        .select(
            "source",
            "target",
            "predicate",
            "_f.source_sentence",
            "_f.doc_id",
            "_f.namespace",
            "_f.classification",
            "_f.ord",
        )
    )


def number_edges(edges: DataFrame) -> DataFrame:
    """Unique edges with a number ``_edge``; store them before it is read twice, so that the numbers stay."""
    return edges.withColumn("_edge", F.monotonically_increasing_id())


def endpoints(triples: DataFrame) -> DataFrame:
    """(id, doc_id, namespace, classification, ord) for both ends of every triple, in one pass over the input."""
    side = F.explode(
        F.array(
            F.struct(F.col("subject").alias("id"), F.struct("ord", F.lit(0).alias("side")).alias("ord")),
            F.struct(F.col("object").alias("id"), F.struct("ord", F.lit(1).alias("side")).alias("ord")),
        )
    ).alias("_n")
    return triples.select(side, "doc_id", "namespace", "classification").select(
        "_n.id", "_n.ord", "doc_id", "namespace", "classification"
    )


def nodes_from(triples: DataFrame) -> DataFrame:
    """(id, namespace, classification, entity_type, label); the first writer sets the metadata.

    The documents of a node are the rows of ``node_documents``; a hub may belong to a large share of all documents, so
    they are kept as rows and not as one array.
    """
    return (
        endpoints(triples)
        .groupBy("id")
        .agg(F.min(F.struct("ord", "namespace", "classification")).alias("_f"))
        .select(
            "id",
            "_f.namespace",
            "_f.classification",
            token_type(F.col("id")).alias("entity_type"),
            F.col("id").alias("label"),
        )
    )


def node_documents(triples: DataFrame) -> DataFrame:
    """Distinct (id, doc_id)."""
    return endpoints(triples).filter(F.col("doc_id").isNotNull() & (F.col("doc_id") != "")).select("id", "doc_id").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree) by one aggregate over exploded ends."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        ).alias("e")
    )
    return ends.groupBy("e.id").agg(
        F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"), F.count("*").alias("degree")
    )


def breaker_violations(edges: DataFrame, limit: int = K.EDGE_LIMIT, stored: DataFrame | None = None, shares: int = 32) -> DataFrame:
    """(id, ord, edges_before) of the first edge of each subject that would be added at or above the limit.

    Edges count at both ends, in ``ord`` order, behind the ``stored`` (id, degree) edges that a node has already. The edge
    that fills a node comes from a bounded top-n: first in ``shares`` parts of the node's edges, trimmed before the
    shuffle, then among what those leave, so a hub meets in one task with ``shares`` times the limit of rows at most.
    """
    incident = edges.select(F.explode(F.array("source", "target")).alias("id"), "ord")
    dealt = incident.withColumn("_share", F.pmod(F.xxhash64("ord"), F.lit(shares)))
    few = nth_per_group(dealt, ["id", "_share"], [F.col("ord")], limit).select("id", "ord")
    ranked = nth_per_group(few, ["id"], [F.col("ord")], limit)
    own = edges.select(F.col("source").alias("id"), "ord")
    if stored is None:
        full = ranked.filter(F.col("_rn") == limit).select("id", F.col("ord").alias("full_at"))
        first = own.join(full, "id").filter(F.col("ord") > F.col("full_at"))
    else:
        # A node with ``degree`` stored edges is full at its (limit - degree)-th new one, or before any.
        kept = stored.select("id", "degree")
        full = ranked.join(kept, "id", "left").filter(F.col("_rn") == F.greatest(F.lit(limit) - F.coalesce("degree", F.lit(0)), F.lit(1)))
        full = full.select("id", F.col("ord").alias("full_at"), (F.coalesce("degree", F.lit(0)) >= limit).alias("_before"))
        first = own.join(full, "id").filter(F.col("_before") | (F.col("ord") > F.col("full_at")))
    first = first.groupBy("id").agg(F.min("ord").alias("ord"))
    new = incident.join(first.withColumnRenamed("ord", "_at"), "id").filter(F.col("ord") < F.col("_at")).groupBy("id").agg(F.count("*").alias("_new"))
    counted = first.join(new, "id", "left")
    old = F.lit(0)
    if stored is not None:
        counted, old = counted.join(stored.select("id", "degree"), "id", "left"), F.coalesce("degree", F.lit(0))
    return counted.select("id", "ord", (F.coalesce("_new", F.lit(0)) + old).cast("bigint").alias("edges_before"))


def check_breaker(edges: DataFrame, limit: int = K.EDGE_LIMIT, stored: DataFrame | None = None) -> DataFrame:
    """Return ``edges`` or raise when an entity passes the limit; run it before publishing a new graph version."""
    worst = breaker_violations(edges, limit, stored).orderBy("ord").limit(1).collect()
    if worst:
        raise ValueError(
            f"graph contamination: entity {worst[0]['id']!r} reached {worst[0]['edges_before']} edges (limit {limit})"
        )
    return edges


def add_degrees(stored: DataFrame, added: DataFrame, sign: int = 1) -> DataFrame:
    """(id, degree) after edges were added, or with ``sign=-1`` removed; nodes without edges go."""
    ends = added.select(F.explode(F.array("source", "target")).alias("id"), F.lit(sign).cast("bigint").alias("degree"))
    return stored.select("id", "degree").unionByName(ends).groupBy("id").agg(F.sum("degree").alias("degree")).filter("degree > 0")


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct (node, neighbour) steps: along every edge, and back unless the pair has a grouping predicate."""
    hub = F.col("predicate").isin(K.HUB_PREDICATES).cast("int")
    pairs = edges.groupBy("source", "target").agg(F.max(hub).alias("hub"))
    steps = F.when(
        F.col("hub") == 0,
        F.array(
            F.struct(F.col("source").alias("node"), F.col("target").alias("neighbour")),
            F.struct(F.col("target").alias("node"), F.col("source").alias("neighbour")),
        ),
    ).otherwise(F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("neighbour"))))
    return pairs.select(F.explode(steps).alias("s")).select("s.node", "s.neighbour").distinct()


def walk_graph(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int) -> Walk:
    """Bounded breadth-first walk from (node, depth) seeds that exist in the graph; unknown seeds give nothing."""
    known = seeds.join(nodes.select(F.col("id").alias("node")), "node", "left_semi")
    return walk(known, cut(adjacency(edges)), depth)


def asked(seeds: DataFrame, done: Walk, keys: list[str], limit: str | None = None) -> DataFrame:
    """(keys…, _limit, _depth, _block, _bits): who asks for which walked seeds, as bits of a block, and how deep."""
    deep = F.col(limit) if limit else F.lit(done.depth)
    bit = F.expr("shiftleft(1L, int(seed & 63))")
    walked = done.seeds.select("node", F.col("depth").alias("_depth"), F.shiftright("seed", 6).alias("_block"), bit.alias("_bit"))
    rows = seeds.select(*keys, "node", F.least(deep, F.lit(done.depth)).alias("_limit")).join(walked, "node")
    return rows.groupBy(*keys, "_limit", "_depth", "_block").agg(F.bit_or("_bit").alias("_bits"))


def few_and_many(who: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of ``asked`` that are the only one of their keys, and all others. Few keys ask in more than one block.

    The others are materialised: masks and edges then stay where they are if the planner knows them to be few.
    """
    alone = who.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.min(c).alias(c) for c in ("_limit", "_depth", "_block", "_bits")]).filter("_n = 1").drop("_n")
    same = [who[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return alone, cut(who.join(alone.select(*[F.col(k).alias(f"_k_{k}") for k in keys]), same, "left_anti"))


def k_hop(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int, keys: list[str], limit: str | None = None) -> DataFrame:
    """Nodes within ``depth`` hops of each seed: (keys…, node, hop) with the smallest hop; ``limit`` names a column with a smaller depth."""
    seeds = cut(seeds)  # read before the walk and after it
    start = seeds.select("node", (F.col(limit) if limit else F.lit(depth)).alias("depth"))
    return reached_by(seeds, walk_graph(edges, nodes, start, depth), keys, limit)


def reached_by(seeds: DataFrame, done: Walk, keys: list[str], limit: str | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(keys…, node, hop) of (keys…, node[, limit]) seeds; a node that one key reaches from two seeds has the smaller hop.

    Masks meet who asks block by block, so what a key with one block reaches is told once and never exchanged. With
    ``nodes``, only nodes of that table and their ``namespace``, which joins the masks and not each key's rows.
    """
    alone, many = few_and_many(cut(asked(seeds, done, keys, limit)), keys)
    hop = F.coalesce(*[F.when((F.col("_limit") >= h) & (F.col(f"f{h}").bitwiseAND(F.col("_bits")) != 0), F.lit(h)) for h in range(done.depth + 1)])

    masks = done.masks.withColumnsRenamed({"depth": "_depth", "block": "_block"})

    def found(who: DataFrame, masks: DataFrame, *more: str) -> DataFrame:
        return masks.join(who, ["_depth", "_block"]).select(*keys, "node", *more, hop.alias("hop")).filter(F.col("hop").isNotNull())

    least = found(many, masks).groupBy(*keys, "node").agg(F.min("hop").alias("hop"))
    if nodes is None:
        return found(alone, masks).unionByName(least)
    about = nodes.select(F.col("id").alias("node"), "namespace")
    return found(alone, masks.join(about, "node"), "namespace").unionByName(least.join(about, "node"))


def met_edges(done: Walk, edges: DataFrame, carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges with a number ``_edge``, the numbers of those that a block of seeds reaches at both ends), both materialised.

    Edges that ``number_edges`` numbered, and that are stored, are taken as they are: they are unique and meet no further time.
    """
    ends = ["source", "target", "predicate"]
    rest = [c for c in [*EDGE_COLUMNS, *(carry or [])] if c in edges.columns and c not in ends]
    named = edges.filter(F.col("predicate").isNotNull())
    if "_edge" in edges.columns:
        numbered = named.select(*ends, *rest, "_edge")
    else:
        numbered = cut(number_edges(named.groupBy(*ends).agg(F.min(F.struct(*rest)).alias("_f")).select(*ends, "_f.*")))
    inside = done.inside(numbered.select("_edge", "source", "target"), ends=False).withColumnsRenamed({"depth": "_depth", "block": "_block"})
    return numbered, cut(inside)


def induced_by(
    seeds: DataFrame, done: Walk, edges: DataFrame, keys: list[str], limit: str | None = None, met: tuple[DataFrame, DataFrame] | None = None, carry: list[str] | None = None
) -> DataFrame:
    """keys… and the edges with both ends reached by one seed of the keys; each edge once per keys.

    Edges go through the joins as numbers, with a row per block of seeds. Rows of single keys come last: those of a key
    with one block need no exchange, those of other keys are told apart as pairs of key and number. ``met`` takes what
    ``met_edges`` made of the same walk and edges; ``carry`` names further columns of the edges to keep.
    """
    numbered, inside = met or met_edges(done, edges, carry)
    ends = ["source", "target", "predicate"]
    rest = [c for c in numbered.columns if c not in (*ends, "_edge")]
    alone, many = few_and_many(cut(asked(seeds, done, keys, limit)), keys)
    both = F.get(F.array(*[F.col(f"w{h}") for h in range(done.depth + 1)]), F.col("_limit")).bitwiseAND(F.col("_bits")) != 0
    told = inside.join(numbered, "_edge").join(alone, ["_depth", "_block"]).filter(both).select(*keys, *ends, *rest)
    pairs = inside.join(many, ["_depth", "_block"]).filter(both).select(*keys, "_edge").distinct()
    return told.unionByName(pairs.join(numbered, "_edge").select(*keys, *ends, *rest))


def compose(per_seed: DataFrame, keys: list[str]) -> DataFrame:
    """Union of per-seed subgraphs under ``keys`` (the seed column is dropped)."""
    cols = [c for c in ["source", "target", "predicate"] if c in per_seed.columns]
    rest = [c for c in per_seed.columns if c not in keys and c not in cols and c in EDGE_COLUMNS]
    return per_seed.groupBy(*keys, *cols).agg(F.min(F.struct(*rest)).alias("_f")).select(*keys, *cols, "_f.*")


def entity_line() -> Column:
    return F.concat(F.lit("- "), "node", F.lit(" (namespace: "), F.coalesce("namespace", F.lit("unknown")), F.lit(")")).alias("line")


def relation_line() -> Column:
    return F.concat(F.lit("- "), "source", F.lit(" --["), "predicate", F.lit("]--> "), "target").alias("line")


def unordered_lines(node_rows: DataFrame, edge_rows: DataFrame, keys: list[str]) -> DataFrame:
    """The lines of ``context_lines`` without their order: (keys…, section, line), nothing exchanged.

    Nodes and edges stand once per keys already, as ``reached_by`` and ``induced_by`` give them.
    """
    return node_rows.select(*keys, F.lit(1).alias("section"), entity_line()).unionByName(edge_rows.select(*keys, F.lit(2).alias("section"), relation_line()))


def context_lines(node_rows: DataFrame, edge_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Text lines of a subgraph: (keys…, section, ord, line); section 1 entities, 2 relationships, each in order of assertion.

    ``node_rows``: keys…, node, namespace; ``edge_rows``: keys…, source, predicate, target, ord. An entity stands where
    the first edge of the subgraph names it, one without an edge before all others.
    """
    side = F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(0).alias("side")), F.struct(F.col("target").alias("node"), F.lit(1).alias("side")))).alias("_e")
    named = edge_rows.select(*keys, "ord", side).groupBy(*keys, F.col("_e.node").alias("node")).agg(F.min(F.struct(F.col("ord").alias("at"), F.col("_e.side").alias("side"))).alias("ord"))
    entities = node_rows.select(*keys, "node", "namespace").distinct().join(named, [*keys, "node"], "left").select(
        *keys,
        F.lit(1).alias("section"),
        "ord",
        entity_line(),
    )
    relations = edge_rows.groupBy(*keys, "source", "predicate", "target").agg(F.min("ord").alias("ord")).select(
        *keys,
        F.lit(2).alias("section"),
        F.struct(F.col("ord").alias("at"), F.lit(0).alias("side")).alias("ord"),
        relation_line(),
    )
    return entities.unionByName(relations)


def first_named(done: Walk, met: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(node, _depth, _block, at, side, n0 … nD): seeds of a block for which this edge names the node first, per number of hops.

    A block's edges at a node are passed in order, and a seed's bit is left on the first alone. A last row without an edge
    has the seeds that reach the node but none of its edges. Each seed so has one row per node that it reaches.
    """
    numbered, inside = met
    hops = range(done.depth + 1)
    side = F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(0).alias("side")), F.struct(F.col("target").alias("node"), F.lit(1).alias("side")))).alias("_e")
    named = inside.join(numbered.select("_edge", "source", "target", "ord"), "_edge").select("_depth", "_block", F.col("ord").alias("at"), F.lit(False).alias("_last"), side, *[f"w{h}" for h in hops])
    masks = done.masks.withColumnsRenamed({"depth": "_depth", "block": "_block"})
    found = [reduce(lambda a, b: a.bitwiseOR(b), [F.col(f"f{i}") for i in range(h + 1)]).alias(f"w{h}") for h in hops]
    none = F.lit(None)
    reached = masks.select("_depth", "_block", none.cast(numbered.schema["ord"].dataType).alias("at"), F.lit(True).alias("_last"), "node", none.cast("int").alias("side"), *found)
    rows = named.select("_depth", "_block", "at", "_last", "_e.node", "_e.side", *[f"w{h}" for h in hops]).unionByName(reached)
    before = Window.partitionBy("_depth", "_block", "node").orderBy("_last", "at", "side").rowsBetween(Window.unboundedPreceding, -1)
    new = [F.col(f"w{h}").bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or(f"w{h}").over(before), F.lit(0).cast("bigint")))).alias(f"n{h}") for h in hops]
    told = rows.select("_depth", "_block", "node", "at", "side", *new)
    return told.filter(reduce(lambda a, b: a.bitwiseOR(b), [F.col(f"n{h}") for h in hops]) != 0)


def rendered_by(seeds: DataFrame, done: Walk, nodes: DataFrame, edges: DataFrame, keys: list[str], per_chunk: int, limit: str | None = None) -> DataFrame:
    """``render_context`` of what (keys…, node[, limit]) seeds reach: (keys…, section, chunk, text).

    Lines of keys with one seed are made where their block's masks and edges meet, and are ordered and joined there: they
    are never exchanged, only the rows that stand for up to 64 seeds are. Other keys take the way of ``context_lines``.
    """
    met = met_edges(done, edges)
    numbered, inside = met
    home = ["_depth", "_block"]
    alone, _ = few_and_many(cut(asked(seeds, done, keys, limit)), keys)
    single = cut(alone.filter(F.bit_count("_bits") == 1))

    def hit(masks: str) -> Column:
        return F.get(F.array(*[F.col(f"{masks}{h}") for h in range(done.depth + 1)]), F.col("_limit")).bitwiseAND(F.col("_bits")) != 0

    place = F.when(F.col("at").isNotNull(), F.struct("at", "side"))
    about = first_named(done, met).join(nodes.select(F.col("id").alias("node"), "namespace"), "node")
    entities = about.join(single, home).filter(hit("n")).select(*home, *keys, F.lit(1).alias("section"), place.alias("ord"), entity_line())
    facts = inside.join(numbered.select("_edge", "source", "target", "predicate", "ord"), "_edge")
    relations = facts.join(single, home).filter(hit("w")).select(*home, *keys, F.lit(2).alias("section"), F.struct(F.col("ord").alias("at"), F.lit(0).alias("side")).alias("ord"), relation_line())
    done_here = [_headed(chunked_in_place(lines, [*home, *keys, "section"], "line", "text", per_chunk, ["ord", "line"])).drop(*home) for lines in (entities, relations)]

    same = [seeds[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    rest = cut(seeds.join(single.select(*[F.col(k).alias(f"_k_{k}") for k in keys]), same, "left_anti"))
    lines = context_lines(reached_by(rest, done, keys, limit, nodes), induced_by(rest, done, edges, keys, limit, met), keys)
    return done_here[0].unionByName(done_here[1]).unionByName(render_context(lines, keys, per_chunk))


def render_context(lines: DataFrame, keys: list[str], per_chunk: int = 1000) -> DataFrame:
    """(keys…, section, chunk, text): the context in order of assertion as text blocks of bounded size, headings on the first chunk."""
    return _headed(chunked_text(lines, [*keys, "section"], "line", "text", per_chunk, ["ord", "line"]))


def _headed(chunks: DataFrame) -> DataFrame:
    heading = F.when(F.col("chunk") != 0, "").when(
        F.col("section") == 1, "# Knowledge Graph Context\n\n## Entities\n"
    ).otherwise("## Relationships\n")
    return chunks.withColumn("text", F.concat(heading, "text"))


def export_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "entity_type", "namespace", "classification", "label")


def export_edges(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target", "predicate", "source_sentence", "doc_id", "namespace")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, name, value): node and edge counts, namespaces, entity types; every part is a combinable count."""
    total_nodes = nodes.agg(F.count("*").alias("value")).select(
        F.lit("total_nodes").alias("metric"), F.lit("").alias("name"), "value"
    )
    total_edges = edges.agg(F.count("*").alias("value")).select(
        F.lit("total_edges").alias("metric"), F.lit("").alias("name"), "value"
    )
    spaces = nodes.filter(F.col("namespace").isNotNull() & (F.col("namespace") != "")).groupBy("namespace").count()
    kinds = nodes.filter(F.col("entity_type").isNotNull()).groupBy("entity_type").count()
    return (
        total_nodes.unionByName(total_edges)
        .unionByName(spaces.select(F.lit("namespace").alias("metric"), F.col("namespace").alias("name"), F.col("count").alias("value")))
        .unionByName(kinds.select(F.lit("entity_type").alias("metric"), F.col("entity_type").alias("name"), F.col("count").alias("value")))
    )


def remove_documents(
    edges: DataFrame, nodes: DataFrame, node_docs: DataFrame, doc_ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New (edges, nodes, node_docs) without the given documents.

    A node goes when no document is left for it and no edge touches it.
    """
    gone = doc_ids.select("doc_id").distinct()
    kept_edges = edges.join(gone, "doc_id", "left_anti").select(*edges.columns)
    kept_docs = node_docs.join(gone, "doc_id", "left_anti").select("id", "doc_id")
    alive = (
        kept_docs.select("id")
        .unionByName(kept_edges.select(F.explode(F.array("source", "target")).alias("id")))
        .distinct()
    )
    kept_nodes = nodes.join(alive, "id", "left_semi")
    return kept_edges, kept_nodes, kept_docs


def removal_counts(edges: DataFrame, nodes: DataFrame, kept_edges: DataFrame, kept_nodes: DataFrame) -> DataFrame:
    """(edges_removed, nodes_removed) in one row."""
    parts = [
        (edges, "edges_removed", 1), (kept_edges, "edges_removed", -1),
        (nodes, "nodes_removed", 1), (kept_nodes, "nodes_removed", -1),
    ]
    rows = None
    for df, name, sign in parts:
        one = df.agg((F.count("*") * sign).alias("n")).select(F.lit(name).alias("k"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(
        F.sum(F.when(F.col("k") == "edges_removed", F.col("n")).otherwise(0)).alias("edges_removed"),
        F.sum(F.when(F.col("k") == "nodes_removed", F.col("n")).otherwise(0)).alias("nodes_removed"),
    )
