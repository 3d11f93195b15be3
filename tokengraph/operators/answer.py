"""Answers from facts, for a whole table of questions at once.

``facts`` are the subgraph edges of each question: query_id, source, predicate, target, ord. A subject has at most
``EDGE_LIMIT`` edges (the ingestion breaker), so values listed per subject are bounded; rows per question are not, and
are only ever reduced by combinable aggregates or returned as rows.

``index`` is what ``fact_index`` makes of such facts, or ``BlockFacts``, from which the facts of the questions or subjects at
hand are told when they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokengraph.functions import constants as K
from tokengraph.functions.ordered import chunked_text, nth_per_group
from tokengraph.functions.text import contains_any, first_word_hit, literal_map
from tokengraph.operators.facts import BlockFacts
from tokengraph.operators.retrieve import department_named
from tokengraph.operators.tokens import find_tokens
from tokengraph.session import cut


def intent(low: Column) -> Column:
    """Predicate asked for: the first rule with a word in the lower-case question."""
    return first_word_hit(low, [(w, predicate) for predicate, words in K.INTENT_RULES for w in words])


def is_list_question(low: Column) -> Column:
    return contains_any(low, K.LIST_PHRASES)


def is_retention_question(low: Column) -> Column:
    return F.contains(low, F.lit("retention")) & contains_any(low, ["bonus", "terms", "package", "offer"])


def is_chain_question(low: Column) -> Column:
    return F.contains(low, F.lit("report")) & contains_any(low, ["that person", "and who does", "chain", "hierarchy"])


def question_columns(prepared: DataFrame) -> DataFrame:
    """(query_id, q, query_text, intent, is_list, is_retention, is_chain, department)."""
    low = F.lower(F.concat_ws(" ", "tokenized", "query_text"))
    base = prepared.select("query_id", "query_text", "tokenized", low.alias("q"))
    q = F.col("q")
    return base.select(
        "query_id",
        "query_text",
        "tokenized",
        "q",
        intent(q).alias("intent"),
        is_list_question(q).alias("is_list"),
        is_retention_question(q).alias("is_retention"),
        is_chain_question(q).alias("is_chain"),
        department_named(q).alias("list_department"),
    )


def subject_values(facts: DataFrame) -> DataFrame:
    """(query_id, subject, predicate, all_values, first_ord): distinct objects in order of their first assertion.

    Rows meet once, by question and subject, which both groupings and those of later steps agree with.
    """
    rows = facts.select("query_id", F.col("source").alias("subject"), "predicate", "target", "ord").repartition("query_id", "subject")
    once = rows.groupBy("query_id", "subject", "predicate", "target").agg(F.min("ord").alias("ord"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "target"))), lambda x: x["target"])
    return once.groupBy("query_id", "subject", "predicate").agg(ordered.alias("all_values"), F.min("ord").alias("first_ord"))


def indexed(values: DataFrame) -> DataFrame:
    """``subject_values``, which may be materialised, with the columns that follow from them."""
    v = F.col("all_values")
    return values.select("query_id", "subject", "predicate", F.get(v, F.lit(0)).alias("first_value"), F.array_join(v, ", ").alias("vals"), "all_values", "first_ord")


def fact_index(facts: DataFrame) -> DataFrame:
    """(query_id, subject, predicate, first_value, vals, all_values, first_ord): ordered distinct objects, ``vals`` joined by ``, ``."""
    return indexed(subject_values(facts))


def _index_rows(index: DataFrame | BlockFacts, asked: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Rows of the index for (query_id[, subject], …), with those columns; ``only`` names predicates."""
    if isinstance(index, BlockFacts):
        return index.rows(asked, only)
    rows = index if only is None else index.filter(F.col("predicate").isin(only))
    return rows.join(asked, [c for c in ("query_id", "subject") if c in asked.columns])


def target_subjects(questions: DataFrame, index: DataFrame | BlockFacts) -> DataFrame:
    """(query_id, subject): the subject a question names in full or by base name, else by its parts, else the only one."""
    asked = questions.select("query_id", "q")
    if isinstance(index, BlockFacts):
        rows = index.firsts(asked)
    else:
        rows = index.groupBy("query_id", "subject").agg(F.min("first_ord").alias("ord")).join(asked, "query_id")
    clean = F.lower(F.trim("subject"))
    base = F.regexp_replace(clean, "-[a-z]+$", "")
    q = F.col("q")
    full = F.contains(q, clean) | ((F.length(base) > 4) & F.contains(q, base))
    parts = F.filter(F.split(F.lower("subject"), r"[\s\-_]+"), lambda p: F.length(p) > 3)
    by_parts = (F.size(parts) > 0) & F.forall(parts, lambda p: F.contains(q, p))
    pick = F.struct("ord", "subject")
    best = rows.groupBy("query_id").agg(
        F.min(F.when(full, pick)).alias("a"),
        F.min(F.when(by_parts, pick)).alias("b"),
        F.min(pick).alias("c"),
        F.count("*").alias("n"),
    )
    chosen = F.coalesce(F.col("a.subject"), F.col("b.subject"), F.when(F.col("n") == 1, F.col("c.subject")))
    return best.select("query_id", chosen.alias("subject")).filter(F.col("subject").isNotNull())


def generic_intent(questions: DataFrame, targets: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, predicate): the target's first predicate whose words occur in a question without an intent."""
    words = F.lower(F.replace(F.regexp_replace("predicate", "^HAS_", ""), F.lit("_"), F.lit(" ")))
    return (
        index.join(targets, ["query_id", "subject"])
        .join(questions.filter(F.col("intent").isNull()).select("query_id", "q"), "query_id")
        .filter((F.length(words) > 2) & F.contains(F.col("q"), words))
        .groupBy("query_id")
        .agg(F.min(F.struct("first_ord", "predicate"))["predicate"].alias("predicate"))
    )


def _phrase(predicate: Column, subject: Column, value: Column, low: Column) -> Column:
    """Word one looked-up fact: the template of its predicate with subject and value put in."""
    template = F.coalesce(
        F.when((predicate == "HAS_SSN") & F.contains(low, F.lit("social security")), K.SSN_LONG_PHRASE),
        F.try_element_at(literal_map(K.ANSWER_PHRASES), predicate),
        F.concat(
            F.lit("{s}'s "),
            F.coalesce(F.try_element_at(literal_map(K.READABLE_PREDICATES), predicate), F.lower(predicate)),
            F.lit(" is {v}."),
        ),
    )
    # Cut at the value mark first, so that a subject or value with braces is never taken for a mark.
    around = F.split(template, r"\{v\}")
    before = F.replace(F.get(around, F.lit(0)), F.lit("{s}"), subject)
    return F.concat(before, value, F.get(around, F.lit(1)))


def lookup_answers(questions: DataFrame, targets: DataFrame, index: DataFrame | BlockFacts) -> DataFrame:
    """(query_id, answer) for a target and a predicate; says so when the fact is absent."""
    if isinstance(index, BlockFacts):
        targets = cut(targets)
        index = cut(index.rows(targets).select("query_id", "subject", "predicate", "vals", "first_ord"))
    extra = generic_intent(questions, targets, index)
    asked = (
        questions.join(targets, "query_id")
        .join(extra, "query_id", "left")
        .withColumn("asked", F.coalesce("intent", "predicate"))
        .drop("predicate")
        .filter(F.col("asked").isNotNull())
        .select("query_id", "q", "subject", "asked")
    )
    # Contact questions accept either of two predicates, the asked one first.
    wanted = F.when(
        F.col("asked").isin("HAS_PHONE", "HAS_CONTACT"),
        F.array(F.struct(F.col("asked").alias("p"), F.lit(0).alias("r")), F.struct(F.lit("HAS_PHONE").alias("p"), F.lit(1).alias("r")),
                F.struct(F.lit("HAS_CONTACT").alias("p"), F.lit(2).alias("r"))),
    ).otherwise(F.array(F.struct(F.col("asked").alias("p"), F.lit(0).alias("r"))))
    tries = asked.select("query_id", "subject", F.explode(wanted).alias("w")).select("query_id", "subject", F.col("w.p").alias("predicate"), F.col("w.r").alias("r"))
    found = (
        tries.join(index.select("query_id", "subject", "predicate", "vals"), ["query_id", "subject", "predicate"])
        .groupBy("query_id")
        .agg(F.min(F.struct("r", "vals"))["vals"].alias("vals"))
    )
    names = literal_map(K.READABLE_PREDICATES)
    absent = F.concat(
        F.lit("No "), F.coalesce(F.try_element_at(names, F.col("asked")), F.lit("record")), F.lit(" record was found for "),
        "subject", F.lit(" in the knowledge base."),
    )
    said = _phrase(F.col("asked"), F.col("subject"), F.col("vals"), F.col("q"))
    return asked.join(found, "query_id", "left").select(
        "query_id", F.when(F.col("vals").isNull(), absent).otherwise(said).alias("answer")
    )


def _first_target(predicate: str) -> Column:
    """The first target of a predicate among a subject's ``facts``."""
    return F.get(F.filter("facts", lambda x: x["predicate"] == predicate), F.lit(0))["target"]


def entity_summaries(index: DataFrame | BlockFacts, asked: DataFrame | None = None) -> DataFrame:
    """(query_id, subject, first_ord, summary): up to twelve facts in fixed order; ``asked`` (query_id[, subject]), distinct rows, says of what."""
    names = [p for p, _ in K.SUMMARY_PHRASES]
    if isinstance(index, BlockFacts):
        held = index.subjects(asked)
        firsts = [_first_target(p).alias(f"v{i}") for i, p in enumerate(names)]
        wide = held.select("query_id", "subject", F.array_min(F.transform("facts", lambda x: x["ord"])).alias("first_ord"), *firsts)
    else:
        rows = index if asked is None else _index_rows(index, asked)
        firsts = [F.max(F.when(F.col("predicate") == p, F.col("first_value"))).alias(f"v{i}") for i, p in enumerate(names)]
        wide = rows.groupBy("query_id", "subject").agg(F.min("first_ord").alias("first_ord"), *firsts)
    said = F.array_compact(F.array(*[F.concat(F.lit(words), F.col(f"v{i}")) for i, (_, words) in enumerate(K.SUMMARY_PHRASES)]))
    facts = wide.select("query_id", "subject", "first_ord", said.alias("f"))
    n, f = F.size("f"), F.col("f")
    text = (
        F.when(n == 0, F.concat("subject", F.lit(" is present in the knowledge base.")))
        .when(n == 1, F.concat("subject", F.lit(" "), F.get(f, F.lit(0)), F.lit(".")))
        .when(n == 2, F.concat("subject", F.lit(" "), F.get(f, F.lit(0)), F.lit(" and "), F.get(f, F.lit(1)), F.lit(".")))
        .otherwise(
            F.concat("subject", F.lit(" "), F.array_join(F.slice(f, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(f, -1), F.lit("."))
        )
    )
    return facts.select("query_id", "subject", "first_ord", text.alias("summary"))


def general_answers(summaries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, answer): summaries of the first ``k`` subjects."""
    top = nth_per_group(summaries, ["query_id"], [F.col("first_ord"), F.col("subject")], k)
    return top.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "summary"))), lambda x: x["summary"]), " ").alias("answer")
    )


def reporting_chains(targets: DataFrame, index: DataFrame | BlockFacts) -> DataFrame:
    """(query_id, subject, manager, upper, answer): two REPORTS_TO steps, the second also by base name."""
    boss = ["REPORTS_TO"]
    one = cut(_index_rows(index, targets, boss).select(*targets.columns, F.col("first_value").alias("manager")))
    above = _index_rows(index, one.select("query_id", F.col("manager").alias("subject")).distinct(), boss)
    two = above.select("query_id", F.col("subject").alias("manager"), F.col("first_value").alias("_direct"))
    staged = cut(one.join(two, ["query_id", "manager"], "left"))
    base = F.lower(F.regexp_replace("manager", "-[A-Za-z]+$", ""))
    alias = (
        _index_rows(index, staged.filter(F.col("_direct").isNull()).select("query_id", base.alias("_base")), boss)
        .filter(F.contains(F.lower("subject"), F.col("_base")))
        .groupBy("query_id")
        .agg(F.min(F.struct("first_ord", F.col("first_value").alias("_m")))["_m"].alias("_alias"))
    )
    done = staged.join(alias, "query_id", "left").withColumn("upper", F.coalesce("_direct", "_alias"))
    short = F.concat("subject", F.lit(" reports to "), "manager")
    answer = F.when(F.col("upper").isNull(), F.concat(short, F.lit("."))).otherwise(
        F.concat(short, F.lit(", who reports to "), "upper", F.lit("."))
    )
    return done.select("query_id", "subject", "manager", "upper", answer.alias("answer"))


def list_items(questions: DataFrame, index: DataFrame | BlockFacts) -> DataFrame:
    """(query_id, first_ord, subject, item) for list questions, after the department, promotion and rating filters.

    A filter that no subject of the question passes is dropped. Which filters hold is decided from per-question flags
    over all filter combinations, computed in one combinable aggregate.
    """
    lists = questions.filter("is_list").select(
        "query_id",
        "intent",
        "list_department",
        F.contains("q", F.lit("promotion")).alias("promo"),
        F.nullif(F.regexp_extract("q", r"rating(?:\s+of)?\s+(\d+(?:\.\d+)?)", 1), F.lit("")).alias("rating"),
    )
    rows = _index_rows(index, cut(lists))  # few: the facts stay where they are
    p, vals = F.col("predicate"), F.col("vals")

    def held(name: str) -> Column:
        return F.max(F.when(p == name, vals))

    grouped = rows.groupBy("query_id", "subject", "intent", "list_department", "promo", "rating").agg(
        F.min("first_ord").alias("first_ord"),
        F.max((p == "IN_DEPARTMENT") & F.contains(F.lower(vals), F.coalesce("list_department", F.lit("\u0000")))).alias("d"),
        F.max(p.isin("HAS_REASON", "PROMOTED_TO") & F.contains(F.lower(vals), F.lit("promotion"))).alias("m"),
        F.max(
            (p == "HAS_RATING")
            & F.exists("all_values", lambda r: F.startswith(r, F.coalesce("rating", F.lit("\u0000"))))
        ).alias("r"),
        F.max(F.when(p == F.col("intent"), vals)).alias("asked"),
        held("HAS_REASON").alias("reason"),
        held("PROMOTED_TO").alias("promoted"),
        held("HAS_ROLE").alias("role"),
        held("IN_DEPARTMENT").alias("dept"),
        held("HAS_SALARY").alias("salary"),
        held("HAS_SSN").alias("ssn"),
    )
    per_subject = cut(grouped)  # read for the flags and for the items
    d, m, r = F.col("d"), F.col("m"), F.col("r")
    flags = per_subject.groupBy("query_id").agg(
        F.max(d).alias("xd"), F.max(m).alias("xm"), F.max(r).alias("xr"), F.max(d & m).alias("xdm"),
        F.max(d & r).alias("xdr"), F.max(m & r).alias("xmr"), F.max(d & m & r).alias("xdmr"),
    )
    use_d = F.col("list_department").isNotNull() & F.col("xd")
    use_m = F.col("promo") & F.when(use_d, F.col("xdm")).otherwise(F.col("xm"))
    use_r = F.col("rating").isNotNull() & (
        F.when(use_d & use_m, F.col("xdmr")).when(use_d, F.col("xdr")).when(use_m, F.col("xmr")).otherwise(F.col("xr"))
    )
    kept = per_subject.join(flags, "query_id").filter((~use_d | d) & (~use_m | m) & (~use_r | r))
    names = literal_map(K.READABLE_PREDICATES)
    label = F.upper(F.coalesce(F.try_element_at(names, F.col("intent")), F.col("intent")))
    plain = F.concat_ws(
        " — ",
        F.nullif("role", F.lit("")),
        F.concat(F.lit("("), "dept", F.lit(")")),
        F.concat(F.lit("Salary: "), "salary"),
        F.concat(F.lit("SSN: "), "ssn"),
    )
    head = F.concat(F.lit("- **"), "subject", F.lit("**"))
    item = (
        F.when(F.col("promo"), F.concat(head, F.lit(": "), F.coalesce("reason", "promoted", F.lit("Promotion"))))
        .when(F.col("intent").isNotNull(), F.concat(head, F.lit(": "), label, F.lit(" "), "asked"))
        .when(plain == "", head)
        .otherwise(F.concat(head, F.lit(": "), plain))
    )
    return kept.select("query_id", "first_ord", "subject", item.alias("item")).filter(F.col("item").isNotNull())


def list_answers(questions: DataFrame, items: DataFrame, per_chunk: int = 1000) -> DataFrame:
    """(query_id, chunk, answer): a list answer in order of assertion, in blocks of bounded size, the heading on the first."""
    lists = questions.filter("is_list")
    heading = F.when(F.contains("q", F.lit("promotion")), K.PROMOTION_HEADER).otherwise(K.LIST_HEADER)
    blocks = chunked_text(items, ["query_id"], "item", "text", per_chunk, ["first_ord", "subject"])
    full = blocks.join(lists.select("query_id", heading.alias("_h")), "query_id").select(
        "query_id",
        "chunk",
        F.when(F.col("chunk") == 0, F.concat("_h", F.lit("\n\n"), "text")).otherwise(F.col("text")).alias("answer"),
    )
    none = lists.join(items.select("query_id"), "query_id", "left_anti").select(
        "query_id", F.lit(0).cast("bigint").alias("chunk"), F.lit(K.NO_LIST_ANSWER).alias("answer")
    )
    return full.unionByName(none)


def retention_answers(questions: DataFrame, index: DataFrame | BlockFacts, per_chunk: int = 1000) -> DataFrame:
    """(query_id, chunk, answer) for retention-term questions.

    Roles named in the question come first; else every subject with terms. The first value with a percent sign is
    preferred.
    """
    q = questions.filter("is_retention").select("query_id", F.lower("tokenized").alias("_t"))
    rows = _index_rows(index, q, ["HAS_RETENTION_BONUS"])
    order = F.lit(len(K.EXECUTIVE_ROLES))
    named = F.lit(False)
    for i, role in reversed(list(enumerate(K.EXECUTIVE_ROLES))):
        order = F.when(F.col("subject") == role, F.lit(i)).otherwise(order)
    for role in K.EXECUTIVE_ROLES:
        named = named | ((F.col("subject") == role) & F.col("_t").rlike(rf"\b{role.lower()}\b"))
    rows = rows.select("query_id", "subject", "first_value", "all_values", "first_ord", named.alias("_named"), order.alias("_o"))
    any_named = rows.groupBy("query_id").agg(F.max("_named").alias("_any"))
    used = rows.join(any_named, "query_id").filter(F.col("_named") | ~F.col("_any"))
    rank = F.struct(F.when(F.col("_any"), F.col("_o")).otherwise(F.lit(0)).alias("r"), F.col("first_ord").alias("o"))
    percent = F.get(F.filter("all_values", lambda v: F.contains(v, F.lit("%"))), F.lit(0))
    is_token = F.size(find_tokens(F.col("subject"))) > 0
    is_role = F.col("subject").isin(K.EXECUTIVE_ROLES)
    got = used.groupBy("query_id").agg(
        F.min(F.when(percent.isNotNull(), F.struct(rank.alias("k"), percent.alias("v"))))["v"].alias("pct"),
        F.min(F.struct(rank.alias("k"), F.col("first_value").alias("v")))["v"].alias("any"),
        F.max(F.col("subject") == "CEO").alias("ceo"),
        F.max(F.col("subject") == "CFO").alias("cfo"),
        F.sum(is_token.cast("int")).alias("n_tokens"),
        F.sum(is_role.cast("int")).alias("n_roles"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.when(is_role, F.struct(rank.alias("k"), "subject")))), lambda x: x["subject"]), " and ").alias("roles"),
    )
    # Token recipients are named in their order in blocks of bounded size, one sentence per block, so that none is left out.
    tokens = used.filter(is_token).select("query_id", rank.alias("k"), "subject")
    labels = chunked_text(tokens, ["query_id"], "subject", "tokens", per_chunk, ["k", "subject"], " and ").drop("n_lines")
    terms = F.coalesce("pct", "any", F.lit(K.DEFAULT_RETENTION_TERMS))
    terms = F.trim(F.regexp_replace(terms, r"^[a-z]\s+", ""))
    terms = F.when(F.contains(F.lower(terms), F.lit("close")), terms).otherwise(F.concat(terms, F.lit(" upon deal close")))
    who = (
        F.when(F.col("ceo") & F.col("cfo"), "Chief Executive Officer and Chief Financial Officer")
        .when(F.col("n_tokens") > 0, F.col("tokens"))
        .when(F.col("n_roles") > 0, F.concat(F.lit("the "), "roles"))
        .otherwise("The executive officers")
    )
    n_roles, n_tokens = F.coalesce("n_roles", F.lit(0)), F.coalesce("n_tokens", F.lit(0))
    verb = F.when((n_roles == 1) | (n_tokens == 1), "was").otherwise("were")
    # Labels of further blocks are needed only where the tokens are what is named.
    pair = F.coalesce(F.col("ceo") & F.col("cfo"), F.lit(False))
    joined = q.join(got, "query_id", "left").join(labels, "query_id", "left")
    return joined.filter(F.col("chunk").isNull() | (F.col("chunk") == 0) | ~pair).select(
        "query_id",
        F.coalesce("chunk", F.lit(0).cast("bigint")).alias("chunk"),
        F.concat(who, F.lit(" "), verb, F.lit(" offered a retention bonus equal to "), terms, F.lit(".")).alias("answer"),
    )


def answer_queries(prepared: DataFrame, facts: DataFrame | BlockFacts) -> DataFrame:
    """(query_id, route, chunk, answer) for every question; exactly one route per question."""
    # The routes below read these several times; they are small next to the subgraphs they come from.
    questions = question_columns(prepared)
    index = facts if isinstance(facts, BlockFacts) else indexed(cut(subject_values(facts)))
    has = cut(index.known() if isinstance(index, BlockFacts) else index.select("query_id").distinct())
    known = questions.join(has, "query_id", "left_semi")
    zero = F.lit(0).cast("bigint")

    retention = retention_answers(known, index)
    lists = known.filter(~F.col("is_retention"))
    items = list_items(lists, index)
    rest = lists.filter(~F.col("is_list"))
    targets = cut(target_subjects(rest, index))
    chain = cut(reporting_chains(targets.join(rest.filter("is_chain").select("query_id"), "query_id", "left_semi"), index))
    single = cut(lookup_answers(rest.join(chain.select("query_id"), "query_id", "left_anti"), targets, index))
    untold = targets.join(chain.select("query_id"), "query_id", "left_anti").join(single.select("query_id"), "query_id", "left_anti")
    about = entity_summaries(index, untold)
    general = general_answers(entity_summaries(index, rest.select("query_id").distinct().join(targets.select("query_id"), "query_id", "left_anti")))
    missing = questions.join(has, "query_id", "left_anti").select("query_id", F.lit(K.NO_RECORDS_ANSWER).alias("answer"))

    def routed(df: DataFrame, route: str) -> DataFrame:
        chunk = F.col("chunk") if "chunk" in df.columns else zero
        return df.select("query_id", F.lit(route).alias("route"), chunk.alias("chunk"), never_empty(F.col("answer")).alias("answer"))

    return (
        routed(retention, "retention")
        .unionByName(routed(list_answers(lists, items), "list"))
        .unionByName(routed(chain, "chain"))
        .unionByName(routed(single, "lookup"))
        .unionByName(routed(about.withColumnRenamed("summary", "answer"), "summary"))
        .unionByName(routed(general, "general"))
        .unionByName(routed(missing, "none"))
    )


def never_empty(answer: Column) -> Column:
    return F.when(F.trim(F.coalesce(answer, F.lit(""))) == "", K.NO_RECORDS_ANSWER).otherwise(answer)


def egress_tokens(prepared: DataFrame, lines: DataFrame) -> DataFrame:
    """Distinct (query_id, token) in everything that would leave: the tokenized question and its context lines."""
    texts = prepared.select("query_id", F.col("tokenized").alias("line")).unionByName(lines.select("query_id", "line"))
    return texts.select("query_id", F.explode(find_tokens(F.col("line"))).alias("token")).distinct()


def egress_proof(prepared: DataFrame, lines: DataFrame) -> DataFrame:
    """(query_id, tokenized_query, context_lines, tokens_detected) per question."""
    n_tokens = egress_tokens(prepared, lines).groupBy("query_id").agg(F.count("*").alias("t"))
    n_lines = lines.groupBy("query_id").agg(F.count("*").alias("l"))
    zero = F.lit(0).cast("bigint")
    return (
        prepared.select("query_id", F.col("tokenized").alias("tokenized_query"))
        .join(n_lines, "query_id", "left")
        .join(n_tokens, "query_id", "left")
        .select(
            "query_id", "tokenized_query", F.coalesce("l", zero).alias("context_lines"), F.coalesce("t", zero).alias("tokens_detected")
        )
    )
