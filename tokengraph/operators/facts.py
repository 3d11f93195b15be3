"""Facts of very many questions, told from rows that stand for a block of seeds and a subject.

A question's facts are the edges that its seeds reach at both ends. Most of them are reached by many questions, so rows per
question and fact are never exchanged or stored: ``blocks`` has the edges of each subject that a block of 64 seeds
reaches, with the masks of the seeds, and a question that asks in one block picks its own from them where the two meet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokengraph.operators import graph as G
from tokengraph.operators.traverse import Walk
from tokengraph.session import cut

HOME = ["_depth", "_block"]


@dataclass
class BlockFacts:
    """``blocks``: _depth, _block, subject, _when (ord and masks of each edge, in order), _what (its target and predicate), v0 … vD (masks of all).

    ``alone``: query_id, _limit, _depth, _block, _bits of questions that ask in one block; ``many``: of all others, whose
    facts are told apart as pairs of question and edge number from ``inside`` and ``numbered``.
    """

    blocks: DataFrame
    alone: DataFrame
    many: DataFrame
    inside: DataFrame
    numbered: DataFrame
    depth: int

    def _hit(self, masks: list[Column]) -> Column:
        return F.get(F.array(*masks), F.col("_limit")).bitwiseAND(F.col("_bits")) != 0

    def _met(self, questions: DataFrame | None, only: list[str] | None) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
        """(blocks beside who asks in them, edges of questions with several blocks, join columns, further columns of the questions)."""
        on = ["query_id"] if questions is None else [c for c in ("query_id", "subject") if c in questions.columns]
        more = [] if questions is None else [c for c in questions.columns if c not in on]
        levels = range(self.depth + 1)
        blocks, alone, many, numbered = self.blocks, self.alone, self.many, self.numbered
        if only is not None:
            asked = F.filter(F.arrays_zip("_when", "_what"), lambda x: x["_what"]["predicate"].isin(only))
            picked = blocks.withColumn("_asked", asked).filter(F.size("_asked") > 0)
            blocks = picked.select(*HOME, "subject", F.transform("_asked", lambda x: x["_when"]).alias("_when"), F.transform("_asked", lambda x: x["_what"]).alias("_what"), *[f"v{h}" for h in levels])
            numbered = numbered.filter(F.col("predicate").isin(only))
        if questions is not None:
            alone = alone.join(questions, "query_id")
            many = many.join(questions.select("query_id"), "query_id", "left_semi")
        met = blocks.join(alone, HOME + on[1:]).filter(self._hit([F.col(f"v{h}") for h in levels]))
        pairs = self.inside.join(many, HOME).filter(self._hit([F.col(f"w{h}") for h in levels])).select("query_id", "_edge").distinct()
        rest = pairs.join(numbered.select("_edge", F.col("source").alias("subject"), "target", "predicate", "ord"), "_edge")
        return met, rest, on, more

    def _mine(self, when: Column) -> Column:
        return self._hit([when[f"w{h}"] for h in range(self.depth + 1)])

    def _of_questions(self, rest: DataFrame, questions: DataFrame | None, on: list[str]) -> DataFrame:
        """Rows of questions with several blocks, beside the questions' columns."""
        if questions is None:
            return rest
        return rest.join(questions.join(self.many.select("query_id").distinct(), "query_id", "left_semi"), on)

    def subjects(self, questions: DataFrame | None = None, only: list[str] | None = None) -> DataFrame:
        """(query_id, columns of ``questions``…, subject, facts): a subject's (ord, target, predicate) of a question, in order.

        ``questions`` (query_id[, subject], …) says whose facts, and of which subjects; ``only`` names the predicates.
        """
        met, rest, on, more = self._met(questions, only)
        held = F.filter(F.arrays_zip("_when", "_what"), lambda x: self._mine(x["_when"]))
        facts = F.transform(held, lambda x: F.struct(x["_when"]["ord"].alias("ord"), x["_what"]["target"].alias("target"), x["_what"]["predicate"].alias("predicate")))
        one = met.select("query_id", *more, "subject", facts.alias("facts"))
        if only is not None:  # the masks of all of a subject's edges say nothing about these
            one = one.filter(F.size("facts") > 0)
        grouped = rest.groupBy("query_id", "subject").agg(F.array_sort(F.collect_list(F.struct("ord", "target", "predicate"))).alias("facts"))
        return one.unionByName(self._of_questions(grouped, questions, on).select(*one.columns))

    def firsts(self, questions: DataFrame) -> DataFrame:
        """(query_id, columns of ``questions``…, subject, ord): where each subject of a question is first asserted."""
        met, rest, on, more = self._met(questions, None)
        ord_ = F.array_min(F.transform(F.filter("_when", self._mine), lambda x: x["ord"]))
        one = met.select("query_id", *more, "subject", ord_.alias("ord"))
        grouped = rest.groupBy("query_id", "subject").agg(F.min("ord").alias("ord"))
        return one.unionByName(self._of_questions(grouped, questions, on).select(*one.columns))

    def rows(self, questions: DataFrame | None = None, only: list[str] | None = None) -> DataFrame:
        """What ``answer.fact_index`` has of the same facts, beside the columns of ``questions``."""
        held = self.subjects(questions, only)
        kept = [c for c in held.columns if c != "facts"]
        names = F.explode(F.array_distinct(F.transform("facts", lambda x: x["predicate"])))
        each = held.select(*kept, "facts", names.alias("predicate"))
        mine = each.select(*kept, "predicate", F.filter("facts", lambda x: x["predicate"] == F.col("predicate")).alias("_m"))
        listed = mine.select(*kept, "predicate", F.transform("_m", lambda x: x["target"]).alias("all_values"), F.array_min(F.transform("_m", lambda x: x["ord"])).alias("first_ord"))
        v = F.col("all_values")
        return listed.select(*kept, "predicate", F.get(v, F.lit(0)).alias("first_value"), F.array_join(v, ", ").alias("vals"), "all_values", "first_ord")

    def known(self) -> DataFrame:
        """Distinct (query_id) with any fact."""
        levels = range(self.depth + 1)
        reach = self.blocks.groupBy(*HOME).agg(*[F.bit_or(f"v{h}").alias(f"v{h}") for h in levels])
        one = reach.join(self.alone, HOME).filter(self._hit([F.col(f"v{h}") for h in levels])).select("query_id")
        rest = self.inside.join(self.many, HOME).filter(self._hit([F.col(f"w{h}") for h in levels])).select("query_id").distinct()
        return one.unionByName(rest)


def block_facts(seeds: DataFrame, done: Walk, edges: DataFrame, limit: str | None = None, store: bool = True) -> BlockFacts:
    """The facts of (query_id, node[, limit]) seeds.

    With ``store`` the rows of blocks are materialised, for those who read them more than once. Else a question's facts
    are picked where its block's edges have met.
    """
    numbered, inside = G.met_edges(done, edges)
    alone, many = G.few_and_many(cut(G.asked(seeds, done, ["query_id"], limit)), ["query_id"])
    levels = range(done.depth + 1)
    w = [f"w{h}" for h in levels]
    rows = inside.join(numbered.select("_edge", F.col("source").alias("subject"), "target", "predicate", "ord"), "_edge")
    # Lists of single edges would only lengthen what is exchanged: rows meet first.
    grouped = rows.repartition(*HOME).groupBy(*HOME, "subject").agg(
        F.array_sort(F.collect_list(F.struct("ord", "target", "predicate", *w))).alias("_facts"), *[F.bit_or(f"w{h}").alias(f"v{h}") for h in levels]
    )
    when = F.transform("_facts", lambda x: F.struct(x["ord"].alias("ord"), *[x[c].alias(c) for c in w]))
    what = F.transform("_facts", lambda x: F.struct(x["target"].alias("target"), x["predicate"].alias("predicate")))
    blocks = grouped.select(*HOME, "subject", when.alias("_when"), what.alias("_what"), *[f"v{h}" for h in levels])
    return BlockFacts(cut(blocks) if store else blocks, cut(alone) if store else alone, many, inside, numbered, done.depth)
