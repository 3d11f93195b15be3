"""License scan by ordered signature rules, as one expression over each text: no Python, no shuffle, no rows beside the texts.

A text is normalised to its words with one space between them. Hundreds of rules (``license_rules``) are grouped by a
keyword that each of their matches contains; only rules whose keyword occurs are tried. Their matches are intervals, and
an interval goes when a rule of higher priority has one around it, or one of the same priority a longer one, or one as
long and an earlier rule. What is left gives the labels.

Long texts are read in windows of ``WINDOW`` characters with ``CONTEXT`` more on both sides; a match counts in the window
in which it starts, and no rule is longer than the context, so work grows with the text and an interval is never cut.

Three phrases are base labels wherever their words stand, whatever the rules say. A null or empty text has no words and
no labels. Rows stay as they are: repeated rows, rows without an id and ties give a row each; other columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokengraph.llm.common import texts
from tokengraph.llm.license_rules import CONFIDENCE, Rule, all_rules

# Phrases of the base labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, CONTEXT = 16384, 2048
BASE_SCORE = 0.5
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RULE = "struct<label:string,priority:int,rank:int,confidence:double,pattern:string>"
_FOUND = "array<struct<start:int,stop:int,label:string,priority:int,rank:int,confidence:double,phrase:string>>"


def words(text: Column) -> Column:
    """Lower-case words with one space between, before and after them; one space if there are none."""
    low = F.translate(F.coalesce(text, F.lit("")), CAPITALS, CAPITALS.lower())
    joined = F.trim(F.regexp_replace(low, BETWEEN, " "))
    return F.when(joined == "", " ").otherwise(F.concat(F.lit(" "), joined, F.lit(" ")))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def once(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def base_places(norm: Column) -> Column:
    """(n, first, last): how often a base phrase stands in normalised words, and the first and last word it starts at."""
    # The marks stand where a phrase starts, so the words before a mark are the spaces before it, less the leading one.
    phrases = "|".join(BASE)
    parts = F.split(F.regexp_replace(norm, f"(?<= )(?=(?:{phrases}) )", "\u0001"), "\u0001")

    def places(p: Column) -> Column:
        n = F.size(p) - 1
        last = spaces(norm) - spaces(F.element_at(p, -1)) - 1
        return F.struct(
            n.cast("long").alias("n"),
            F.when(n > 0, spaces(F.element_at(p, 1)) - 1).cast("long").alias("first"),
            F.when(n > 0, last).cast("long").alias("last"),
        )

    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    return F.when(F.contains(norm, F.lit(" license ")), once(parts, places)).otherwise(nothing)


def base_labels(norm: Column) -> Column:
    found = [F.when(F.contains(norm, F.lit(f" {phrase} ")), F.lit(label)) for phrase, label in BASE.items()]
    return F.array_sort(F.array_compact(F.array(*found)))


def gate(keyword: str) -> str:
    """The keyword as it is looked for: a short single word only as a whole."""
    return f" {keyword} " if len(keyword) <= 4 and " " not in keyword else keyword


def gate_pattern(rules: list[Rule]) -> str:
    """One pattern for "some keyword occurs": keywords start at words and share their beginnings, so a word start costs a letter or two."""

    def tree(tails: list[str]) -> str:
        if "" in tails:
            return ""
        branches: dict[str, list[str]] = defaultdict(list)
        for t in tails:
            branches[t[0]].append(t[1:])
        made = [letter + tree(rest) for letter, rest in branches.items()]
        return made[0] if len(made) == 1 else f"(?:{'|'.join(made)})"

    return " " + tree(sorted({gate(r.keyword).lstrip() for r in rules}))


def rule_map(rules: list[Rule]) -> Column:
    """Keyword -> rules in order of rank, as one literal: the planner folds it once."""
    groups: dict[str, list[dict]] = defaultdict(list)
    for rank, r in enumerate(rules):
        groups[gate(r.keyword)].append({"label": r.label, "priority": r.priority, "rank": rank, "confidence": CONFIDENCE[r.priority], "pattern": f"(?<= )({r.pattern})(?= )"})
    return F.from_json(F.lit(json.dumps(groups)), f"map<string,array<{_RULE}>>")


def matches(window: Column, rule: Column) -> Column:
    """Intervals of one rule in a window: (start, stop, label, priority, rank, confidence, phrase)."""
    marked = F.regexp_replace(window, rule["pattern"], F.lit("\u0001$1\u0002"))
    pieces = F.split(marked, "[\u0001\u0002]")  # gap, match, gap, match, …

    def step(state: Column, piece: Column) -> Column:
        stop = state["at"] + F.length(piece)
        item = F.struct(
            state["at"].alias("start"), stop.alias("stop"), rule["label"].alias("label"), rule["priority"].alias("priority"),
            rule["rank"].alias("rank"), rule["confidence"].alias("confidence"), piece.alias("phrase"),
        )
        found = F.when(state["inside"], F.concat(state["found"], F.array(item))).otherwise(state["found"])
        return F.struct(stop.alias("at"), (~state["inside"]).alias("inside"), found.alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(_FOUND).alias("found"))
    return once(pieces, lambda p: F.when(F.size(p) > 1, F.aggregate(p, start, step, lambda s: s["found"])).otherwise(F.array().cast(_FOUND)))


def surviving(found: Column) -> Column:
    """Intervals without one around them that counts more."""

    def above(x: Column, y: Column) -> Column:
        longer = (y["stop"] - y["start"]) - (x["stop"] - x["start"])
        tie = (y["priority"] == x["priority"]) & ((longer > 0) | ((longer == 0) & (y["rank"] < x["rank"])))
        return (y["start"] <= x["start"]) & (y["stop"] >= x["stop"]) & ((y["priority"] > x["priority"]) | tie)

    return F.filter(found, lambda x: ~F.exists(found, lambda y: above(x, y)))


def window_findings(text: Column, left: Column, own: Column, rules: list[Rule]) -> Column:
    """Surviving matches of a window that start behind its left context of ``left`` characters, within ``own`` more."""
    keywords = F.array(*[F.lit(k) for k in dict.fromkeys(gate(r.keyword) for r in rules)])
    here = F.filter(keywords, lambda k: F.contains(text, k))
    tried = F.flatten(F.transform(here, lambda k: F.element_at(rule_map(rules), k)))
    found = F.flatten(F.transform(tried, lambda r: matches(text, r)))
    kept = once(found, surviving)
    return F.filter(kept, lambda x: (x["start"] >= left) & (x["start"] < left + own))


def findings(norm: Column, rules: list[Rule], window: int = WINDOW, context: int = CONTEXT) -> Column:
    """All surviving matches in normalised words, in order of place. The context comes from the next window only."""
    if window < context:
        raise ValueError("a window is as long as its context at least")
    chunks = F.regexp_extract_all(norm, F.lit(f".{{1,{window}}}[^ ]*"), F.lit(0))

    def read(c: Column) -> Column:
        def one(chunk: Column, i: Column) -> Column:
            before = F.when(i > 0, F.right(F.get(c, i - 1), F.lit(context))).otherwise("")
            after = F.coalesce(F.left(F.get(c, i + 1), F.lit(context)), F.lit(""))
            return once(before, lambda b: once(F.concat(b, chunk, after), lambda w: window_findings(w, F.length(b), F.length(chunk), rules)))

        return F.flatten(F.transform(c, one))

    return F.when(F.rlike(norm, F.lit(gate_pattern(rules))), once(chunks, read)).otherwise(F.array().cast(_FOUND))


def scan(docs: DataFrame, rules: list[Rule] | None = None, window: int = WINDOW, context: int = CONTEXT) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found``.

    ``found`` holds (label, confidence, phrase) of the matches left. The score is the greatest confidence among them, and
    ``BASE_SCORE`` at least where a base phrase stands.
    """
    rules = list(all_rules() if rules is None else rules)

    def read(norm: Column) -> Column:
        return F.struct(
            F.greatest(spaces(norm) - 1, F.lit(0)).cast("long").alias("n_words"),
            base_places(norm).alias("places"),
            base_labels(norm).alias("base"),
            F.transform(findings(norm, rules, window, context), lambda x: F.struct(x["label"].alias("label"), x["confidence"].alias("confidence"), x["phrase"].alias("phrase"))).alias("found"),
        )

    read_once = texts(docs).select("doc_id", once(words(F.col("text")), read).alias("r"))
    best = F.aggregate(F.col("r.found"), F.lit(0.0), lambda a, x: F.greatest(a, x["confidence"]))
    return read_once.select(
        "doc_id",
        "r.n_words",
        F.col("r.places.n").alias("n_base"),
        F.col("r.places.first").alias("first_word"),
        F.col("r.places.last").alias("last_word"),
        F.array_join("r.base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.col("r.base"), F.transform("r.found", lambda x: x["label"])))), ",").alias("labels"),
        F.greatest(best, F.when(F.size("r.base") > 0, BASE_SCORE).otherwise(0.0)).alias("score"),
        F.col("r.found").alias("found"),
    )
