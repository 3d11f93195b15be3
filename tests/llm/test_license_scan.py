"""The license scan against plain Python over words, and its rules as a table."""

from __future__ import annotations

import re

from tokengraph.llm import license_rules as L
from tokengraph.llm import license_scan as S
from tokengraph.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RULES = L.all_rules()
COMPILED = [re.compile(f"(?<= )({r.pattern})(?= )") for r in RULES]


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def base(text):
    words = words_of(text)
    places, labels = [], set()
    for phrase, label in {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), labels


def plain(text, rules=RULES, compiled=COMPILED):
    """All matches over the whole text at once, then containment, pair by pair."""
    norm = " " + "".join(w + " " for w in words_of(text))
    found = [(m.start(1), m.end(1), -r.priority, k, r.label, L.CONFIDENCE[r.priority]) for k, (r, c) in enumerate(zip(rules, compiled)) for m in c.finditer(norm)]
    kept = []
    for x in found:
        around = [y for y in found if y is not x and y[0] <= x[0] and y[1] >= x[1] and (y[2], y[0] - y[1], y[3]) < (x[2], x[0] - x[1], x[3])]
        if not around:
            kept.append(x)
    return kept


def wanted(text):
    n, n_base, first, last, labels = base(text)
    kept = plain(text)
    score = max([x[5] for x in kept] + ([S.BASE_SCORE] if labels else [0.0]))
    return n, n_base, first, last, ",".join(sorted(labels)), ",".join(sorted(labels | {x[4] for x in kept})), score


TEXTS = [
    "Released under the MIT License.", "mit-license", "Mit Lizenz", "MIT\nLICENSE mit license", "K-sign Kelvin mit lİcense",
    "This is licensed under the GNU Lesser General Public License, version 2.1 or later.",
    "SPDX-License-Identifier: GPL-2.0-only", "see https://www.apache.org/licenses/LICENSE-2.0", "CC BY-NC-SA 4.0 and CC-BY 3.0", "Creative Commons Attribution-ShareAlike 4.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name of the Foo Bar Inc nor the names of its contributors may be used to endorse or promote products.",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "All rights reserved. Dual-licensed. Public domain work. MPL, Mozilla Public License v2.0.", "general public licenses", "the apache license the apache license",
    "unter der Lizenz MIT License, sous licence apache license 2.0, bajo la licencia MIT License", "GPL", "pgpl gplx", "日本語 mit license 日本語", "a" * 40000 + " mit license",
]


def test_cases_match_a_plain_scan(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:8] for r in S.scan(docs).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == wanted(text), text
    labels = {i: got[i][5] for i in got}
    assert labels[5] == "gpl,lgpl-2.1" and labels[6] == "gpl-2.0" and labels[7] == "apache-2.0"
    assert labels[8] == "cc-by-3.0,cc-by-nc-sa-4.0" and labels[9] == "cc-by-sa-4.0"


def test_query_over_the_whole_table(spark, sf):
    want = sorted((r["doc_id"], *wanted(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(tuple(r) for r in queries.QUERIES["op11_license_rules"](spark, sf).collect()) == want


def test_windows_find_what_the_whole_text_has(spark):
    """Small windows: matches at, across and around the edges, some contained in one that starts a window earlier."""
    filler = [f"w{i}" for i in range(37)]
    parts = []
    for i in range(150):
        parts += filler[: i % 37] + [TEXTS[i % 17]]
    text = " ".join(parts)
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    for window in (700, 777, 1500):
        r = S.scan(docs, window=window, context=700).orderBy("doc_id").first()
        assert sorted(f["label"] for f in r["found"]) == sorted(x[4] for x in plain(text))
        assert tuple(r)[1:8] == wanted(text)


def test_priority_and_containment(spark):
    rules = [L.Rule("long", L.NAME, "free", "a free b"), L.Rule("short", L.NAME, "free", "free b"), L.Rule("strong", L.TAG, "free", "free"), L.Rule("same", L.NAME, "free", "a free b"), L.Rule("apart", L.NAME, "free", "free b c")]
    docs = spark.createDataFrame([(1, "a free b c")], "doc_id long, text string")
    assert [f["label"] for f in S.scan(docs, rules=rules).first()["found"]] == ["long", "strong", "apart"]


def test_odd_rows(spark, odd_docs, no_docs):
    got = sorted((repr(tuple(r)[:8]) for r in S.scan(odd_docs).collect()))
    assert got == sorted(repr((r["doc_id"], *wanted(r["text"]))) for r in odd_docs.collect())
    assert S.scan(no_docs).collect() == []


def test_plan_has_no_python_and_no_shuffle(spark, sf):
    plan = queries.QUERIES["op11_license_rules"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_rules():
    assert len(RULES) > 300 and len({r.label for r in RULES}) > 100
    for r in RULES:
        width = re._parser.parse(r.pattern).getwidth()[1]
        assert width < S.CONTEXT and not re.search(r"(?<!\\)[*+](?!\?)", r.pattern), r
        literal = r.pattern.index(r.keyword)
        assert literal == 0 or not r.pattern[literal - 1].isalnum(), r
    gates = re.compile(S.gate_pattern(RULES))
    assert all(gates.search(f" {r.keyword} ") for r in RULES)
    assert not gates.search(" pgpl vimx das ist mit uns ")
