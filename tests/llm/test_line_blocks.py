"""Content-defined line chunks, and rows that share an id or have none."""

import random

from test_operators import lines_left, stretches_left

from tokengraph.llm import line_chunks


def test_boundaries_resist_shifts():
    lines = [f"line number {i}" for i in range(400)]
    a = line_chunks.blocks("\n".join(lines))
    b = line_chunks.blocks("\n".join(["new", *lines[:150], "other", *lines[150:300], *lines[303:]]))
    assert len(a) > 40 and max(n for _, n, _ in a) < 60
    assert len({d for _, _, d in a} & {d for _, _, d in b}) >= len(a) - 6
    assert [k for i, n, _ in a for k in range(i, i + n)] == sorted({k for i, n, _ in a for k in range(i, i + n)})
    assert line_chunks.blocks("") == line_chunks.blocks("one") == line_chunks.blocks("\n\n \n\n\n") == []


def test_long_passages_go_as_chunks_and_their_edges_as_pairs(spark):
    r = random.Random(11)
    passages = [[f"passage {k} line {i}" for i in range(3 + 9 * k)] for k in range(6)]
    texts = {}
    for i in range(60):
        parts = []
        for k in range(r.randint(1, 3)):
            p = r.choice(passages)
            cut = r.randrange(len(p) // 2)
            parts += [f"own {i} {k}", *p[cut : len(p) - r.randrange(len(p) // 3)], *([""] * r.randrange(2))]
        texts[i] = "\n".join(parts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {x.doc_id: x.text for x in line_chunks.report(docs).collect()}
    assert got == stretches_left(texts) == {i: v[0] for i, v in lines_left(texts).items()}
    found = [len(line_chunks.blocks(t)) for t in texts.values()]
    assert sum(found) > 100


def test_rows_that_share_an_id_lose_no_line(spark):
    keep = "\n".join(f"keep {i}" for i in range(4))
    rows = [(7, "a\nb\nc"), (7, "a\nb\nc"), (7, "x\na\nb\nc"), (7, keep), (8, "a\nb\nend"), (None, "n1\nn2\nn3"), (None, "n1\nn2\nn3"), (None, "o\nn1\nn2\nn3"), (None, None), (9, f"q\n{keep}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    made = line_chunks.deduplicated(docs).collect()
    assert len(made) == len(rows)
    left = [line for x in made for line in (x.text or "").split("\n")]
    for line in {line for _, t in rows for line in (t or "").split("\n")}:
        assert line in left, line
    kept = sorted((x.doc_id, x.text) for x in made if x.doc_id is not None)
    assert (7, keep) in kept and (8, "end") in kept and (9, "q") in kept
    # Of the two texts with a, b, c one keeps them, in each of its equal rows.
    assert [t for i, t in kept if i == 7 and t != keep] in (["a\nb\nc", "a\nb\nc", "x"], ["", "", "x\na\nb\nc"])
