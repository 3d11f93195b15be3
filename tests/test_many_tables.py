"""Many delimited tables in one job, against the standard library's reader."""

import csv
import hashlib
import io
import random

import pytest

from tokengraph.sources import many_tables as M


def plain(data: bytes, sep: str):
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if any(c.strip() for c in r)]
    head = rows[0] if rows else []
    return head, [[(r[i] if i < len(r) else "") for i in range(len(head))] for r in rows[1:]]


def table(r, n, sep, breaks):
    out = []
    for i in range(n):
        note = r.choice(["plain", f"with{sep} mark", 'say ""hi""', "", "a 5' pipe"])
        if breaks and r.random() < 0.3:
            note += r.choice(["\nsecond line", f"\nx{sep}y\n\nlast", '\n""'])
        cells = [f"Person {i}", f'"{note}"', f"${i}", r.choice(["ok", ' 6" pipe', ""])]
        out.append(sep.join(cells[: r.choice([4, 4, 4, 2])]))
        if r.random() < 0.1:
            out.append(sep * 3)
    return "\n".join([sep.join(["Name", "Note", "Salary", "State"]), *out]) + r.choice(["", "\n"])


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    r, base, kept = random.Random(8), tmp_path_factory.mktemp("tables"), {}
    for i in range(24):
        sep = ",;\t|"[i % 4]
        data = table(r, 20 if i else 4000, sep, i % 2 == 0).encode("utf-8")
        if i == 5:
            data = b"\xef\xbb\xbf" + data
        if i == 7:
            data = data.replace(b"Person", "Renée".encode("latin-1"))
        if i == 9:
            data = data.replace(b"\n", b"\r\n")
        sub = base / f"d{i % 3}"
        sub.mkdir(exist_ok=True)
        (sub / f"t{i}.csv").write_bytes(data)
        kept[f"t{i}.csv"] = (data, sep)
    (base / "empty.csv").write_bytes(b"")
    (base / "head.csv").write_bytes(b"Name,City\n\n , \n")
    return base, kept


def test_tables_equal_the_standard_reader(spark, folder):
    base, kept = folder
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # the large table is cut into many splits
    try:
        rows, rejects = M.read_tables(spark, str(base))
        got, heads = {}, {}
        for r in rows.collect():
            name = r["path"].rsplit("/", 1)[1]
            got.setdefault(name, {})[r["row_idx"]] = r["cells"]
            heads[name] = r["headers"]
        assert sorted(x["path"].rsplit("/", 1)[1] for x in rejects.collect()) == ["empty.csv", "head.csv"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got) == sorted(kept)
    for name, (data, sep) in kept.items():
        head, want = plain(data, sep)
        assert heads[name] == head, name
        mine = [[c.replace("\r", "") for c in got[name][i]] for i in range(len(got[name]))]
        assert mine == [[c.replace("\r", "") for c in w] for w in want], name


def test_heads_are_the_first_bytes(spark, folder):
    base, kept = folder
    got = {r["path"].rsplit("/", 1)[1]: bytes(r["head"]) for r in M.content_heads(spark, str(base)).collect()}
    for name, (data, _) in kept.items():
        assert hashlib.sha256(got[name]).hexdigest() == hashlib.sha256(data[:1024]).hexdigest(), name
