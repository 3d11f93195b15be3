"""Segmentation, tables, composite cells, sources."""

import pytest
from pyspark.sql import functions as F

from tokengraph.operators import composite as C
from tokengraph.operators import detect as DT
from tokengraph.operators import segment as SG
from tokengraph.operators import tables as TB
from tokengraph.operators import tokens as T
from tokengraph.functions.hashing import TokenKey
from tokengraph.sources import delimited
from tokengraph.sources import documents as SD

TABLE = """# Autumn Pay Round

| Name | SSN | Salary | Department | Reason |
| --- | --- | --- | --- | --- |
| Tamsin Oyelaran | 931-22-4180 | $97,250 | Engineering | Band Change |
| Bruno Castellan | 946-57-2093 | $88,400 | Engineering | Yearly Step |
| Ottilie Brandvold | 918-70-6645 | $121,750 | Engineering | Promotion |
| Ngaio Petrosyan | 952-13-3378 | $164,300 | Leadership | Board Decision |
| Kofi Lindqvist | 967-84-1926 | $109,900 | Infrastructure | Title Change |
"""
HEADER = """---
okf_version: "1.0"
document:
  id: "PAY-77"
  title: "Pay round"
  classification: "CONFIDENTIAL"
  department: "HR"
  author: "desk@northmill.example"
  created: "2026-07-15"
privacy:
  entity_categories:
    - PERSON
    - SSN
  min_confidence: 0.85
access_control:
  allowed_roles:
    - hr
graph:
  namespace: "pay.trial"
---
"""
CELLS = {
    "Brightwater Kilns Pvt Ltd": "Brightwater Kilns Pvt Ltd | Brightwater Kilns Pvt Ltd | 4.6(31) | Pottery company · 18/4, Lantern Lake Rd | Open · Closes 9 pm · 091556 70318 |  | Website | Directions",
    "Rhoda Vantongeren": "Role: Line Planner; Department: Operations; Office: 27 Harbour St, Floor 3; Base: $76,800; Emergency Contact: +1 (555) 871-3340; email: planner@kilnworks.example",
    "Guest 58": "Allergies: Walnuts, Latex; Emergency Phone: 08112233445; Room: Wing C, Room 17A; Status: Waiting",
    "Corvane Textiles Ltd": "Corvane Textiles Ltd | VAT: GB904417265 | orders@corvane.example | Tue-Sat 8am-4pm | Leeds, 6 Weaver St",
}


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")


def test_five_rows_give_twenty_row_scoped_sentences(spark):
    rows = SG.table_rows(docs(spark, TABLE), "doc_id").filter("row_idx > 0")
    key = ["doc_id", "table_idx", "row_idx"]
    sents = [r.text for r in TB.row_sentences(TB.unpivot_rows(rows, key), key).collect()]
    assert len(sents) == 20
    tamsin = [s for s in sents if "Tamsin Oyelaran" in s]
    assert len(tamsin) == 4 and not any("Castellan" in s or "121,750" in s for s in tamsin)
    assert "Tamsin Oyelaran works in Engineering department." in tamsin


def test_tables_leave_the_prose(spark):
    d = docs(spark, TABLE + "\nOne. Two!\nstill two? yes")
    left = d.select("doc_id", SG.without_tables(F.col("text")).alias("text"))
    got = [r.text for r in SG.split_sentences(left, "doc_id").orderBy("sent_idx").collect()]
    assert got == ["Autumn Pay Round", "One.", "Two!", "still two?", "yes"]


def test_loose_tables_and_lone_pipes(spark):
    d = docs(spark, "a | b\nx | 1\nend", "only | one line\nend", "# a | b\nx | 1", "# h | b\n|---|---|\n# x | 2", "h |\nx | 1\ny | 2")
    got = {(r.doc_id, r.row_idx): r.cells for r in SG.table_rows(d, "doc_id").collect()}
    assert got[("d0", 1)] == ["x", "1"]
    assert not any(k[0] in ("d1", "d2") for k in got)
    assert got[("d3", 1)] == ["# x", "2"]
    # A first line without property columns cannot be the header; the next line is.
    assert got[("d4", 0)] == ["x", "1"] and got[("d4", 1)] == ["y", "2"]


def test_long_table_does_not_overflow_the_stack(spark):
    big = "h | v\n" + "\n".join(f"r{i} | {i}" for i in range(30000))
    assert SG.table_rows(docs(spark, big), "doc_id").count() == 30001


def test_minimal_two_line_document(spark):
    got = SG.split_sentences(docs(spark, "First sentence here.\nSecond one."), "doc_id").count()
    assert got == 2


def test_repeated_predicate_keeps_last_value(spark):
    df = spark.createDataFrame([(1, ["Name", "Salary", "Pay", "Wage"], ["A", "$1", "$2", ""])], "k int, headers array<string>, cells array<string>")
    assert [(r.predicate, r.value) for r in TB.unpivot_rows(df, ["k"]).collect()] == [("HAS_SALARY", "$2")]


@pytest.mark.parametrize(
    ("header", "values", "want"),
    [
        ("Name of company", ["Halcyon Web Solutions"], "ORGANIZATION"),
        ("Rating", ["5.0", "4.9"], "PLAIN"),
        ("extra", ["www.north.example", "http://south.example/q?r=1", "https://west.example/"], "PLAIN"),
        ("Email", ["a@b.com"], "EMAIL_ADDRESS"),
        ("Name", ["Linnea Dubois", "Petra Quist"], "PERSON"),
        ("Notes", ["something odd"], None),
    ],
)
def test_column_inference(spark, header, values, want):
    rows = spark.createDataFrame([(0, i, [header], [v]) for i, v in enumerate(values)], "t int, row_idx int, headers array<string>, cells array<string>")
    assert TB.column_types(rows, ["t"]).first().entity_type == want


@pytest.fixture(scope="module")
def unpacked(spark):
    df = spark.createDataFrame(list(CELLS.items()), "subject string, cell string")
    rows = df.select("subject", C.is_composite(F.col("cell")).alias("c"), C.decompose(F.col("cell"), F.col("subject")).alias("f")).collect()
    assert all(r.c for r in rows)
    return {r.subject: {f.predicate: f.value for f in r.f} for r in rows}


def test_composite_cells(unpacked):
    x = unpacked["Brightwater Kilns Pvt Ltd"]
    assert "091556 70318" in x["HAS_PHONE"] and "9 pm" in x["HAS_HOURS"] and "Lantern Lake" in x["HAS_ADDRESS"] and x["HAS_CATEGORY"] == "Pottery company"
    a = unpacked["Rhoda Vantongeren"]
    assert a["HAS_ROLE"] == "Line Planner" and a["IN_DEPARTMENT"] == "Operations" and "27 Harbour St" in a["HAS_OFFICE"]
    assert "$76,800" in a["HAS_SALARY"] and "555" in a["HAS_EMERGENCY_CONTACT"] and a["HAS_EMAIL"] == "planner@kilnworks.example"
    p = unpacked["Guest 58"]
    assert "Walnuts" in p["HAS_ALLERGIES"] and "08112233445" in p["HAS_EMERGENCY_PHONE"] and p["HAS_STATUS"] == "Waiting"
    v = unpacked["Corvane Textiles Ltd"]
    assert v["HAS_VAT"] == "GB904417265" and v["HAS_EMAIL"] == "orders@corvane.example" and "8am-4pm" in v["HAS_HOURS"] and "Weaver St" in v["HAS_ADDRESS"]


def test_atomic_cells(spark):
    df = spark.createDataFrame([("Software Engineer",), ("5.0",), ("Engineering",), ("931-22-4180",), (None,)], "c string")
    assert not any(r[0] for r in df.select(C.is_composite(F.col("c"))).collect())


def test_company_table_has_no_person_tokens(spark, tmp_path):
    (tmp_path / "companies.csv").write_text(
        "Name of company,Rating,Website,Category\nHalcyon Web Solutions,5.0,https://places.example/a1,Network care\nTessera Labs,4.9,https://places.example/b2,Pottery company\n"
    )
    rows = delimited.as_header_cells(delimited.read_table(spark, str(tmp_path))).withColumn("row_idx", F.monotonically_increasing_id()).withColumn("t", F.lit(1))
    types = TB.column_types(rows, ["t"])
    facts = TB.unpivot_rows(rows, ["t", "row_idx"])
    sents = TB.row_sentences(facts, ["t", "row_idx"]).join(types.select("t", "col_idx", F.col("entity_type").alias("vt")), ["t", "col_idx"])
    head = types.filter("col_idx = 0").select("t", F.col("entity_type").alias("st"))
    hinted = sents.join(head, "t").withColumn("hints", TB.typed_spans(F.col("text"), F.col("subject"), F.col("value"), F.col("st"), F.col("vt")))
    done = T.tokenize(DT.detect(hinted, hints="hints"), TokenKey(b"k"))
    joined = "\n".join(r.tokenized for r in done.collect())
    assert "_PERSON_" not in joined and "_ORGANIZATION_" in joined and "Halcyon" not in joined
    assert "5.0" in joined and "Network care" in joined


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters_quotes_and_blank_rows(spark, tmp_path, sep):
    quoted = f'"$85{sep}000"'
    (tmp_path / "e.csv").write_text(f"Employee{sep}Salary{sep}Email\nLinnea Dubois{sep}{quoted}{sep}h@x.com\n{sep}{sep}\n Petra Quist {sep}$9{sep}j@x.com\n")
    rows = sorted(map(tuple, delimited.read_table(spark, str(tmp_path)).collect()))
    assert rows == [("Linnea Dubois", f"$85{sep}000", "h@x.com"), ("Petra Quist", "$9", "j@x.com")]


def test_broken_lines_short_rows_and_repeated_headers(spark, tmp_path):
    (tmp_path / "r.csv").write_text('Name;Salary;Salary;Note\nLinnea Dubois;$1;$2;"first, line\nsecond; line"\nPetra Quist\nIvo Marchetti;$3;;x\n')
    rows = delimited.read_cells(spark, str(tmp_path))
    assert rows.first().headers == ["Name", "Salary", "Salary", "Note"]
    assert sorted(r.cells for r in rows.collect()) == [["Ivo Marchetti", "$3", "", "x"], ["Linnea Dubois", "$1", "$2", "first, line\nsecond; line"], ["Petra Quist", "", "", ""]]
    facts = TB.unpivot_rows(rows.withColumn("k", F.lit(1)), ["k"]).filter("predicate = 'HAS_SALARY'")
    assert sorted((r.subject, r.value) for r in facts.collect()) == [("Ivo Marchetti", "$3"), ("Linnea Dubois", "$2")]


def test_latin1_and_empty_tables(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("Name,City\nRenée,Orléans\n".encode("latin-1"))
    assert delimited.read_table(spark, str(tmp_path)).first().Name == "Renée"
    empty = tmp_path / "x"
    empty.mkdir()
    (empty / "h.csv").write_text("Name,City\n")
    with pytest.raises(ValueError):
        delimited.read_table(spark, str(empty))


def test_header_documents_and_rejects(spark, tmp_path):
    (tmp_path / "good.md").write_text(HEADER + "\nBody text.\n")
    (tmp_path / "none.md").write_text("no header at all")
    (tmp_path / "yaml.md").write_text("---\na: [1\n---\nbody")
    (tmp_path / "bad.md").write_text(HEADER.replace("CONFIDENTIAL", "SECRET").replace("0.85", "1.5") + "x")
    good, bad = SD.parse_documents(SD.read_documents(spark, str(tmp_path)))
    row = good.first()
    assert good.count() == 1 and row.header.id == "PAY-77" and row.header.max_traversal_depth == 3 and row.body == "Body text."
    reasons = {r.path.rsplit("/", 1)[1]: r.reasons for r in bad.collect()}
    assert reasons == {"none.md": ["no header"], "yaml.md": ["malformed header"], "bad.md": ["bad classification", "bad min_confidence"]}


def test_written_documents_read_back(spark, tmp_path):
    good, _ = SD.parse_documents(spark.createDataFrame([("a.md", HEADER + "It's fine.")], "path string, content string"))
    SD.to_markdown(good).write.partitionBy("doc_id").text(str(tmp_path / "out"))
    again, bad = SD.parse_documents(SD.read_documents(spark, str(tmp_path / "out")).filter(F.col("path").endswith(".txt")))
    assert bad.count() == 0 and again.first().body == "# Pay round\n\nIt's fine."


def test_identity_and_defaults(spark):
    df = spark.createDataFrame([("/in/my file (1).csv", b"abc")], "name string, content binary")
    row = df.select(
        SD.document_id("CSV", F.col("name"), F.col("content")).alias("id"), SD.namespace("csv", F.col("name")).alias("ns"),
        SD.title_from_name(F.col("name")).alias("t"), SD.resolve_classification(F.lit(None).cast("string")).alias("c"),
        SD.resolve_department(F.lit("  ")).alias("d"), SD.page_department(F.lit("x\n3. Engineering Department Roster\n")).alias("p"),
        F.date_format(SD.resolve_date(F.lit("D:20240229081500")), "yyyy-MM-dd").alias("day"),
    ).first()
    assert row.id == "CSV-MYFILE1-BA7816" and row.ns == "csv.myfile1" and row.t == "My File (1)"
    assert (row.c, row.d, row.p, row.day) == ("INTERNAL", "General", "Engineering", "2024-02-29")


def test_sentences_past_the_hints_get_none(spark):
    df = spark.sql("select 'd' as doc_id, array('a','b') as sentences, array(array(named_struct('start',0,'end',1,'entity_type','X'))) as sentence_hints")
    rows = SD.sentences_with_hints(df).orderBy("sent_idx").collect()
    assert rows[0].hints[0].entity_type == "X" and rows[1].hints is None
