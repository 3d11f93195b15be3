"""Delimited tables and page texts through the whole ingestion."""

from test_flows import AES, KEY
from tokengraph.operators import vault as V
from tokengraph.plans import flows
from tokengraph.sources.live import LiveStore


def plain_facts(done):
    values = V.unseal(done.vault, AES).select("token", "value")
    keyed = done.edges.selectExpr("concat_ws('|', source, predicate, target) AS k")
    return {tuple(r["plain"].split("|")) for r in V.reconstruct(keyed, values, "k", "k", "plain").collect()}


def test_tables_of_several_files(spark, tmp_path):
    (tmp_path / "firms.csv").write_text("Name of company,Rating,Website,Category\nHalcyon Web Solutions,5.0,https://places.example/a1,Network care\nTessera Labs,4.9,https://places.example/b2,Pottery company\n")
    (tmp_path / "pay_roll.csv").write_text('Employee;Salary;Email;Notes\nLinnea Dubois;$85,000;h@x.example;"first line\nsecond; line"\nPetra Quist;$97,500;p@x.example;\n')
    (tmp_path / "bare.csv").write_text("Name,City\n")
    ready = flows.prepare_tables(spark, str(tmp_path))
    done = flows.ingest_documents(ready, KEY, AES)
    facts = plain_facts(done)
    assert {("Linnea Dubois", "HAS_SALARY", "$85,000"), ("Linnea Dubois", "HAS_EMAIL", "h@x.example"), ("Petra Quist", "HAS_SALARY", "$97,500"), ("Halcyon Web Solutions", "HAS_RATING", "5.0")} <= facts
    text = "\n".join(r["text"] for r in done.sentences.collect())
    # Typed columns: firms are organisations, categories stay plain words, nobody becomes a person by capitals.
    assert "Halcyon" not in text and "Linnea" not in text and "Network care" in text and "5.0" in text
    kinds = {r["value"]: r["entity_type"] for r in V.unseal(done.vault, AES).collect()}
    assert kinds["Tessera Labs"] == "ORGANIZATION" and kinds["Linnea Dubois"] == "PERSON" and "Pottery company" not in kinds
    registered = {r["title"]: r for r in done.registry.collect()}
    assert sorted(registered) == ["Firms", "Pay Roll"] and registered["Firms"]["doc_id"].startswith("CSV-FIRMS-")
    assert [(r["path"].rsplit("/", 1)[1], r["reasons"]) for r in done.rejects.collect()] == [("bare.csv", ["no data rows"])]
    places = sorted((r["doc_id"], r["sent_idx"]) for r in done.sentences.collect())
    assert [i for d, i in places if "FIRMS" in d] == list(range(6))

    store = LiveStore(spark, str(tmp_path / "store"), 4)
    flows.ingest_batch(store, ready, KEY, AES, 0)
    assert store.read("registry").count() == 2 and store.read("rejects").count() == 1 and store.read("edges").count() == done.edges.count()


def test_pages_with_a_roster(spark):
    roster = "3. Engineering Department Roster\n\n| Name | Role | SSN |\n| --- | --- | --- |\n| Ngaio Petrosyan | Lead | 907-31-5528 |\n"
    rows = [
        ("/in/staff_book.pdf", 2, roster, "(anonymous)", None, "D:20231105093000"), ("/in/staff_book.pdf", 1, "Staff book\n\nWendel Arkwright has SSN 907-31-5529.", "(anonymous)", None, "D:20231105093000"),
        ("/in/scan.pdf", 1, "  ", None, None, None),
    ]
    done = flows.ingest_documents(flows.prepare_pages(spark.createDataFrame(rows, "path string, page int, text string, title string, author string, creation_date string")), KEY, AES)
    facts = plain_facts(done)
    assert {("Ngaio Petrosyan", "IN_DEPARTMENT", "Engineering"), ("Ngaio Petrosyan", "HAS_SSN", "907-31-5528"), ("Wendel Arkwright", "HAS_SSN", "907-31-5529")} <= facts
    reg = done.registry.first()
    assert (reg["title"], reg["author"], str(reg["created"])) == ("Staff book", "System Ingest", "2023-11-05")
    assert [r["reasons"] for r in done.rejects.collect()] == [["no text"]]
