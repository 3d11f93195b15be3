"""Detection, tokens, vault, reconstruction on small in-code tables."""

import hashlib
import hmac
import re

import pytest
from pyspark.sql import functions as F

from tokengraph.functions import constants as K
from tokengraph.functions.hashing import TokenKey, entity_digest, entity_token
from tokengraph.operators import detect as DT
from tokengraph.operators import tokens as T
from tokengraph.operators import vault as V

KEY = TokenKey(b"unit-key")
AES = bytes(range(32))
HR = (
    "Wendel Arkwright (SSN: 907-31-5528) runs the night shift, earns $93,600/year and reports to Ngaio Petrosyan. The mill "
    "has $4.7M to spend. Write to w.arkwright@northmill.example or +1-555-0178."
)


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, text string")


def entities(df, **kw):
    return DT.explode_entities(DT.detect(df, **kw), "id")


def test_hr_sentence_entities(spark):
    got = {(r.entity_type, r.value) for r in entities(texts(spark, HR)).collect()}
    assert got == {
        ("PERSON", "Wendel Arkwright"), ("US_SSN", "907-31-5528"), ("SALARY", "$93,600/year"), ("SALARY", "$4.7M"),
        ("PERSON", "Ngaio Petrosyan"), ("EMAIL_ADDRESS", "w.arkwright@northmill.example"),
    }


def test_company_is_not_a_person(spark):
    rows = entities(texts(spark, "We signed with Halcyon Solutions.")).collect()
    assert [r.entity_type for r in rows] == ["ORGANIZATION"]


def test_spans_equal_python_regex_on_unicode(spark):
    samples = ["élan Jean Dupont-Élan, Zoë Ärger Anna Müller x", "a@b.co é@b.co naïve 907-31-5528é 907-31-5528", "Привет Wendel Arkwright 漢字 Mary Jones", "tab John Smith"]
    df = texts(spark, *samples)
    got = {(r.id, r.entity_type, r.start, r.end) for r in entities(df, overlap="none").collect()}
    want = set()
    for i, s in enumerate(samples):
        for t, p, _ in K.RECOGNIZERS:
            want |= {(i, t, m.start(), m.end()) for m in re.finditer(p, s)}
    assert got == want


def test_kept_spans_are_disjoint_and_sorted(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for rule in ("start", "score"):
        bad = (
            DT.detect(docs, overlap=rule)
            .select(F.exists(F.sequence(F.lit(1), F.greatest(F.size("entities") - 1, F.lit(1))), lambda i: F.get("entities", i)["start"] < F.get("entities", i - 1)["end"]).alias("bad"))
            .filter("bad").count()
        )
        assert bad == 0


def test_categories_aliases_and_confidence(spark):
    df = texts(spark, HR).withColumn("cats", DT.resolve_categories(F.array(F.lit("SSN"), F.lit("EMAIL"))))
    assert {r.entity_type for r in entities(df, categories="cats").collect()} == {"US_SSN", "EMAIL_ADDRESS"}
    assert {r.entity_type for r in entities(texts(spark, HR), min_confidence=0.9).collect()} == {"US_SSN", "EMAIL_ADDRESS", "SALARY"}


def test_score_rule_prefers_the_higher_score(spark):
    # A card starts before the phone inside it; both rules keep the card.
    rows = entities(texts(spark, "pay 4111111111111111 now"), overlap="score").collect()
    assert [r.entity_type for r in rows] == ["CREDIT_CARD"]


def test_surname_extension_and_relabel(spark):
    rows = entities(texts(spark, "Greta Halloran-Pike met Delta Systems"), overlap="score").collect()
    assert ("PERSON", "Greta Halloran-Pike") in {(r.entity_type, r.value) for r in rows}
    assert ("ORGANIZATION", "Delta Systems") in {(r.entity_type, r.value) for r in rows}


def test_hints_win(spark):
    df = spark.createDataFrame(
        [(0, "Tessera Labs has rating 4.9 from Petra Quist.", [(0, 12, "ORGANIZATION"), (24, 27, None)])],
        "id int, text string, hints array<struct<start:int,end:int,entity_type:string>>",
    )
    rows = entities(df, hints="hints").collect()
    assert [(r.entity_type, r.value, r.confidence) for r in rows] == [("ORGANIZATION", "Tessera Labs", 1.0), ("PERSON", "Petra Quist", 0.86)]


def test_digest_is_hmac_and_surnames_fold(spark):
    df = spark.createDataFrame([("PERSON", "Linnea Dubois-Hart"), ("PERSON", " linnea dubois"), ("PERSON", "Jean-Luc")], "t string, v string")
    got = [r[0] for r in df.select(entity_digest(F.col("t"), F.col("v"), KEY)).collect()]
    assert got[0] == got[1] == hmac.new(b"unit-key", b"PERSON:linnea dubois", hashlib.sha256).hexdigest()
    assert got[2] == hmac.new(b"unit-key", b"PERSON:jean-luc", hashlib.sha256).hexdigest()


def test_long_keys_are_hashed_first(spark):
    long = b"k" * 100
    got = spark.range(1).select(entity_digest(F.lit("X"), F.lit("v"), TokenKey(long))).first()[0]
    assert got == hmac.new(long, b"X:v", hashlib.sha256).hexdigest()


def test_thousand_values_thousand_tokens_and_key_sensitivity(spark):
    df = spark.range(1000).select(F.concat(F.lit("Person Name"), F.col("id").cast("string")).alias("v"))
    a = df.select(entity_token(F.lit("PERSON"), F.col("v"), KEY).alias("t"))
    assert a.distinct().count() == 1000
    assert a.filter(T.is_token(F.col("t"))).count() == 1000
    b = df.select(entity_token(F.lit("PERSON"), F.col("v"), TokenKey(b"other")).alias("t"))
    assert a.intersect(b).count() == 0


def test_collisions_are_lengthened_for_all_members(spark):
    base = "ab" + "12345678"
    digests = [base + "aaaa" + "0" * 50, base + "bbbb" + "0" * 50, "cd" + "0" * 62]
    df = spark.createDataFrame([("PERSON", d) for d in digests], "entity_type string, hmac_digest string")
    got = {r.hmac_digest: r.token for r in T.token_dictionary(df).collect()}
    assert got[digests[0]] == "⟦AB_PERSON_12345678AAAA⟧" and got[digests[1]] == "⟦AB_PERSON_12345678BBBB⟧"
    assert got[digests[2]] == "⟦CD_PERSON_00000000⟧"


def test_tokenized_text_holds_no_raw_value_and_returns(spark):
    df = T.tokenize(DT.detect(texts(spark, HR, "nothing here", "")), KEY)
    ents = DT.explode_entities(df, "id").withColumn("doc_id", F.lit("d")).withColumn("ord", F.col("entity_idx"))
    text = df.filter("id = 0").first().tokenized
    assert all(r.value not in text for r in ents.collect())
    sealed = V.seal(V.upsert(ents), AES)
    back = V.reconstruct(df.select("id", "tokenized"), V.unseal(sealed, AES), "id", "tokenized").orderBy("id").collect()
    assert [r.reconstructed for r in back] == [HR, "nothing here", ""]
    assert [r.n_reconstructed for r in back] == [6, 0, 0]


def test_unknown_tokens_stay_and_values_are_not_expanded_again(spark):
    df = spark.createDataFrame([(1, "⟦AA_PERSON_11111111⟧ knows ⟦BB_PERSON_22222222⟧")], "id int, text string")
    values = spark.createDataFrame([("⟦AA_PERSON_11111111⟧", "⟦BB_PERSON_22222222⟧")], "token string, value string")
    row = V.reconstruct(df, values, "id").first()
    assert row.reconstructed == "⟦BB_PERSON_22222222⟧ knows ⟦BB_PERSON_22222222⟧" and row.n_reconstructed == 1


def test_policies(spark):
    df = T.tokenize(DT.detect(texts(spark, "a", "b").withColumn("text", F.lit("call Petra Quist."))), KEY)
    df = df.withColumn("policy", F.when(F.col("id") == 0, "REDACT").otherwise("PASSTHROUGH"))
    got = [r.protected for r in T.apply_policy(df, "policy").orderBy("id").collect()]
    assert got == ["call [PERSON].", "call Petra Quist."]


def test_vault_keeps_first_writer_and_longest_value(spark):
    rows = [("t", "PERSON", "Linnea Dubois", "h", "d1", 1), ("t", "PERSON", "Linnea Dubois-Hart", "h", "d2", 2), ("u", "PERSON", "aa", "g", "d2", 3), ("u", "PERSON", "bb", "g", "d1", 4)]
    df = spark.createDataFrame(rows, "token string, entity_type string, value string, hmac_digest string, doc_id string, ord int")
    got = {r.token: (r.value, r.first_doc_id) for r in V.upsert(df).collect()}
    assert got == {"t": ("Linnea Dubois-Hart", "d1"), "u": ("aa", "d2")}
    # In two batches the result is the same, and merge re-encrypts only what grew.
    one = V.upsert(df.filter("ord <> 2"))
    assert {r.token: (r.value, r.first_doc_id) for r in V.upsert(df.filter("ord = 2"), one).collect()} == got
    merged = V.merge(V.seal(one, AES), df.filter("ord = 2"), AES)
    assert {r.token: (r.value, r.first_doc_id) for r in V.unseal(merged, AES).collect()} == got


def test_wrong_key_and_tampering_give_null(spark):
    df = spark.createDataFrame([("t", "PERSON", "x", "h", "d", 1)], "token string, entity_type string, value string, hmac_digest string, doc_id string, ord int")
    sealed = V.seal(V.upsert(df), AES)
    assert V.unseal(sealed, bytes(32)).first().value is None
    bent = sealed.withColumn("payload", F.concat("payload", F.lit(bytearray(b"x"))))
    assert V.unseal(bent, AES).first().value is None


def test_purge_rules(spark):
    ents = spark.createDataFrame(
        [("t", "P", "x", "h", "d1", 1), ("t", "P", "x", "h", "d2", 2), ("u", "P", "y", "i", "d1", 3)],
        "token string, entity_type string, value string, hmac_digest string, doc_id string, ord int",
    )
    gone = spark.createDataFrame([("d1",)], "doc_id string")
    v = V.upsert(ents)
    assert V.purge(v, gone).count() == 0
    assert [r.token for r in V.purge(v, gone, V.references(ents), "any").collect()] == ["t"]
    with pytest.raises(ValueError):
        V.purge(v, gone, owner="any")


def test_partition_count_does_not_matter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    def run(n):
        e = DT.explode_entities(T.tokenize(DT.detect(docs.repartition(n)), KEY), "doc_id").withColumn("ord", F.col("doc_id") * 100000 + F.col("start"))
        return sorted(map(tuple, V.upsert(e).collect()))
    assert run(1) == run(7)
