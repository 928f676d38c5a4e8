"""Detection, fusion, masking, review and sessions on literals."""

import pytest
from pyspark.sql import functions as F

from spanveil.functions import masks, text, validators
from spanveil.operators import masking, patterns, session
from spanveil.operators.fuse import fuse_spans
from spanveil.plans.anonymize import anonymize

SF = "/root/testdata/sf0.001"


def _mask(spark, *texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.anonymized_text for r in anonymize(df, **options).orderBy("doc_id").collect()]


def test_values_are_masked_and_labels_stay(spark):
    one, two, three, none, empty = _mask(
        spark,
        "REQUERENTE: João da Silva Souza, CPF 529.982.247-25. Contato ocara@tjce.jus.brOcara",
        "MINISTÉRIO PÚBLICO DO ESTADO DO CEARÁ",
        "AUTOR: Maria Pereira de Lima\nMARIA PEREIRA DE LIMA, nascido em 15/03/1985, em 12/12/2020",
        None,
        "",
    )
    assert one == "REQUERENTE: [PESSOA_1], CPF [CPF_1]. Contato [EMAIL_1]Ocara"
    assert two == "MINISTÉRIO PÚBLICO DO ESTADO DO CEARÁ"
    assert three.startswith("AUTOR: [PESSOA_1]\n[PESSOA_1], nascido em [NASCIMENTO_1]")
    assert none is None and empty == ""


def test_equal_digits_are_no_cpf(spark):
    assert _mask(spark, "numero 11111111111 aqui", entities=["CPF_BR"]) == ["numero 11111111111 aqui"]


def test_unknown_type_is_an_error():
    with pytest.raises(ValueError):
        patterns.chosen_specs([" NOPE"], patterns.REGISTRY)
    assert {s.type for s in patterns.chosen_specs([" CPF_BR "], patterns.REGISTRY)} == {"CPF_BR"}


def test_policies(spark):
    t = "AUTOR: Ana Lima Costa"
    assert _mask(spark, t, policy="parcial") == ["AUTOR: A** L*** C****"]
    assert _mask(spark, t, policy="total") == ["AUTOR: " + "*" * 14]
    with pytest.raises(ValueError):
        masks.check_policy("other")


def test_fusion_prefers_priority_and_stops_at_line_breaks(spark):
    spans = [(0, 9, "PERSON", 0.6), (4, 6, "CPF_BR", 0.9), (2, 3, "LOCATION", 0.5)]
    df = spark.createDataFrame([(1, "abcd\nfghi", spans)], f"doc_id long, text string, spans {patterns.SPANS}")
    got = [(e["type"], e["start"], e["end"], e["score"]) for e in fuse_spans(df, F.col("text")).first()["entities"]]
    assert got == [("PERSON", 0, 4, 0.6), ("PERSON", 6, 9, 0.6)]


def test_check_digits(spark):
    rows = [("529.982.247-25", True), ("529.982.247-26", False), ("11111111111", False), (None, False), ("12", False)]
    df = spark.createDataFrame(rows, "v string, ok boolean")
    assert all(r.ok == r.got for r in df.select("ok", validators.cpf_valid(F.col("v")).alias("got")).collect())


def test_remask_renumbers_and_refuses(spark):
    e = "array<struct<type:string,text:string,start:int,end:int,score:double>>"
    rows = [(1, "Ana e Bia", [("PERSON", "Bia", 6, 9, 0.9)]), (2, "Ana", [("PERSON", None, 0, 3, 1.0), ("PERSON", None, 2, 3, 1.0)]), (3, "Ana", [("PERSON", "Bia", 0, 3, 1.0)]), (4, "Ana", [("PERSON", None, 0, 9, 1.0)])]
    good, bad = masking.remask(spark.createDataFrame(rows, f"doc_id long, text string, entities {e}"))
    assert [r.anonymized_text for r in good.collect()] == ["Ana e [PESSOA_1]"]
    assert sorted(r.doc_id for r in bad.collect()) == [2, 3, 4] and not any("Bia" in r.reason for r in bad.collect())


def test_sessions(spark):
    e = spark.createDataFrame([("s", 1, 0, "PERSON", "Ana Lima"), ("s", 2, 5, "PERSON", "ANA  LIMA"), ("s", 2, 9, "PERSON", "Rui Sá"), ("t", 1, 0, "PERSON", "Rui Sá")], "session_id string, ord int, start int, type string, text string")
    names = session.session_pseudonyms(e)
    assert {(r.session_id, r.norm_value, r.n) for r in names.collect()} == {("s", "ana lima", 1), ("s", "rui sa", 2), ("t", "rui sa", 1)}
    texts = spark.createDataFrame([("s", "Falei com ANA\n LIMA e RUI SA; Fernanda Limaverde [PESSOA_1]")], "session_id string, text string")
    assert session.close_residuals(texts, names).first()["closed_text"] == "Falei com [PESSOA_1] e [PESSOA_2]; Fernanda Limaverde [PESSOA_1]"
    out = spark.createDataFrame([(1, "s", "a ana lima"), (2, "s", "Fernanda")], "id int, session_id string, text string")
    ok, hits = session.egress_guard(out, e.select("session_id", "type", F.col("text").alias("value")).unionByName(spark.createDataFrame([("s", "PERSON", "Ana")], "session_id string, type string, value string")))
    assert [r.id for r in ok.collect()] == [2] and {r.pos for r in hits.collect()} == {2}


def test_normalisation(spark):
    df = spark.createDataFrame([("  JOSÉ \n da  Conceição ",)], "v string")
    assert df.select(text.value_key(F.col("v"))).first()[0] == "jose da conceicao"


def test_streaming_equals_batch(spark, tmp_path):
    from spanveil.streaming.pseudonyms import anonymize_stream

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(20)
    docs.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    anonymize_stream(source, str(tmp_path / "out"), str(tmp_path / "ck"), available_now=True, entities=["EMAIL_ADDRESS"]).awaitTermination()
    got = {r.doc_id: r.anonymized_text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.doc_id: r.anonymized_text for r in anonymize(spark.read.parquet(str(tmp_path / "in")), entities=["EMAIL_ADDRESS"]).collect()}
    assert got == want
