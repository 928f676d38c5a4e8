"""Card numbers, context words by their stems, and lists as files, on literals."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanveil.functions import text, validators
from spanveil.operators import names, patterns
from spanveil.plans.anonymize import anonymize
from spanveil.sources import texts


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        total += sum(map(int, str(int(d) * (1 + i % 2))))
    return total % 10 == 0


def test_card_numbers(spark):
    draw = random.Random(4)
    begins = ["4", "51", "2221", "34", "37", "36", "6011", "65", "9", "12"]
    rows = []
    for _ in range(400):
        begin = draw.choice(begins)
        size = draw.choice([13, 14, 15, 16, 17, 19])
        body = begin + "".join(draw.choices("0123456789", k=size - len(begin) - 1))
        rows.append(body + (next(c for c in "0123456789" if luhn(body + c)) if draw.random() < 0.7 else draw.choice("0123456789")))
    lengths = {"4": {13, 16, 19}, "51": {16}, "2221": {16}, "34": {15}, "37": {15}, "36": {14, 16}, "6011": {16, 17, 19}, "65": {16, 17, 19}}
    issued = lambda v: any(v.startswith(b) and len(v) in sizes for b, sizes in lengths.items())
    df = spark.createDataFrame([(v,) for v in [*rows, "", None, "0000000000000000", "abc"]], "v string")
    got = {r.v: (r.luhn, r.card) for r in df.select("v", validators.luhn_valid(F.col("v")).alias("luhn"), validators.card_valid(F.col("v")).alias("card")).collect()}
    assert all(got[v] == (luhn(v) and len(set(v)) > 1, luhn(v) and issued(v)) for v in rows) and sum(c for _, c in got.values()) > 40
    assert got[""] == got[None] == got["abc"] == got["0000000000000000"] == (False, False)


def test_cards_in_texts(spark):
    cards = ["4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "3782 822463 10005", "4111 1111 1111 1112", "4111 1111-1111 1111", "14111111111111111", "autos 4111.1111.1111.1111"]
    df = spark.createDataFrame([(i, f"cartão {c} ok") for i, c in enumerate(cards)], "doc_id long, text string")
    specs = [s for s in patterns.GENERIC if s.type == "CREDIT_CARD"]
    got = {r.doc_id: [(s.start, s.end, s.score) for s in r.spans] for r in patterns.detect(df, specs=specs).collect()}
    assert got == {i: [(7, 7 + len(c), 1.0)] if i < 4 else [] for i, c in enumerate(cards)}
    masked = anonymize(df, specs=patterns.REGISTRY + patterns.GENERIC).where("doc_id = 0").first()
    assert masked.anonymized_text == "cartão [CREDIT_CARD_1] ok"


def test_stems(spark):
    alike = [("inscrições", "inscrição"), ("residentes", "residente"), ("domiciliadas", "domiciliado"), ("celulares", "celular"), ("agências", "agência"), ("jornais", "jornal"), ("bancárias", "bancário"), ("nuvens", "nuvem"), ("oralmente", "oral")]
    df = spark.createDataFrame(alike, "a string, b string")
    for r in df.select("a", "b", text.stems(text.norm(F.col("a"))).alias("x"), text.stems(text.norm(F.col("b"))).alias("y")).collect():
        assert r.x == r.y == text.plain_stems(text.plain_norm(r.a)) == text.plain_stems(text.plain_norm(r.b))
    assert text.plain_stems("rg cpf oab ssp") == "rg cpf oab ssp"


def score(spark, line, context=None):
    df = spark.createDataFrame([(1, line)], "doc_id long, text string")
    return [round(s.score, 2) for s in patterns.detect(df, ["CEP_BR"], context=context).first().spans]


def test_context_lifts_scores(spark):
    plain = score(spark, "valor 60750-000 aqui")
    assert score(spark, "nos bairros de cima 60750-000") == score(spark, "no bairro de cima 60750-000") == [min(1.0, plain[0] + 0.35)]
    # Five tokens back, however long they are; the sixth is too far.
    long = "x" * 300
    assert score(spark, f"bairro {long} b c d 60750-000") == [min(1.0, plain[0] + 0.35)] and score(spark, "bairro a b c d e 60750-000") == plain
    assert score(spark, f"{'bairro ' * 9}{long} b c d e 60750-000") == plain


def test_context_words_of_a_file(spark, tmp_path):
    file = tmp_path / "words.json"
    file.write_text(json.dumps({"PERSON": ["assinado", "senhor", ""], "CEP_BR": ["caixas"]}))
    words = texts.load_context(spark, str(file))
    assert words == {"CEP_BR": ("caixas",), "PERSON": ("assinado", "senhor")}
    assert score(spark, "a caixa 60750-000", words)[0] > score(spark, "o bairro 60750-000", words)[0]
    person = lambda context: patterns.detect(spark.createDataFrame([(1, "Os senhores AUTOR: Ana Lima Costa")], "doc_id long, text string"), ["PERSON"], context=context).first().spans[0].score
    assert (person({}), person(words)) == (0.8, 1.0)
    with pytest.raises(ValueError):
        texts.load_context(spark, str(file), most=2)


def test_deny_list_of_a_file(spark, tmp_path):
    """A list of hundreds of terms: whole spans and leading terms go, for their own types and for all."""
    file = tmp_path / "deny.json"
    file.write_text(json.dumps({"*": [f"órgão {i}" for i in range(380)] + ["Exmo. Sr."], "PERSON": ["João Ninguém"]}))
    terms = texts.load_terms(spark, str(file))
    deny = texts.as_lists(terms)
    assert len(deny["*"]) == 381 and deny["PERSON"] == ["joao ninguem"]
    shown = "ÓRGÃO 77 | joão  ninguém | Exmo. Sr. Rui Paz | Exmo. Sr. | do órgão 5 ali"
    spans, at = [], 0
    for part in shown.split(" | "):
        spans.append((at, at + len(part), "ORGANIZATION" if part.startswith("do") else "PERSON", 0.9))
        at += len(part) + 3
    df = spark.createDataFrame([(shown, spans)], f"view string, spans {patterns.SPANS}")
    kept = df.select(names.apply_deny(F.col("view"), F.col("spans"), deny).alias("s")).first().s
    assert [shown[s.start : s.end] for s in kept] == ["joão  ninguém", "Rui Paz"]
    rows = spark.createDataFrame([("PERSON", "João Ninguém"), ("LOCATION", "João Ninguém"), ("CPF_BR", "Órgão 3"), ("PERSON", "Rui")], "type string, text string")
    assert sorted((r.type, r.text) for r in texts.deny_exact(rows, terms).collect()) == [("LOCATION", "João Ninguém"), ("PERSON", "Rui")]
    more = texts.add_deny_term(texts.add_deny_term(terms, "*", "ORGAO 3"), "LAW", "Lei Nova")
    assert more.count() == terms.count() + 1
    place = str(tmp_path / "list")
    texts.replace_terms(terms, place)
    texts.replace_terms(more, place)
    assert sorted(map(tuple, texts.current_terms(spark, place).collect())) == sorted(map(tuple, more.collect()))
