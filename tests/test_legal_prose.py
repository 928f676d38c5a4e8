"""What recognition has to hide and to leave in the prose of proceedings as OCR gives it; names and numbers are made up."""

import pytest
from pyspark.sql import functions as F

from spanveil.operators import masking, names, patterns
from spanveil.plans.anonymize import anonymize

# (text, asked types, what has to be gone, what has to stay)
CASES = [
    # values cut by a line break
    ("Natural de Sobral, fone (88)\n    98811-4032.", None, ["98811-4032"], ["Natural de Sobral"]),
    ("casa s/n, CEP - 62.010-\n350, onde mora", None, ["62.010-\n350"], ["onde mora"]),
    ("filho de lavradores, RG:\n   20021987654 SSP/CE, solteiro", None, ["20021987654"], ["SSP/CE", "solteiro"]),
    ("Acusado: TARCILIO BEZERRA DO NASCIMENTO, pedreiro.\nO réu TARCILIO BEZERRA\n   DO NASCIMENTO negou.", None, ["TARCILIO", "BEZERRA"], ["pedreiro", "negou"]),
    # values that touch other characters
    ("nos autos nº0100234-11.2021.8.06.0167 deste foro", None, ["0100234-11.2021.8.06.0167"], ["deste foro"]),
    ("Advogado: Benevaldo Tavares Rocha, OAB/CE 31877Vítima:", None, ["31877"], []),
    ("CPF 529.982.247-2503/07/1990 nos autos", None, ["529.982.247-25"], ["nos autos"]),
    ("escreva a vara2@foro.jus.brSobral já", None, ["vara2@foro.jus.br"], ["Sobral"]),
    ("CPF: 529.982.247-2S do titular", None, ["529.982.247"], ["titular"]),
    # addresses
    ("residente na Rua Otávio Brandão, 81, Alto Alegre; CEP 62010-350", None, ["Otávio Brandão", "62010-350"], []),
    ("Alto Alegre, 62010-350, Sobral/CE", None, ["62010-350"], ["Sobral"]),
    # labels and other numbers stay
    ("CPF: 529.982.247-25, nascido em", None, ["529.982.247-25"], ["CPF:", "nascido em"]),
    ("os episódios contados pela testemunha ontem", ["NIT_PIS_PASEP"], [], ["episódios"]),
    ("por razoabilidade 12345 e moderação", ["OAB_BR"], [], ["razoabilidade 12345"]),
    ("Fica a audiência para 21/09/2025 às 14:00.", ["DATE_OF_BIRTH"], [], ["21/09/2025"]),
    ("nascida em 21/09/1981, natural de Sobral", ["DATE_OF_BIRTH"], ["21/09/1981"], ["natural de Sobral"]),
    # bodies
    ("PODER JUDICIÁRIO DO ESTADO DO CEARÁ\nComarca de Sobral — Vara Única\nMINISTÉRIO PÚBLICO DO ESTADO DO CEARÁ\n", None, [], ["PODER JUDICIÁRIO", "Vara Única", "MINISTÉRIO PÚBLICO"]),
]


@pytest.fixture(scope="module")
def masked(spark):
    """All cases of the same asked types in one job."""
    out = {}
    for asked in {tuple(c[1] or ()) for c in CASES}:
        rows = [(i, c[0]) for i, c in enumerate(CASES) if tuple(c[1] or ()) == asked]
        for r in anonymize(spark.createDataFrame(rows, "doc_id long, text string"), list(asked) or None).collect():
            out[r.doc_id] = r
    return out


@pytest.mark.parametrize("case", range(len(CASES)))
def test_case(masked, case):
    text, _, gone, stays = CASES[case]
    got = masked[case].anonymized_text
    assert not [g for g in gone if g in got], got
    assert not [s for s in stays if s not in got], got
    # Line breaks stay, entities lie apart and hold what stands in their place.
    assert got.count("\n") == text.count("\n")
    found = masked[case].entities
    assert all(a.end <= b.start for a, b in zip(found, found[1:])) and all(text[e.start : e.end] == e.text for e in found)


NOBODY = [
    "MINISTÉRIO PÚBLICO DO ESTADO DA BAHIA", "MINISTERIO PUBLICO DO ESTADO DO PARA", "TRIBUNAL DE JUSTICA DO ESTADO DO PIAUI", "DELEGACIA REGIONAL DE SOBRAL",
    "PROMOTORIA DE JUSTIÇA DE SOBRAL", "GOVERNO DO ESTADO DE GOIÁS", "POLÍCIA MILITAR", "DEFENSORIA PÚBLICA", "VARA ÚNICA DA COMARCA DE SOBRAL",
    "DATA MOVIMENTAÇÃO", "NÃO INFORMADO", "CERTIDÕES DA SECRETARIA", "AUTORIDADE POLICIAL", "CLASSE", "TRÁFICO DE DROGAS E CONDUTAS", "BEM COMO", "EM QUE", "BAHIA", "BRASIL",
]
SOMEBODY = ["Rita de Cássia Holanda Pontes", "TARCILIO BEZERRA DO NASCIMENTO", "ADVOGADA LÍDIA SOUSA", "Juíza Marta Queiroz", "Dr. Otto Lemos", "Paulo Vara Brito", "Inês Câmara Dias", "José do Socorro Freitas", "Bruna Guarda", "Caio Estado Melo"]
MIXED = [("MINISTÉRIO PÚBLICO DO ESTADO DO CEARÁ RUI DA COSTA PRADO", "RUI DA COSTA PRADO"), ("PROMOTORIA DE JUSTIÇA Clara Benvinda Ferreira", "Clara Benvinda Ferreira"), ("TRIBUNAL DE JUSTIÇA Dr. Otto Lemos", "Otto Lemos")]


def test_bodies_are_nobody_and_people_stay(spark):
    """A span shrinks to what names a person: nothing of a body, all of a person, and the person beside a body."""
    texts = [*NOBODY, *SOMEBODY, *(t for t, _ in MIXED)]
    df = spark.createDataFrame([(t, [(0, len(t), "PERSON", 0.9)]) for t in texts], f"view string, spans {patterns.SPANS}")
    rows = df.select("view", names.clip_institutions(F.col("view"), F.col("spans")).alias("s")).collect()
    left = {r.view: [r.view[x.start : x.end] for x in r.s] for r in rows}
    assert {t: left[t] for t in NOBODY if left[t]} == {}
    assert [t for t in SOMEBODY if not left[t] or t.split()[-1] not in left[t][0]] == []
    assert [t for t, name in MIXED if not left[t] or name not in left[t][0]] == []


def test_streets_with_names_are_addresses(spark):
    text = "Rua Otávio José Brandão, n° 81, Centro; CEP 62010-350"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    one = anonymize(df).first().anonymized_text
    assert one.count("[ENDEREÇO_") == 1 and "[PESSOA_" not in one and "Brandão" not in one
    assert anonymize(df, policy="parcial").first().anonymized_text.startswith("Rua ")


def test_masks_longer_and_shorter_than_their_values(spark):
    """Neighbours stay whole, one value has one number, and other policies number nothing."""
    text = "Jó:Lu fim; JÓ ouviu Lu e Jó"
    spans = [("PERSON", "Jó", 0, 2), ("PERSON", "Lu", 3, 5), ("PERSON", "JÓ", 11, 13), ("PERSON", "Lu", 20, 22), ("PERSON", "Jó", 25, 27)]
    shape = "doc_id long, text string, entities array<struct<type:string,text:string,start:int,end:int,score:double>>"
    df = spark.createDataFrame([(1, text, [(*s, 1.0) for s in spans]), (2, "nada aqui", [])], shape)
    got = {r.doc_id: r for r in masking.remask(df)[0].collect()}
    assert got[1].anonymized_text == "[PESSOA_1]:[PESSOA_2] fim; [PESSOA_1] ouviu [PESSOA_2] e [PESSOA_1]" and got[1].valores_distintos == {"PERSON": 2}
    assert got[2].anonymized_text == "nada aqui"
    total = {r.doc_id: r.anonymized_text for r in masking.remask(df, "total")[0].collect()}
    assert total[1] == "**:** fim; ** ouviu ** e **"
    # Without one occurrence its value stays in clear, and the numbers of the others close up.
    rest = spark.createDataFrame([(1, text, [(*s, 1.0) for s in spans[1:] if s[1] == "Lu"])], shape)
    assert masking.remask(rest)[0].first().anonymized_text == "Jó:[PESSOA_1] fim; JÓ ouviu [PESSOA_1] e Jó"
