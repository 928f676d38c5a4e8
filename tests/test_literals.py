"""Small functions on literals: files, pages, words of OCR, sessions, summaries."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from spanveil.functions import text
from spanveil.operators import evaluate, gold, library, patterns, session
from spanveil.plans.anonymize import anonymize
from spanveil.sources import pages, texts


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_text_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("ação".encode())
    (tmp_path / "b.txt").write_bytes("ação – €".encode("cp1252"))
    (tmp_path / "c.csv").write_text("x")
    rows = {r.name: r.text for r in texts.read_texts(spark, str(tmp_path)).collect()}
    assert rows == {"a.md": "ação", "b.txt": "ação – €"}
    df = spark.createDataFrame([(b"\xe7\x80",), ("é".encode(),), (b"",), (None,)], "content binary")
    assert [r.v for r in df.select(texts.decode_text(F.col("content")).alias("v")).collect()] == ["ç€", "é", "", None]


def test_results_are_written_to_new_places_only(spark, tmp_path):
    df = spark.createDataFrame([(1, "um\ndois", "x"), (2, "", "y")], "doc_id long, anonymized_text string, more string")
    with pytest.raises(ValueError):
        texts.write_masked(df, "/in/", source="/in")
    with pytest.raises(ValueError):
        texts.write_masked(df, str(tmp_path / "z"), "docx")
    for fmt in ("text", "json", "parquet"):
        texts.write_masked(df, str(tmp_path / fmt), fmt)
        with pytest.raises(Exception, match="exist"):
            texts.write_masked(df, str(tmp_path / fmt), fmt)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "text")).collect()) == ["", "dois", "um"]
    assert spark.read.parquet(str(tmp_path / "parquet")).columns == df.columns and spark.read.json(str(tmp_path / "json")).count() == 2


def test_run_files(spark, tmp_path):
    run = {"d1": {"sha256": "h", "chars": 9, "segundos": 1.5, "modo_nlp": "x", "deteccoes": 3, "tipos": {"CPF": {"recall": 0.5}, "RG": {}}}, "d2": {"sha256": "i", "chars": 0, "tipos": {}}}
    (tmp_path / "run.json").write_text(json.dumps(run))
    rows = {(r.doc, r.type): r for r in texts.load_runs(spark, str(tmp_path / "run.json")).collect()}
    assert set(rows) == {("d1", "CPF"), ("d1", "RG"), ("d2", None)} and rows["d1", "CPF"].metrics == {"recall": 0.5} and rows["d1", "RG"].segundos == 1.5


def test_pages_and_boxes(spark):
    docs = spark.createDataFrame([(1, "capa\n## Página 1\num\n## Página 2\ndois\n## Página 3\ntrês"), (2, "sem marcas"), (3, None)], "doc_id long, text string")
    first = {r.doc_id: r.text for r in pages.first_pages(docs, 2).collect()}
    assert first == {1: "capa\n## Página 1\num\n## Página 2\ndois\n", 2: "sem marcas", 3: ""}
    box = one(spark, pages.bounding_box(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((3, 9), (1, 4), (2, 7))])))
    assert tuple(box) == (1, 4, 3, 9)
    assert one(spark, text.strip_image_refs(F.lit("a ![x](y.png) b ![](z) [l](m)"))) == "a  b  [l](m)"


def test_fragments_become_words(spark):
    lines = spark.createDataFrame([(1, "João  da Silva"), (2, "um dois"), (3, "x")], "line_id long, text string")
    parts = [(1, 0, "Jo", 0.9, 0, 0, 2, 5), (1, 1, "ão", 0.5, 2, 1, 4, 6), (1, 2, "da", 0.8, 5, 0, 7, 5), (1, 3, "Silva", 0.7, 8, 0, 12, 5), (2, 0, "um", 0.9, 0, 0, 1, 1), (2, 1, "do", 0.6, 2, 0, 3, 2)]
    rows = pages.regroup_words(lines, spark.createDataFrame(parts, "line_id long, i int, text string, conf double, x1 int, y1 int, x2 int, y2 int")).collect()
    got = sorted((r.line_id, r.w, r.text, r.conf, r.x1, r.y1, r.x2, r.y2) for r in rows)
    # The fragments of the second line lack two letters: it comes back whole.
    assert got == [(1, 0, "João", 0.5, 0, 0, 4, 6), (1, 1, "da", 0.8, 5, 0, 7, 5), (1, 2, "Silva", 0.7, 8, 0, 12, 5), (2, 0, "um dois", 0.6, 0, 0, 3, 2)]


def test_spans_of_an_outside_model(spark):
    docs = patterns.detect(spark.createDataFrame([(1, "Ana na Acme, a@b.com"), (2, "nada")], "doc_id long, text string"), ["EMAIL_ADDRESS"])
    model = spark.createDataFrame([(1, 0, 3, "PER", 0.9), (1, 7, 11, "ORG", 0.5), (1, 0, 3, "MISC", 0.9), (1, 5, 5, "PER", 0.9)], "doc_id long, start int, end int, label string, score double")
    got = {r.doc_id: sorted((s.start, s.end, s.type, s.score) for s in r.spans) for r in patterns.with_external_spans(docs, model, {"PER": "PERSON", "ORG": "ORGANIZATION"}).collect()}
    assert got == {1: [(0, 3, "PERSON", 0.9), (7, 11, "ORGANIZATION", 0.2), (13, 20, "EMAIL_ADDRESS", 0.85)], 2: []}
    out = anonymize(spark.createDataFrame([(1, "Falou RUI PAZ LEME aqui")], "doc_id long, text string"), external=model.limit(1).select("doc_id", F.lit(6).alias("start"), F.lit(18).alias("end"), "label", "score"), external_labels={"PER": "PERSON"}, titled=True)
    assert out.first().anonymized_text == "Falou [PESSOA_1] aqui"


def test_text_functions(spark):
    assert one(spark, text.caps_to_title(F.lit("o JOÃO DA SILVA e RUI foi"))) == "o João Da Silva e RUI foi"
    assert [one(spark, text.ocr_language(F.lit(v))) for v in (" PT-BR", "eng", "xx", None)] == ["por", "eng", "por", "por"]
    for value in ('a"b\\c\n\té', "", "{}"):
        assert one(spark, text.json_escaped(F.lit(value))) == json.dumps(value, ensure_ascii=False)[1:-1]
    assert [one(spark, text.token_key(F.lit(v))) for v in ("(José,", "[A.]:", "")] == ["jose", "a", ""]
    value = F.lit("a1")
    assert one(spark, text.boundary_pattern(value, F.lit("a1"))) == r"(?<!\p{L})a1(?!\p{N})"


def test_fewest_trials(spark):
    def bound(k, n, z=1.645):
        p = k / n
        return (p + z * z / (2 * n) - z * ((p * (1 - p) + z * z / (4 * n)) / n) ** 0.5) / (1 + z * z / n)

    rows = {r.k: r.n for r in evaluate.min_n_for_99(spark, spark.createDataFrame([(0,), (1,), (5,), (2_000,)], "k int"), 5_000).collect()}
    want = {k: next(n for n in range(k + 1, 5_001) if bound(n - k, n) >= 0.99) for k in (0, 1, 5)}
    assert rows == {**want, 2_000: None}


def test_sessions_and_summaries(spark):
    spans = spark.createDataFrame([(1, 0, "PERSON", "Ana Lima"), (2, 4, "PERSON", "Rui Paz"), (2, 0, "PERSON", "ANA LIMA")], "doc_id long, start int, type string, text string")
    turns = spark.createDataFrame([(1, "s", 1), (2, "s", 2)], "doc_id long, session_id string, ord int")
    assert {(r.norm_value, r.n) for r in session.prepare_turns(turns, spans).collect()} == {("ana lima", 1), ("rui paz", 2)}
    entities = spark.createDataFrame([("s", "PERSON", "Ana"), ("s", "PERSON", "Ana")], "session_id string, type string, text string")
    index = spark.createDataFrame([("s", "doc.pdf", None, "/x")], "session_id string, name string, cnj string, path string")
    assert {(r.type, r.value) for r in session.forbidden_values(entities, index).collect()} == {("PERSON", "Ana"), ("NOME_ARQUIVO", "doc.pdf"), ("CAMINHO", "/x")}
    closed = spark.createDataFrame([("s", {"PESSOA": 2, "CPF": 1}), ("s", {"PESSOA": 1}), ("t", {}), ("u", None)], "session_id string, closed map<string,int>")
    assert {r.session_id: r.summary for r in session.closed_summary(closed).collect()} == {"s": "3 PESSOA, 1 CPF"}
    measured = spark.createDataFrame([("a", 10, 4, 1.0, None), ("a", 30, 16, 2.0, "x"), ("b", 0, 0, 0.5, None)], "config string, words long, hits long, seconds double, error string")
    assert {r.config: (r.words, r.hits, r.seconds, r.errors, r.rate) for r in evaluate.summarise_quality(measured).collect()} == {"a": (40, 20, 3.0, 1, 0.5), "b": (0, 0, 0.5, 0, None)}
    found = spark.createDataFrame([("CPF", "1 2", 1), ("CPF", "1  2", 2), ("RG", "1 2", 1)], "type string, text string, doc_id long")
    assert {(r.type, r.value, r.n, r.n_docs) for r in gold.group_candidates(found).collect()} == {("CPF", "1 2", 2, 2), ("RG", "1 2", 1, 1)}
    dated = spark.createDataFrame([(i, datetime.datetime(2024, 1, d)) for i, d in ((3, 5), (1, 9), (2, 5))], "id long, stored_at timestamp")
    assert [r.id for r in library.newest_first(dated).collect()] == [1, 2, 3]


def test_evidence_of_candidates(spark):
    cases = [
        ("CPF 111.111.111-12 e CPF nº 12345678901", {"CPF"}), ("valor 12345678901 só", set()), ("fone 60750-000", set()), ("rua A, 60750-000", {"CEP"}),
        ("em 85 9991-2010 hoje", set()), ("ligue (85) 9991-3344 hoje", {"TELEFONE"}), ("RG: 2003004005-6", {"RG"}),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    rows = gold.confirm(gold.candidates(docs, ["CPF", "CEP", "TELEFONE", "RG"]), docs).collect()
    got = {i: {r.type for r in rows if r.doc_id == i} for i in range(len(cases))}
    assert got == {i: kinds for i, (_, kinds) in enumerate(cases)}
