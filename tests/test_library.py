"""The encrypted library's life cycle, and the streaming forms against the batch ones."""

import datetime
import glob

import pytest
from pyspark.sql import functions as F

from spanveil.operators import evaluate, gold, masking, session
from spanveil.operators.library import Library

KEY = "0123456789abcdef"


def _rows(spark, *ids, day=1):
    entries = spark.createDataFrame([(i, f"doc {i}", None if i % 2 else f"P{i}", datetime.datetime(2024, 1, day)) for i in ids], "id long, name string, cnj string, stored_at timestamp")
    content = spark.createDataFrame([(i, f"texto {i}", f"[PESSOA_{i}]") for i in ids], "id long, texto_original string, anonymized_text string")
    return entries, content


def test_library_life_cycle(spark, tmp_path):
    path = str(tmp_path)
    lib = Library(spark, path, KEY)
    assert lib.index().count() == 0 and lib.version() == 0
    assert lib.append(*_rows(spark, 1, 2)) == 1 and lib.append(*_rows(spark, 3, 4, day=20)) == 2
    assert {(r.id, r.name, r.cnj) for r in lib.index().collect()} == {(1, "doc 1", None), (2, "doc 2", "P2"), (3, "doc 3", None), (4, "doc 4", "P4")}
    assert lib.update(spark.createDataFrame([(2, "novo", "P9"), (77, "x", "y")], "id long, name string, cnj string")) == 1
    two = lib.index().where("id = 2").first()
    assert (two.name, two.cnj, two.stored_at.day) == ("novo", "P9", 1)
    assert lib.delete(spark.createDataFrame([(3,), (99,)], "id long")) == 1 and lib.delete(spark.createDataFrame([(3,)], "id long")) == 0
    now = F.lit("2024-01-25").cast("timestamp")
    assert lib.retain(0) == 0 and lib.retain(10, now) == 2
    assert [(r.id, r.texto_original) for r in lib.open().collect()] == [(4, "texto 4")]
    assert "texto_original" not in lib.open_for_egress().columns and [r.id for r in lib.missing(spark.range(3, 5)).collect()] == [3]
    assert lib.vacuum() > 0 and lib.vacuum() == 0 and lib.open().count() == 1
    stored = spark.read.parquet(*glob.glob(f"{path}/content/*"))
    assert stored.count() == 1 and not any(b"texto" in bytes(r.texto_original) for r in stored.collect())
    with pytest.raises(ValueError):
        Library(spark, path, "fedcba9876543210").index()
    with pytest.raises(ValueError):
        Library(spark, path, "short")


def test_a_delete_writes_no_part_again(spark, tmp_path):
    """Many parts: a change of one id adds a tombstone only; compaction makes one part of them, vacuum removes the bytes."""
    path = str(tmp_path)
    lib = Library(spark, path, KEY)
    for i in range(12):
        lib.append(*_rows(spark, 10 * i, 10 * i + 1, day=1 + i))
    parts = lambda: {k: sorted(glob.glob(f"{path}/{k}/*")) for k in ("index", "content")}
    before = parts()
    assert lib.delete(spark.createDataFrame([(51,), (7,)], "id long")) == 1 and lib.retain(10, F.lit("2024-01-14").cast("timestamp")) == 6
    assert parts() == before and len(glob.glob(f"{path}/gone/*")) == 2
    assert sorted(r.id for r in lib.open().collect()) == [i for i in range(120) if i % 10 < 2 and i >= 30 and i != 51]
    # An id that comes again is there again; the tombstone reaches the older parts only.
    lib.append(*_rows(spark, 51, 1))
    assert {1, 51} < {r.id for r in lib.open().collect()} and lib.open(spark.createDataFrame([(51,)], "id long")).count() == 1
    assert lib.update(spark.createDataFrame([(51, "novo", "P1"), (40, "outro", None)], "id long, name string, cnj string")) == 2
    rows = {r.id: (r.name, r.stored_at.day, r.texto_original) for r in lib.open().collect()}
    assert rows[51] == ("novo", 1, "texto 51") and rows[40] == ("outro", 5, "texto 40") and len(rows) == 19
    assert lib.compact() > 20 and len(lib._state()["index"]) == len(lib._state()["content"]) == 1 and not lib._state()["gone"]
    assert {r.id: (r.name, r.stored_at.day, r.texto_original) for r in lib.open().collect()} == rows
    assert lib.vacuum() > 20 and len(parts()["content"]) == 1 and spark.read.parquet(*parts()["content"]).count() == 19 and not glob.glob(f"{path}/gone/*")
    assert lib.compact() == 0 and lib.vacuum() == 0


def test_two_writers(spark, tmp_path):
    lib = Library(spark, str(tmp_path), KEY)
    lib.append(*_rows(spark, 1))
    state = lib._state()
    lib.append(*_rows(spark, 2))
    with pytest.raises(RuntimeError):
        lib._commit(state, 1)
    assert lib.version() == 2 and sorted(r.id for r in lib.index().collect()) == [1, 2] and not glob.glob(f"{tmp_path}/versions/.2-*")


def test_key_is_not_in_the_plan(spark, tmp_path):
    lib = Library(spark, str(tmp_path), KEY)
    lib.append(*_rows(spark, 1))
    assert KEY not in lib.open()._jdf.queryExecution().toString()


def test_names_of_the_truth_end_at_a_stop_word(spark):
    docs = spark.createDataFrame([(1, "Requerente: Maria Pereira de Lima CERTIFICO que"), (2, "Autor: José Dias Souza Servidor")], "doc_id long, text string")
    assert {(r.doc_id, r.name) for r in gold.gold_names(docs).collect()} == {(1, "Maria Pereira de Lima"), (2, "José Dias Souza")}


def test_numbers_masks_and_payload(spark):
    values = [("PERSON", "Ana Lima"), ("PERSON", "Rui Paz"), ("CPF_BR", "1"), ("PERSON", "ANA LIMA"), ("PHONE_NUMBER", "9"), ("PHONE_NUMBER_BR", "8"), (None, None)]
    e = spark.createDataFrame([([(t, x, i, i + 1, 1.0) for i, (t, x) in enumerate(values)],), ([],)], "entities array<struct<type:string,text:string,start:int,end:int,score:double>>")
    assert [r[0] for r in e.select(masking.numbers(F.col("entities"))).collect()] == [[1, 2, 1, 1, 1, 2, 1], []]
    docs = spark.createDataFrame([(1, "abc"), (2, "")], "doc_id long, text string")
    rows = spark.createDataFrame([(1, "CPF_BR", "b", 1, 2, 0.5), (1, "CPF_BR", "a", 0, 1, 0.5)], "doc_id long, type string, text string, start int, end int, score double")
    got = {r.doc_id: ([x.text for x in r.entities], r.counts, r.chars) for r in evaluate.run_payload(docs, rows).collect()}
    assert got == {1: (["a", "b"], {"CPF_BR": 2}, 3), 2: ([], {}, 0)}


def test_placeholders_that_do_not_follow_are_told(spark):
    shape = "doc_id long, anonymized_text string, entities array<struct<type:string,text:string,start:int,end:int,score:double>>"
    e = [("PERSON", "Ana Lima", 0, 8, 1.0), ("PERSON", "Rui Paz", 9, 16, 1.0), ("PERSON", "ANA LIMA", 20, 28, 1.0)]
    rows = [(1, "[PESSOA_1] [PESSOA_2] e [PESSOA_1]", e), (2, "[PESSOA_1] [PESSOA_1] e [PESSOA_1]", e), (3, "[PESSOA_1]", e), (4, "nada [X_1]", [])]
    got = {r.doc_id: r.reason for r in session.check_labels(spark.createDataFrame(rows, shape)).collect()}
    assert got[1] is None and got[4] is None and got[2].startswith("placeholder 2 ") and got[3].startswith("placeholder 2 ")


def test_whole_detection_on_the_given_documents(spark):
    """The masked text is the text with the entities' places replaced, for every document of the table."""
    from spanveil.plans.anonymize import anonymize

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = anonymize(docs).join(docs.withColumnRenamed("text", "given"), "doc_id").collect()
    assert len(rows) == docs.count() and any(r.entities for r in rows)
    for r in rows:
        text, at = [], 0
        numbers: dict = {}
        for e in r.entities or []:
            assert r.given[e.start : e.end] == e.text
            text.append(r.given[at : e.start])
            label = {"EMAIL_ADDRESS": "EMAIL", "ENDERECO_BR": "ENDEREÇO"}[e.type]
            own = numbers.setdefault(label, {})
            text.append(f"[{label}_{own.setdefault(e.text.lower(), len(own) + 1)}]")
            at = e.end
        assert r.anonymized_text == (None if r.given is None else "".join(text) + r.given[at:])


def test_guard_by_runs_is_the_guard_by_patterns(spark):
    """A value is found by its first run wherever its pattern matches: glued to the other kind, in other case, between marks."""
    forbidden = spark.createDataFrame([("s", "CPF_BR", "111.222"), ("s", "PERSON", "José Ássis"), ("s", "PERSON", "Ana"), ("s", "CAMINHO", "/home/ana1/x"), ("s", "PERSON", "K2 Sul"), ("t", "PERSON", "Rui")], "session_id string, type string, value string")
    texts = ["CPF111.222 x", "1111.222", "jose  assis", "JOSÉ ÁSSIS!", "Fernanda", "ana", "ANA1", "xx/home/ANA1/x", "k2  SUL", "ak2 sul", "Rui", "", None, "JO\u017fÉ A\u017f\u017fis", "(Ana)"]
    out = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "id long, session_id string, text string")
    got = {(r.id, r.type) for r in session.guard_hits(out, forbidden).collect()}
    assert got == {(0, "CPF_BR"), (2, "PERSON"), (3, "PERSON"), (5, "PERSON"), (6, "PERSON"), (7, "CAMINHO"), (7, "PERSON"), (8, "PERSON"), (13, "PERSON"), (14, "PERSON")}
