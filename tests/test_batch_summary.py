"""The summary of a batch counts what its SQL counts, whatever texts and ids the table holds (F1)."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanveil.plans.anonymize import anonymize_safe

TEXTS = ["Ana ana@x.org", None, "", " ", "   ", "\u00a0", "\u3000 \u2003\u00a0", "\n", "\t \r\n", " x ", "\u200b", "\u0085", "\u1680", "\u202f\u205f", "\ufeff", "\u001f", "\u2028", "\u180e", None, "0"]


def _both(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    base = duckdb.connect()
    base.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    name = "d19_batch_summary"
    return sorted(map(tuple, entry.queries()[name](spark, str(folder)).collect())), sorted(base.sql(entry.oracle_sql()[name]).fetchall())


def test_texts_without_a_letter_and_ids(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (None, None), (None, " "), (-1, "x"), (-5, "x"), (5, "twice"), (5, None)]
    got, want = _both(spark, tmp_path, rows)
    assert got == want and dict(want)["processed"] > 10


def test_outcomes_that_no_document_has(spark, tmp_path):
    for i, rows in enumerate([[], [(1, "x")], [(5, None)], [(1, " ")]]):
        got, want = _both(spark, tmp_path / str(i), rows)
        assert got == want and len(got) == 2


def test_texts_of_spaces_fail_as_empty(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    ok, failed = anonymize_safe(docs, entities=["EMAIL_ADDRESS"])
    assert {r.doc_id: r.reason for r in failed.collect()} == {1: "no text", 18: "no text"} | {i: "empty text" for i in (2, 3, 4, 5, 6, 12, 13)}
    assert ok.agg(F.count("anonymized_text")).first()[0] == len(TEXTS) - 9
