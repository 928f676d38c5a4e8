"""The pipeline's language stage decodes with the field it fits."""

import corpus_pipeline
from spanveil.llm import language_crf


def test_stage_decodes_texts(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    field = language_crf.fit_on(docs)
    calls = []
    real = language_crf.label_shares
    monkeypatch.setattr(language_crf, "label_shares", lambda f, p: calls.append(1) or real(f, p))
    rows = docs.where("text is not null").limit(50).toArrow().to_batches()
    kept = sum(b.num_rows for b in language_crf._learned(field, "text")(iter(rows)))
    assert calls and 0 < kept <= 50


def test_stage_keeps_the_rows_with_a_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns
    predicted = language_crf.with_language(docs).where("lang_pred <> 'und'")
    assert kept.join(predicted, "doc_id", "left_anti").count() == 0
    assert kept.count() > 0.9 * predicted.count()
