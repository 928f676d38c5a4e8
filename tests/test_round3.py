"""Joins that must not be broadcast, matches by marks, and shapes of patterns."""

import re

from pyspark.sql import functions as F

from spanveil.functions import text as T
from spanveil.operators import dictionary, gold
from spanveil.operators import patterns as P


def test_search_of_terms_broadcasts_nothing(spark):
    texts = spark.createDataFrame([(1, 1, "a Ana Maria b"), (2, 1, "nada")], "key int, text_id int, text string")
    terms = spark.createDataFrame([(1, "ana maria")], "key int, value string")
    found = dictionary.candidates(texts, terms, "key")
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.pos, r.n) for r in found.collect()] == [(2, 3)]


def test_truth_broadcasts_no_text(spark):
    docs = spark.createDataFrame([(1, "Requerente: Ana Souza Lima, CPF 529.982.247-25")], "doc_id long, text string")
    truth = gold.build_gold(docs)
    assert "BroadcastExchange" not in truth._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.type for r in truth.collect()) == ["CPF", "PERSON"]


def test_marked_matches_are_the_matches(spark):
    texts = ["", "x", "12 ab 345", "7", " 12 \U0001f600 33", "á1é22"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: [(x.m, x.a) for x in r.found] for r in rows.select("id", T.marked_matches(T.unmarked(F.col("text")), r"\d+").alias("found")).collect()}
    assert got == {i: [(m.group(), m.start()) for m in re.finditer(r"\d+", t)] for i, t in enumerate(texts)}


def test_word_lists_as_tries(spark):
    words = ["re", "reu", "rei", "a", "mato grosso", "mato grosso do sul", "dt."]
    seen = spark.createDataFrame([(w,) for w in [*words, "r", "mato", "dtx", "reus", ""]], "w string")
    assert sorted(r.w for r in seen.where(T.one_of(F.col("w"), words)).collect()) == sorted(words)


def test_shapes_hold_for_every_match(spark):
    """With its shape a pattern finds what it finds without; validators and contexts are read once in a plan."""
    from dataclasses import replace

    text = "CPF 529.982.247-25, 52998224725; CEP 60.175-045, 60175-047; +55 85 91234-5678 (85) 3222-1111 nascido em 01/02/1980; 0001234-55.2019.8.06.0001; 11.222.333/0001-81 PIS 120.12345.67-8 RG 12.345.678-9 Ag 1234 CC 56789-0 ٥٢٩.٩٨٢.٢٤٧-٢٥ 1"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = lambda specs: sorted(tuple(s) for s in P.detect(docs, specs=specs, threshold=0.0).first().spans)
    with_shapes = spans(P.REGISTRY)
    assert with_shapes == spans([replace(s, shape="") for s in P.REGISTRY]) and len({s[2] for s in with_shapes}) >= 9
