"""Texts that are folded as a whole have the tokens that folding one by one gives."""

from pyspark.sql import functions as F

from spanveil.functions.text import _MARKED
from spanveil.operators import dictionary as D
from spanveil.operators.session import LABEL

ODD = [
    "", " ", "Ana  Lima\n\n\tSÁ", "[PESSOA_1] Ana [PESSOA_1", "x[CPF_12]y", "ΟΔΟΣ.ΑΒ ΟΔΟΣ", "é Éx ́", "İstanbul ISTANBUL ıi", "ſs Kelvin K", "Ⅷ ⅷ Ⓐ ٣4",
    "\U0001f600a\U00010400b", "\x0b\x0c\x1c  　z", "\r\n \r", "Straße ǅ Ǆ ᾼ", _MARKED, _MARKED.upper(), "a_b-c.12,5", "[", "[[A_1]]",
]


def test_whole_texts_fold_as_their_tokens(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "i int, text string")
    for protected in (None, LABEL):
        one_by_one = D.compared(D.tokens(F.col("text"), protected), protected)
        for r in rows.select("text", D.compared_text(F.col("text"), protected).alias("got"), one_by_one.alias("want")).collect():
            assert r.got == r.want, (protected, r.text)


def test_plain_texts_are_folded_at_once(spark):
    rows = spark.createDataFrame([("Ana Lima",)], "text string")
    plan = D.candidates(rows.selectExpr("1 AS k", "1 AS text_id", "text"), rows.selectExpr("1 AS k", "text AS value"), "k")
    assert "regexp_replace(lower(translate(text" in plan._jdf.queryExecution().optimizedPlan().toString()
