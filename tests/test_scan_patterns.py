"""The forms that texts are searched by find what the patterns themselves find, at less cost."""

import random
import time
from dataclasses import replace

from pyspark.sql import functions as F

from spanveil.operators.patterns import REGISTRY, _ROLES, _matches

_MADE = [s for s in REGISTRY if s.first or s.scan]
_PARTS = [
    *_ROLES.replace("[ÍI]", "Í").replace("[íi]", "í").replace("[ÉE]", "É").replace("[ée]", "é").split("|"), "ADVOGADO (a) : Ana de Sá", ": Rui Dá Só", "réu:", "ſ", "ı", "K",
    "a.b@c.de", "a@b.co1x@c.de", "x@y.comz@w.org", "@", "é@b.br", "%+-@a-b.c.dd", "A@B.COM", "a@b.c", "123.456.789-09", "123 456 789 - 09", "I23.4S6.78q-0O", "60000-123", "-60000-123",
    "1234567-12.2019.8.06.1234", "nascido em 01/02/1990", "Dt. Nasc.: 3", "data de nascimento 01/02/1990", "RG n° 12.345.678-9 SSP", "identidade 2001 ", "cédula de identidade: 123456-X", " ", "\n", ".", "٣", "1", "/",
]


def test_scans_find_the_same_matches(spark):
    pick = random.Random(7)
    texts = [pick.choice(["", " "]).join(pick.choice([str, str.lower, str.upper, str.title])(pick.choice(_PARTS)) for _ in range(12)) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    rows = []
    for s in _MADE:
        plain = replace(s, first="", scan="")
        one, two = _matches(F.col("t"), s.whole()), _matches(F.col("t"), plain.whole())
        rows.append(F.struct(F.count_if(~one.eqNullSafe(two)).alias("differ"), F.sum(F.size(two)).alias("found")).alias(s.name))
    for name, r in df.agg(*rows).first().asDict().items():
        assert r["differ"] == 0 and r["found"] > 0, (name, r)


def test_a_long_run_of_letters_is_passed_once(spark):
    email = next(s for s in REGISTRY if s.name == "email_tld_grudado")
    df = spark.range(1).select(F.concat(F.repeat(F.lit("a"), 60_000), F.lit(" x@y.br")).alias("t"))
    began = time.perf_counter()
    assert df.select(F.size(_matches(F.col("t"), email.whole()))).first()[0] == 1
    assert time.perf_counter() - began < 10
