"""The short ways that most texts take give what the long ways give, at less cost."""

import random
import time
from dataclasses import replace

from pyspark.sql import functions as F

from spanveil.functions import text as T
from spanveil.functions.masks import STREET_TYPES
from spanveil.operators import names as N
from spanveil.operators import patterns as P
from spanveil.operators.fuse import fuse, fuse_spans
from spanveil.plans.anonymize import anonymize

_WORDS = ["Ana", "JOSÉ", "Conceição", "de", "Da", "e", "Tribunal", "São", "Paulo", "Mato Grosso do Sul", "Vistos", "Para", "processo,", "Lima", "d'Ávila", "O'Neil", "x", " ", "\t", "\u0085", "İ", "K", "á", "Réu", "acre"]


def _phrases(spark):
    pick = random.Random(5)
    made = sorted({"".join(pick.choice(_WORDS) + pick.choice([" ", " ", " ", "", "  "]) for _ in range(pick.randint(1, 6))) for _ in range(4000)})
    return spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, t string").repartition(4)


def test_whole_names_are_those_of_the_tokens(spark):
    t = F.col("t")
    marked = T.without_accents(F.lower(F.regexp_replace(t, r"^(?U)\s+|(?U)\s+$", "")))
    long = T.let(P.tokens_with_gaps(t), P._name_length)
    got = _phrases(spark).agg(F.count_if(~P.cut_labelled_name(t).eqNullSafe(long)).alias("a"), F.count_if(T.norm(t) != marked).alias("b"), F.count_if(T.norm(t).rlike(P._WHOLE_NAME)).alias("n"), F.count_if(long.isNull()).alias("nulls")).first()
    assert (got.a, got.b) == (0, 0) and got.n > 50 and got.nulls > 50


def test_whole_names_cost_less(spark):
    names = spark.range(60_000, numPartitions=4).select(F.concat(F.lit("Alano da Moura "), F.element_at(F.array(F.lit("Barros"), F.lit("Dutra")), (F.col("id") % 2 + 1).cast("int"))).alias("t"))
    long = T.let(P.tokens_with_gaps(F.col("t")), P._name_length)

    def seconds(c):
        began = time.perf_counter()
        assert names.agg(F.sum(c)).first()[0] == 60_000 * 20 + 30_000
        return time.perf_counter() - began

    seconds(long), seconds(P.cut_labelled_name(F.col("t")))
    assert seconds(P.cut_labelled_name(F.col("t"))) < 0.6 * seconds(long)


def test_whole_blocks_and_edges(spark):
    rows = _phrases(spark).withColumn("v", T.search_view(F.col("t"))).withColumn("s", F.array(F.struct(F.lit(0).alias("start"), F.length("t").alias("end"), F.lit("PERSON").alias("type"), F.lit(0.8).alias("score"))).cast(P.SPANS))
    v, s = F.col("v"), F.col("s")
    once = rows.withColumn("s", N.trim_spans(v, s)).localCheckpoint()
    edges = once.where("size(s) = 1").select(F.substr("v", F.get("s", F.lit(0))["start"] + 1, F.get("s", F.lit(0))["end"] - F.get("s", F.lit(0))["start"]).alias("t"))
    edges = edges.agg(F.count("*").alias("n"), F.count_if(~F.col("t").rlike(r"^(?s)[\p{L}\p{Nd}].*[\p{L}\p{Nd}]$")).alias("bad")).first()
    assert edges.n > 100 and edges.bad == 0
    whole, N._WHOLE_BLOCK = N._WHOLE_BLOCK, "(?!)"
    try:
        long = N.clip_institutions(v, s)
    finally:
        N._WHOLE_BLOCK = whole
    got = once.agg(F.count_if(~N.clip_institutions(v, s).eqNullSafe(long)).alias("differ"), F.count_if(T.norm(T.search_view(F.col("t"))).rlike(whole)).alias("n"), F.count_if(F.size(long) == 0).alias("gone")).first()
    assert got.differ == 0 and got.n > 50 and got.gone > 50


def test_street_types_by_letters(spark):
    pick = random.Random(3)
    kinds = [k.replace("\\", "") for k in STREET_TYPES.split("|")]
    texts = [pick.choice(["", "x", "\n"]).join(pick.choice([str, str.lower, str.upper])(pick.choice([*kinds, " ", " Sol 12", "; ", ". A", " CEP", "ſítio A", "Pra", "al", "é"])) for _ in range(9)) for _ in range(2000)]
    old = rf"(?iuUsm)\b(?:{STREET_TYPES})\s+[A-ZÁÀÂÃÉÊÍÓÔÕÚÇ0-9][^\n;]{{2,80}}?(?=\s*(?:;|CEP|[Ff]one|[Tt]el|[Ee]-?mail|$|\.\s+[A-ZÁÉÍÓÚ]))"
    new = next(s for s in P.REGISTRY if s.name == "logradouro").whole()
    got = spark.createDataFrame([(t,) for t in texts], "t string").agg(F.count_if(P._matches(F.col("t"), old) != P._matches(F.col("t"), new)).alias("differ"), F.sum(F.size(P._matches(F.col("t"), old))).alias("n")).first()
    assert got.differ == 0 and got.n > 100


def test_spans_without_scores_are_the_same(spark):
    docs = spark.createDataFrame([(1, "Requerente: Ana Souza Lima, CPF 529.982.247-25. nascido em 01/02/1980, em 02/03/1999 CEP: 60175-047. Falou ANA SOUZA LIMA"), (2, None)], "doc_id long, text string")
    by = lambda **o: {(s.type, s.start, s.end): s.score for r in P.detect(docs, **o).collect() for s in r.spans}
    all_, few = by(), by(scores=False)
    assert set(all_) == set(few) and ("DATE_OF_BIRTH", 59, 69) in few and all(few[k] <= all_[k] for k in few) and few != all_
    rows = lambda **o: [(r.doc_id, r.anonymized_text, [(e.type, e.text, e.start) for e in r.entities]) for r in anonymize(docs, **o).orderBy("doc_id").collect()]
    assert rows() == rows(scores=False) and len(rows()[0][2]) >= 4
    # A name below the score from which on it is looked for elsewhere still gets what its context adds.
    weak = [replace(P.REGISTRY[-2], score=0.36, context=("parte",))]
    docs = spark.createDataFrame([(1, "parte Requerente: Ana Souza Lima. Falou ANA SOUZA LIMA")], "doc_id long, text string")
    assert len(rows(specs=weak)[0][2]) == 2 and rows(specs=weak) == rows(specs=weak, scores=False)


def test_spans_apart_and_mixed(spark):
    pick = random.Random(9)
    docs = []
    for i in range(400):
        text, spans = "".join(pick.choice("abc \n") for _ in range(60)), []
        for _ in range(pick.randint(0, 4)):
            a = pick.randint(0, 55)
            spans += [(a, a + pick.randint(1, 12), pick.choice(["PERSON", "CPF_BR", "ODD"]), pick.random())] * pick.randint(1, 2)
        docs.append((i, text, spans))
    df = spark.createDataFrame(docs, f"doc_id long, text string, spans {P.SPANS}")
    one = fuse_spans(df, F.col("text")).select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.type", "e.start", "e.end", "e.score")
    two = fuse(P.exploded(df), df)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) and one.count() > 300


def test_terms_are_denied_where_a_text_has_them(spark):
    docs = spark.createDataFrame([(1, "Autor: Ministério-Público Ana Lima"), (2, "Autor: Ana Souza Lima"), (3, "Autor: Lima Souza Costa")], "doc_id long, text string")
    got = {r.doc_id: [e.text for e in r.entities] for r in anonymize(docs, deny={"PERSON": ["lima"], "*": ["ana souza lima"]}).collect()}
    assert got[2] == [] and got[3] == ["Souza Costa"]
