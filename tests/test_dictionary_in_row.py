"""Values that are looked up in each text by itself: the same closings as by joins, and no text or token is shuffled (F2)."""

import random

import pytest
from pyspark.sql import functions as F
from test_dictionary import VALUES, bare, leftmost, longest, made

import __spark_entry__ as entry
from spanveil.operators import dictionary, session

COLUMNS = "session_id string, id int, text string"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _both(texts, names, **options):
    """Rows by joins and by rows, by id."""
    by = lambda few: sorted(((r.session_id or "", r.id), r.closed_text, r.closed, r.examples) for r in session.close_residuals(texts, names, few=few, **options).collect())
    return by(False), by(True)


def test_closing_in_rows_is_the_alternation_and_the_longest_first(spark):
    draw = random.Random(11)
    sessions, texts = {}, []
    for s in range(10):
        values = {" ".join(bare(made(draw)).replace("[pessoa_1]", "").replace("[cpf_12]", "").split())[: draw.randint(3, 14)].strip() for _ in range(14)}
        values = [v for v in sorted(values) if sum(c.isalnum() for c in v) >= 3]
        sessions[f"s{s}"] = {v: f"[PESSOA_{i + 1}]" for i, v in enumerate(values)}
        texts += [(f"s{s}", i, made(draw)) for i in range(25)]
    names = spark.createDataFrame([(s, "PESSOA", v, i + 1) for s, own in sessions.items() for i, v in enumerate(own)], VALUES)
    rows = spark.createDataFrame(texts + [("none", 0, "ana"), ("s1", 99, None), (None, 0, "ana lima"), ("s1", 98, "")], COLUMNS)
    for prefer, form in (("leftmost", leftmost), ("longest", longest)):
        joined, own = _both(rows, names, prefer=prefer)
        assert own == joined and len(own) == len(texts) + 4
        got = {k: closed for k, closed, _, _ in own}
        assert all(got[s, i] == form(text, sessions[s]) for s, i, text in texts)
        assert sum(got[s, i] != text for s, i, text in texts) > 40


def test_values_of_one_token(spark):
    names = [("s", "PESSOA", "josé", 1), ("s", "CPF", "jose", 4), ("s", "PESSOA", "οδος", 2), ("s", "PESSOA", "12345", 3), ("t", "PESSOA", "lima", 1), (None, "PESSOA", "nada", 1), ("s", "PESSOA", "ab", 9), ("s", "PESSOA", "kelvin", 5)]
    texts = ["José JOSE josé josé1 xjose jose", "ΟΔΟΣ οδος ΟΔΟΣ.", "12345 x12345 123456", "[JOSE_1] jose[PESSOA_7]JOSE", "lima ab nada Kelvin", " ", "\n\njose\t\tJOSÉ́ "]
    rows = spark.createDataFrame([(s, i, t) for s in ("s", "t", None) for i, t in enumerate(texts)], COLUMNS)
    joined, own = _both(rows, spark.createDataFrame(names, VALUES))
    assert own == joined and sum(len(closed) > 0 for _, _, closed, _ in own) >= 6


def test_texts_by_themselves_need_no_values(spark):
    rows = spark.createDataFrame([("s", 1, "Ana"), ("s", 2, None)], COLUMNS)
    joined, own = _both(rows, spark.createDataFrame([], VALUES))
    assert own == joined and [r[1] for r in own] == ["Ana", None]


def test_a_large_dictionary_is_joined(spark, monkeypatch):
    names = spark.createDataFrame([("s", "PESSOA", "ana lima", 1), ("s", "PESSOA", "lima de souza", 2)], VALUES)
    rows = spark.createDataFrame([("s", 1, "Ana Lima de Souza, Ana  LIMA")], COLUMNS)
    assert "SortMergeJoin" not in _plan(session.close_residuals(rows, names, few=True))
    joined, own = _both(rows, names)
    monkeypatch.setattr(dictionary, "MOST_IN_ROW", 100)
    assert "SortMergeJoin" in _plan(session.close_residuals(rows, names, few=True))
    assert own == joined == _both(rows, names)[1]


@pytest.mark.parametrize("kinds", [1, 2])
def test_a_dictionary_of_many_pages(spark, kinds):
    """More buckets than a page has, and texts that another projection makes: the dictionary is in no row."""
    ids = spark.range(99, 6_099)
    word = F.concat(F.lit("maria " if kinds == 2 else ""), F.lit("x"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"))
    names = ids.select(F.lit("s").alias("session_id"), F.lit("PESSOA").alias("label"), word.alias("norm_value"), (F.col("id") + 1).cast("int").alias("n"))
    texts = ids.where("id % 3 = 0").select(F.lit("s").alias("session_id"), "id", F.concat(F.lit("Sra. "), F.upper(word), F.lit(" e maria y, xaaaaaaaa")).alias("text"))
    closed = session.close_residuals(texts.withColumn("again", F.length("text")), names, few=True)
    assert "__d" not in _plan(closed) and "Subquery" in _plan(closed)
    bad = closed.where(F.col("closed_text") != F.concat(F.lit("Sra. [PESSOA_"), (F.col("id") + 1).cast("string"), F.lit("] e maria y, xaaaaaaaa")))
    assert closed.count() == 2_000 and bad.count() == 0


def test_known_words_move_no_tokens(spark, tmp_path):
    rows = [(i, ["Ferro velho ferro", "velho FERRO Ação", "Velho é o ferro", "abcd x", None, "Zinco\nVELHO"][i % 6], ["pt", "en", None][i % 3]) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb

    base = duckdb.connect()
    base.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = entry.queries()["x05_known_words"](spark, str(tmp_path))
    assert "SortMergeJoin" not in _plan(found) and "Exchange hashpartitioning(session_id" not in _plan(found) and "__d" not in _plan(found)
    assert sorted(map(tuple, found.collect())) == sorted(base.sql(entry.oracle_sql()["x05_known_words"]).fetchall())
