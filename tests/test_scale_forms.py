"""Sketches of parts, pages of large files, and names of the truth, against the plain forms."""

import random

import pytest
from pyspark.sql import functions as F

from spanveil.operators import evaluate, gold, sketches
from spanveil.sources import pages


@pytest.fixture(scope="module")
def runs(spark):
    made = lambda lo, hi, kind: spark.range(lo, hi).select((F.col("id") % 7).alias("day"), F.lit(kind).alias("type"), F.concat(F.lit("Nome "), (F.col("id") * 7 % 50_000).cast("string")).alias("text"))
    return made(0, 60_000, "PERSON").unionByName(made(0, 50, "CPF_BR")), made(30_000, 50_000, "PERSON").unionByName(made(0, 9, "RG_BR"))


def test_sketches_of_parts_are_those_of_the_whole(spark, runs):
    new, _ = runs
    parts, whole = sketches.value_sketches(new, "day"), sketches.value_sketches(new)
    got = {r.type: (r.n, r.n_values) for r in sketches.distinct_estimates(parts).collect()}
    assert got == {r.type: (r.n, r.n_values) for r in sketches.distinct_estimates(whole).collect()}
    exact = {r.type: r.n_values for r in evaluate.distinct_values(new).collect()}
    assert set(got) == set(exact) and all(abs(got[t][1] - exact[t]) <= max(1, 0.05 * exact[t]) for t in exact) and got["CPF_BR"] == (50, 50)
    by_day = {(r.day, r.type): r.n_values for r in sketches.distinct_estimates(parts, "day").collect()}
    assert len(by_day) == 14 and all(abs(n - 8_571) < 500 for (_, t), n in by_day.items() if t == "PERSON")


def test_runs_compared_by_sketches(spark, runs):
    new, old = runs
    got = {r.type: (r.only_new, r.only_old, r.both) for r in sketches.compared_estimates(sketches.value_sketches(new, "day"), sketches.value_sketches(old, "day")).collect()}
    assert got["CPF_BR"] == (50, 0, 0) and got["RG_BR"] == (0, 9, 0)
    people = [new, old]
    a, b = ({r[0] for r in df.where("type = 'PERSON'").select("text").distinct().collect()} for df in people)
    want = (len(a - b), len(b - a), len(a & b))
    assert all(abs(x - y) <= 0.03 * len(a | b) for x, y in zip(got["PERSON"], want)) and want[2] == 20_000


def test_pages_of_large_files(spark, tmp_path):
    draw = random.Random(3)
    line = lambda: "".join(draw.choices("abcé ção 12", k=draw.randint(0, 90)))
    body = lambda: "\n".join([line() for _ in range(draw.randint(0, 12))] + draw.choice([[], ["## Parte 2"], ["x ## Página 9"], ["## Página sem número"]]))
    big = "".join(f"## Página {i}{draw.choice(['', ' ', chr(9)])}\n{body()}\n" for i in range(1, 1500))
    files = {"big.md": big, "front.txt": "capa\n## Pá\n" + big[:9_000], "none.txt": "nada\n## P\n" + body(), "short.md": "## Página 7", "empty.txt": ""}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "old.txt").write_bytes(big[:20_000].encode("cp1252"))
    (tmp_path / "other.csv").write_text("## Página 1")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    try:
        frame = pages.read_pages(spark, str(tmp_path))
        got = sorted((r.name, r.start, r.end, r.page_no, r.text) for r in frame.collect())
        split = spark.read.option("lineSep", "\n## P").text(str(tmp_path / "big.md")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    docs = spark.createDataFrame([(n, t) for n, t in [*files.items(), ("old.txt", big[:20_000])] if t], "doc_id string, text string")
    want = sorted((r.doc_id, r.start, r.end, r.page_no, r.text) for r in pages.split_pages(docs).collect())
    assert split > 5 and [g for g in got if g[0] != "empty.txt"] == want and len(want) > 1500


def test_names_of_the_truth_are_found_by_tokens(spark):
    docs = spark.createDataFrame([(1, "Requerente: Maria Pereira de Lima CERTIFICO. Falou MARIA  PEREIRA\nDE LIMA; Pereira de Lima1, xMaria Pereira de Lima, Pereira de Lima")], "doc_id long, text string")
    text = docs.first().text
    found = gold.name_occurrences(docs, gold.gold_names(docs)).collect()
    assert sorted((r.start, r.text) for r in found) == [(12, "Maria Pereira de Lima"), (51, "MARIA  PEREIRA\nDE LIMA"), (text.index("xMaria") + 7, "Pereira de Lima"), (len(text) - 15, "Pereira de Lima")]
    assert all(text[r.start : r.end] == r.text for r in found)


def test_small_files_are_dealt_over_tasks(spark, tmp_path):
    from spanveil.tables import dealt

    rows = spark.range(100).withColumnRenamed("id", "doc_id")
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    rows.repartition(spark.sparkContext.defaultParallelism).write.parquet(str(tmp_path / "many"))
    one, many = spark.read.parquet(str(tmp_path / "one")), spark.read.parquet(str(tmp_path / "many"))
    spread = dealt(one, "doc_id")
    used = {r.p for r in spread.selectExpr("spark_partition_id() AS p").distinct().collect()}
    assert len(used) > 1 and sorted(r.doc_id for r in spread.collect()) == list(range(100))
    assert dealt(many) is many and dealt(one.where("false")).count() == 0


def test_kept_expressions_follow_their_options(spark):
    from spanveil.operators.patterns import detect

    docs = spark.createDataFrame([(1, "ramal 85 98888-7777 hoje"), (2, None)], "doc_id long, text string")
    count = lambda **o: {r.doc_id: len(r.spans) for r in detect(docs, ["PHONE_NUMBER_BR"], **o).collect()}
    scores = lambda **o: [s.score for r in detect(docs, ["PHONE_NUMBER_BR"], **o).where("doc_id = 1").collect() for s in r.spans]
    plain = scores(context={})
    assert count() == {1: 1, 2: 0} and count(threshold=1.01) == {1: 0, 2: 0} and count() == {1: 1, 2: 0}
    assert scores()[0] > plain[0] and scores(context={"PHONE_NUMBER_BR": ("hoje",)}) == plain and scores(context={}) == plain
