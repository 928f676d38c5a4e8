"""Each stage of the pipeline on small tables with nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanveil.llm import chat_format, kd_sharding, language_crf, pivot_search, secret_scan, substring_dedup

SF = "/root/testdata/sf0.001"
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of names that the operators use inside.
CLASHING = "h long, gone string, lines int, row string, w double, sig int, rep int, key string, token string, thin boolean, group int, length int, chunk string, spans string, node int, hot int, doc int"
STAGES = dict(corpus_pipeline.STAGES)


def _sentence(rng, words, n=14):
    return " ".join(rng.choice(words) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(21)
    words = {"aa": ["kato", "lumi", "sano", "veli", "nuku", "tarvu", "mielo"], "bb": ["xorq", "zyrt", "wqen", "pluz", "vrax", "kwyx", "brol"]}
    rows = [(i, "\n".join(_sentence(rng, words[c]) for _ in range(3)), c) for i in range(60) for c in [("aa", "bb")[i % 2]]]
    rows += [(100, rows[0][1], None), (101, rows[4][1] + "\nkato lumi", "aa"), (102, None, "aa"), (103, "", None), (104, " \n\t", "bb"), (105, "12 + 7 = 19", None), (106, "lumi", None)]
    rows += [(107, " ".join(rng.choice(words["aa"]) for _ in range(150_000)), "aa"), (0, rows[0][1], "aa"), (None, "kato sano veli nuku lumi", "aa"), (108, "это совсем другой язык которого никто не учил", None)]
    return [(d, t, c, "web", None if t is None else len(t)) for d, t, c in rows]


@pytest.fixture(scope="module")
def table(spark, documents):
    return spark.createDataFrame(documents, SHAPE)


@pytest.fixture(scope="module")
def clashing(spark, documents):
    extra = [t.split()[1] for t in CLASHING.split(", ")]
    fill = {"long": 1, "string": "x", "int": 2, "double": 0.5, "boolean": True}
    return spark.createDataFrame([(*r, *(fill[k] for k in extra)) for r in documents], f"{SHAPE}, {CLASHING}")


def _by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.mark.parametrize("name", list(STAGES))
def test_columns_and_empty_tables(spark, table, clashing, name):
    """All stages but the last keep the columns, whatever their names; an empty table stays empty."""
    last = name == corpus_pipeline.STAGES[-1][0]
    out = STAGES[name](spark, clashing, SF)
    assert last or out.columns == clashing.columns
    plain = STAGES[name](spark, table, SF)
    key = lambda df: sorted((str(r.doc_id), hashlib.md5(str(r.ids_crc32 if last else r.text).encode()).hexdigest()) for r in df.collect())
    assert key(out) == key(plain)
    none = STAGES[name](spark, table.where("false"), SF)
    assert none.count() == 0 and (last or none.columns == table.columns)


def test_language_stage(spark, table, documents):
    got = STAGES["language_id"](spark, table, SF).collect()
    assert {d for d, t, c, *_ in documents if c and t and t.strip()} | {100, 106} == {r.doc_id for r in got}
    assert sum(r.doc_id == 0 for r in got) == 2 and all(r.n_chars == len(r.text) for r in got)


def test_line_stage(spark, table, documents):
    """Removal is judged on the input: exact repeats of earlier documents go, their documents with them; lines alike by one word too."""
    got = _by_id(STAGES["line_dedup"](spark, table, SF))
    assert 100 not in got and got[0].text == documents[0][1] and got[101].text == "kato lumi" and got[101].n_chars == 9
    assert {102, 103, 104, 105, 106, 107} <= set(got) and got[102].text is None and got[107].text == next(t for d, t, *_ in documents if d == 107)
    assert None in got


def test_near_stage(spark, table):
    got = STAGES["near_dedup"](spark, table, SF).collect()
    ids = [r.doc_id for r in got]
    assert 100 not in ids and ids.count(0) == 2 and {102, 103, 104, 105, 106, 107, None} <= set(ids)


def test_leak_stage(spark, table, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = [(200 + i, f"before it\n{t} and after it", None, "x", 1) for i, (_, t) in enumerate(items)]
    got = STAGES["decontamination"](spark, table.unionByName(spark.createDataFrame(leaks, SHAPE)), SF).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, *_ in documents)


def test_pack_stage(spark, table, documents):
    got = STAGES["packing"](spark, table, SF).collect()
    assert {r.doc_id for r in got} == {d for d, *_ in documents}
    ends: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length


def test_whole_run(spark):
    assert len({(r.doc_id, r.piece) for r in corpus_pipeline.run(spark, SF).collect()}) > 100


#: Those that no stage covers, and results that a stage does not show.
OPERATORS = {
    "substring_dedup": lambda spark, d: substring_dedup.remove_repeats(d, with_text=True),
    "secret_scan": lambda spark, d: secret_scan.scan_secrets(d),
    "language_crf": lambda spark, d: language_crf.identify_language(d),
    "kd_sharding": lambda spark, d: kd_sharding.shard_by_tree(d, 4).drop("slot"),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_operators_ignore_other_columns_and_take_empty_tables(spark, table, clashing, name):
    run = OPERATORS[name]
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(run(spark, clashing)) == rows(run(spark, table))
    assert run(spark, table.where("false")).count() == 0


def test_chats_and_vectors(spark):
    chats = spark.createDataFrame([(1, 0, "User: hi", "user", 7, "x"), (1, 1, "fine.", "assistant", 7, "x"), (1, 1, "fine.", "assistant", 7, "x"), (None, 0, "a", "user", 7, "x")], "conv_id long, turn long, text string, role string, seg int, tie string")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(chat_format.format_chats(chats)) == rows(chat_format.format_chats(chats.drop("seg", "tie"))) and chat_format.format_chats(chats).count() == 3
    assert chat_format.format_chats(chats.where("false")).count() == 0
    rng = random.Random(1)
    vectors = spark.createDataFrame([(i, [rng.random() - 0.5 for _ in range(4)], 1, 2) for i in range(120)] + [(50, [0.1] * 4, 1, 2)], "vec_id long, embedding array<float>, dim int, pair int")
    got = pivot_search.top_k(vectors)
    assert rows(got) == rows(pivot_search.top_k(vectors.drop("dim", "pair"))) and got.count() == 15
    assert pivot_search.top_k(vectors.where("false")).count() == 0
    assert pivot_search.top_k(vectors.withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 0


def test_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    from spanveil.llm import shared

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared.shared_dir(Session)
