"""Streams against the batch forms: numbers, expiry, restarts, chunks of texts, and batches that come again."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from spanveil.operators import session
from spanveil.streaming import pseudonyms


@pytest.fixture(autouse=True)
def keyed_state(spark):
    pseudonyms.use_keyed_state(spark)


def _stream(spark, tmp_path, name, rows, schema, size=2):
    """A stream of files of ``size`` rows, in order."""
    folder = tmp_path / name
    folder.mkdir()
    for n, i in enumerate(range(0, len(rows), size)):
        file = folder / f"{n:03}.json"
        file.write_text("\n".join(json.dumps(r) for r in rows[i : i + size]))
        os.utime(file, (1_700_000_000 + n, 1_700_000_000 + n))  # files are read in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def _run(stream, tmp_path, name):
    out = str(tmp_path / f"{name}-out")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(out).collect()


def test_numbers_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    rows = [{"session_id": s, "seq": i, "type": t, "text": x} for i, (s, t, x) in enumerate([("a", "PERSON", "Ana Lima"), ("b", "PERSON", "Rui Paz"), ("a", "CPF_BR", "1"), ("a", "PERSON", "ANA  LIMA"), ("a", "PERSON", "Rui Paz"), ("b", "PERSON", "rui paz"), ("a", "CPF_BR", "2")])]
    schema = "session_id string, seq long, type string, text string"
    got = {(r.session_id, r.label, r.norm_value, r.n, r.first_value) for r in _run(pseudonyms.stream_pseudonyms(_stream(spark, tmp_path, "p", rows, schema)), tmp_path, "p")}
    batch = spark.createDataFrame([tuple(r.values()) for r in rows], schema).select("session_id", F.col("seq").alias("ord"), F.col("seq").cast("int").alias("start"), "type", "text")
    want = {(r.session_id, r.label, r.norm_value, r.n, r.first_value) for r in session.session_pseudonyms(batch).collect()}
    assert got == want and len(got) == 5


ENTITIES = "session_id string, seq long, type string, text string"


def test_numbers_go_on_after_a_restart(spark, tmp_path):
    """One checkpoint, stopped and started between files: what was known keeps its number, new values get the next ones."""
    values = [f"Nome {i % 7} Sobrenome" for i in range(40)]
    rows = [{"session_id": "s" if i % 3 else "t", "seq": i, "type": "PERSON", "text": v} for i, v in enumerate(values)]
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    for part in range(4):
        file = folder / f"{part}.json"
        file.write_text("\n".join(json.dumps(r) for r in rows[part * 10 : part * 10 + 10]))
        os.utime(file, (1_700_000_000 + part, 1_700_000_000 + part))
        stream = pseudonyms.stream_pseudonyms(spark.readStream.schema(ENTITIES).json(str(folder)))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.session_id, r.norm_value, r.n) for r in spark.read.parquet(out).collect())
    batch = spark.createDataFrame([tuple(r.values()) for r in rows], ENTITIES).select("session_id", F.col("seq").alias("ord"), F.lit(0).alias("start"), "type", "text")
    assert got == sorted((r.session_id, r.norm_value, r.n) for r in session.session_pseudonyms(batch).collect()) and len(got) == 14


def test_numbers_of_a_quiet_session_expire(spark, tmp_path):
    folder, got = tmp_path / "in", {}
    folder.mkdir()
    stream = pseudonyms.stream_pseudonyms(spark.readStream.schema(ENTITIES).json(str(folder)), ttl_ms=12_000)
    keep = lambda df, n: got.update({r.first_value: r.n for r in df.collect()})
    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    try:
        for part, name in enumerate(["Ana Lima", "Rui Paz", "Bia Sá"]):
            if part == 2:
                time.sleep(16)
            aside = tmp_path / f"{part}.json"
            aside.write_text(json.dumps({"session_id": "s", "seq": part, "type": "PERSON", "text": name}))
            aside.rename(folder / f"{part}.json")
            until = time.time() + 60
            while time.time() < until and len(got) == part:
                time.sleep(0.5)
    finally:
        query.stop()
    # Two names in time count on; the third comes after the session has ended.
    assert got == {"Ana Lima": 1, "Rui Paz": 2, "Bia Sá": 1}


REPLY = "oi [PESSOA_1], [x] [[CPF_1] e [PESSOA_77]! [ENDEREÇO_2][PESSOA_1 [LOCAL_DE_X_3] [PESSOA"


def merged(pieces):
    """Neighbouring texts as one piece."""
    out = []
    for kind, text, value in pieces:
        if out and kind == out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + text, None)
        else:
            out.append((kind, text, value))
    return out


def test_every_cutting_of_a_reply_gives_its_pieces(spark, tmp_path):
    draw = random.Random(1)
    cuts = [[i] for i in range(len(REPLY) + 1)] + [sorted(draw.sample(range(len(REPLY)), 12)) for _ in range(20)] + [list(range(1, len(REPLY)))]
    rows = []
    for c, places in enumerate(cuts):
        parts = [REPLY[a:b] for a, b in zip([0, *places], [*places, len(REPLY)])]
        rows += [{"id": str(c), "session_id": "s", "seq": i, "delta": d, "last": i == len(parts) - 1} for i, d in enumerate(parts)]
    rows.sort(key=lambda r: r["seq"])
    known = spark.createDataFrame([("s", "PESSOA", 1, "Ana"), ("s", "CPF", 1, "111"), ("s", "ENDEREÇO", 2, "Rua"), ("t", "PESSOA", 77, "Rui")], "session_id string, label string, n int, first_value string")
    stream = _stream(spark, tmp_path, "r", rows, "id string, session_id string, seq long, delta string, last boolean", size=300)
    got = {}
    for r in sorted(_run(pseudonyms.stream_rehydrate(stream, known), tmp_path, "r"), key=lambda r: (r.id, r.pos)):
        got.setdefault(r.id, []).append((r.kind, r.text, r.value))
    whole = session.rehydrate(spark.createDataFrame([("w", "s", REPLY)], "id string, session_id string, text string"), known)
    want = [(r.kind, r.text, r.value) for r in sorted(whole.collect(), key=lambda r: r.pos)]
    assert len(got) == len(cuts) and all(merged(g) == want for g in got.values())


def test_what_waits_is_short():
    rest, seen = "", 0
    for c in "[" * 50 + "[A" + "_B" * 200 + "[PESSOA_" + "1" * 300 + "]" + REPLY:
        done, rest = pseudonyms.pieces_of(rest + c, False)
        seen += sum(len(t) for _, t in done)
        assert len(rest) < pseudonyms.LONGEST
    assert seen + len(rest) == 50 + 2 + 400 + 8 + 301 + len(REPLY)
    assert pseudonyms.pieces_of("[PESSOA", True) == ([("text", "[PESSOA")], "")


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    """The stream fails between its two sinks; after the restart each row is there once."""
    rows = [{"doc_id": i, "text": None if i % 3 == 0 else f"fale com a{i}@b.com"} for i in range(8)]
    good, bad = pseudonyms.batch_sink(str(tmp_path / "good")), pseudonyms.batch_sink(str(tmp_path / "bad"))
    failed = []

    def shaky(df, number):
        if number == 1 and not failed:
            failed.append(number)
            raise OSError("sink is away")
        bad(df, number)

    stream = _stream(spark, tmp_path, "b", rows, "doc_id long, text string")
    start = lambda: pseudonyms.anonymize_stream_safe(stream, good, shaky, str(tmp_path / "b-state"), True, entities=["EMAIL_ADDRESS"])
    with pytest.raises(Exception, match="sink is away"):
        start().awaitTermination()
    assert failed == [1] and sorted(r.doc_id for r in pseudonyms.batch_rows(spark, str(tmp_path / "good")).collect()) == [1, 2]
    start().awaitTermination()
    assert sorted(r.doc_id for r in pseudonyms.batch_rows(spark, str(tmp_path / "good")).collect()) == [1, 2, 4, 5, 7]
    assert sorted((r.doc_id, r.batch) for r in pseudonyms.batch_rows(spark, str(tmp_path / "bad")).collect()) == [(0, 0), (3, 1), (6, 3)]


def test_bad_documents_of_a_stream_go_to_their_own_sink(spark, tmp_path):
    rows = [{"doc_id": 1, "text": "fale com a@b.com"}, {"doc_id": 2, "text": " "}, {"doc_id": None, "text": "x"}, {"doc_id": 4, "text": "nada"}]
    good, bad = [], []
    stream = _stream(spark, tmp_path, "s", rows, "doc_id long, text string")
    query = pseudonyms.anonymize_stream_safe(stream, lambda df, n: good.extend(df.collect()), lambda df, n: bad.extend(df.collect()), str(tmp_path / "s-state"), True, entities=["EMAIL_ADDRESS"])
    query.awaitTermination()
    assert {r.doc_id: r.anonymized_text for r in good} == {1: "fale com [EMAIL_1]", 4: "nada"} and {r.reason for r in bad} == {"empty text", "no id"}


