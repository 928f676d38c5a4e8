"""Windows, joins by position, fusion by a sweep, and coverage, each against one document at a time."""

import random
import time

from pyspark.sql import functions as F

from spanveil.operators import evaluate, intervals, patterns
from spanveil.operators.fuse import fuse, fuse_any, fuse_spans, sweep

SPAN = "doc_id long, start int, end int, type string, score double"


def test_windows(spark):
    for size, overlap in ((1200, 300), (10, 3), (7, 0)):
        texts = ["", "a", "x" * size, "y" * (size + 1), "".join(random.Random(1).choices("abé\n ", k=200 * size + 5))]
        rows = intervals.windows(spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string"), size, overlap).collect()
        for i, text in enumerate(texts):
            own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.win)
            many = 1 if len(text) <= size else -(-(len(text) - overlap) // (size - overlap))
            assert [(r.win, r.start, r.end) for r in own] == [(w, w * (size - overlap), min(w * (size - overlap) + size, len(text))) for w in range(many)]
            assert all(r.text == text[r.start : r.end] for r in own)
            # Cores lie side by side, inside of their windows, and cover the text.
            assert own[0].core_start == 0 and own[-1].core_end == len(text) and all(a.core_end == b.core_start for a, b in zip(own, own[1:]))
            assert all(r.start <= r.core_start <= r.core_end <= r.end for r in own)
        assert not [r for r in rows if r.doc_id == 99]


def test_overlaps_against_all_pairs(spark):
    draw = random.Random(3)
    made = lambda n: [(draw.randint(0, 2), a := draw.randint(0, 30_000), a + draw.choice([0, 1, 5, 300, 9_000])) for _ in range(n)]
    one, two = made(150), made(150)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, start int, end int").withColumn("id", F.monotonically_increasing_id())
    got = sorted((r.doc_id, r.start, r.end, r.a, r.b) for r in intervals.overlapping(frame(one), frame(two)).collect())
    assert got == sorted((d, s, e, a, b) for d, s, e in one for c, a, b in two if c == d and s < e and a < b and a < e and s < b)
    united = intervals.merged(frame(one)).collect()
    points = {(d, p) for d, s, e in one for p in range(s, e)}
    assert {(r.doc_id, p) for r in united for p in range(r.start, r.end)} == points and sum(r.end - r.start for r in united) == len(points)


def test_values_by_blocks(spark):
    text = "".join(random.Random(5).choices("abcé中\n", k=30_000))
    spans = [(1, a, min(a + n, 30_000)) for a in (0, 1, 4095, 4096, 8191, 8192, 20_000, 29_999) for n in (1, 4096, 4097, 9_000)] + [(2, 0, 2), (2, 1, 5)]
    docs = spark.createDataFrame([(1, text), (2, "abc"), (3, None)], "doc_id long, text string")
    rows = intervals.cut_out(spark.createDataFrame(spans, "doc_id long, start int, end int"), docs).collect()
    assert len(rows) == len(spans) and all(r.value == {1: text, 2: "abc"}[r.doc_id][r.start : r.end] for r in rows)


def spans_of(draw, n, many, types=("PERSON", "CPF_BR", "LOCATION", "ODD", "ANY")):
    return [(a := draw.randint(-2, n), a + draw.randint(0, 9), draw.choice(types), draw.randint(1, 99) / 100) for _ in range(many)]


def test_sweep_is_the_fusion_of_cells(spark):
    draw = random.Random(11)
    docs = [(i, "".join(draw.choices("ab\n", weights=(8, 8, 1), k=draw.randint(0, 60)))) for i in range(80)] + [(80, None), (81, "x\n")]
    rows = [(i, *s) for i, t in docs if i != 81 for s in spans_of(draw, len(t or ""), draw.randint(0, 25))]
    frame, texts = spark.createDataFrame(rows, SPAN), spark.createDataFrame(docs, "doc_id long, text string")
    arrays = texts.join(frame.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "type", "score")).alias("spans")), "doc_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast(patterns.SPANS)))
    want = sorted((r.doc_id, e.start, e.end, e.type, e.score) for r in fuse_spans(arrays, F.col("text")).collect() for e in r.entities or [])
    assert sorted((r.doc_id, r.start, r.end, r.type, r.score) for r in fuse(frame, texts).collect()) == want and len(want) > 100
    both = fuse_any(arrays, many=8).collect()
    assert len(both) == len(docs) and sorted((r.doc_id, e.start, e.end, e.type, e.score) for r in both for e in r.entities or []) == want
    texts_of = dict(docs)
    assert all(e.text == texts_of[r.doc_id][e.start : e.end] for r in both for e in r.entities or [])


def test_sweep_is_linear():
    draw = random.Random(2)

    def took(n):
        spans = [(a := draw.randint(0, 4 * n), a + draw.choice([3, 20, 4 * n]), draw.randint(0, 18), draw.random()) for _ in range(n)]
        began = time.perf_counter()
        assert sweep(spans, list(range(0, 4 * n, 50)))
        return time.perf_counter() - began

    took(2_000)
    short, long = min(took(5_000) for _ in range(3)), took(50_000)
    assert long < 40 * max(short, 0.01)


def test_coverage_against_characters(spark):
    draw = random.Random(6)
    docs = [(i, "".join(draw.choices("a1é .-\n", k=400))) for i in range(6)] + [(6, "b" * 9_000 + "." * 100)]
    size = {i: len(t) for i, t in docs}
    gold = [(i, draw.choice("XY"), a := draw.randint(0, size[i] - 1), min(size[i], a + draw.choice([1, 3, 12, 5_000]))) for i in size for _ in range(40)]
    gold += gold[:5]
    found = [(i, a := draw.randint(0, size[i]), a + draw.choice([0, 2, 9, 60, 7_000])) for i in size for _ in range(9)]
    rows = evaluate.covered(spark.createDataFrame(gold, "doc_id long, type string, start int, end int"), spark.createDataFrame(found, "doc_id long, start int, end int"), spark.createDataFrame(docs, "doc_id long, text string")).collect()
    text = dict(docs)
    inside = {(i, p) for i, a, b in found for p in range(a, b)}
    want = sorted((i, t, a, b, all((i, p) in inside for p in range(a, b) if text[i][p].isalnum()), text[i][a:b]) for i, t, a, b in gold)
    assert sorted((r.doc_id, r.type, r.start, r.end, r.covered, r.value) for r in rows) == want


def test_many_items_of_one_document(spark):
    n = 20_000
    text = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.repeat(F.lit("nome 123, "), n).alias("text"))
    items = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit("T").alias("type"), (F.col("id") * 10).cast("int").alias("start"), (F.col("id") * 10 + 8).cast("int").alias("end"))
    found = items.select("doc_id", "start", F.when(F.col("start") % 30 == 0, F.col("end") - 1).otherwise(F.col("end")).alias("end"))
    began = time.perf_counter()
    got = evaluate.covered(items, found, text).groupBy("covered").count().collect()
    assert {r["covered"]: r["count"] for r in got} == {False: 6_667, True: 13_333} and time.perf_counter() - began < 60


def test_windows_find_what_whole_texts_hold(spark):
    """Long documents of both layouts: entities, scores and masked texts of the windows are those of the whole text."""
    from spanveil.plans.anonymize import anonymize, anonymize_long, entities_by_windows, entity_rows
    from spanveil.sources import legal

    parts = legal.legal_docs(spark, "/root/testdata/sf0.001").unionByName(legal.more_docs(spark, "/root/testdata/sf0.001")).where("doc_id <= 50")
    whole = parts.groupBy((F.col("doc_id") % 2).alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda p: p["text"]), "\n\n").alias("text"))
    whole = whole.unionByName(spark.createDataFrame([(7, None), (8, ""), (9, "nada aqui")], "doc_id long, text string")).cache()
    key = lambda r: (r.doc_id, r.start)
    want = sorted(entity_rows(anonymize(whole)).collect(), key=key)
    got = sorted(entities_by_windows(whole).collect(), key=key)
    assert [tuple(r[c] for c in ("doc_id", "type", "text", "start", "end", "score")) for r in got] == [tuple(r[c] for c in ("doc_id", "type", "text", "start", "end", "score")) for r in want] and len(got) > 500
    masked = {r.doc_id: r.anonymized_text for r in anonymize(whole).collect()}
    assert {r.doc_id: r.anonymized_text for r in anonymize_long(whole).collect()} == masked
