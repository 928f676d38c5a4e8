"""The token dictionary: closing and guarding against patterns and scans of one text at a time."""

import random
import unicodedata

import regex
from pyspark.sql import functions as F

from spanveil.operators import dictionary, session

LABEL = r"\[(?:\p{Lu}+(?:_\p{Lu}+)*)_(?:\d+)\]"
VALUES = "session_id string, label string, norm_value string, n int"


def bare(text):
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def pattern(value):
    """A value whatever its case, accents and white space, with borders of letters and digits."""
    marked = {"a": "[aáàâã]", "e": "[eéê]", "i": "[ií]", "o": "[oóôõ]", "u": "[uú]", "c": "[cç]"}
    body = "".join(r"\s+" if c == " " else marked.get(c, regex.escape(c)) for c in value)
    kind = lambda c: r"\p{L}" if c.isalpha() else r"\p{N}" if c.isdigit() else None
    left, right = kind(value[0]), kind(value[-1])
    return (f"(?<!{left})" if left else "") + body + (f"(?!{right})" if right else "")


def leftmost(text, values):
    """One alternation: placeholders, then values by falling length."""
    known = sorted(values, key=lambda v: (-len(v), v))
    rx = regex.compile(LABEL + "".join(f"|({pattern(v)})" for v in known), regex.I)
    return rx.sub(lambda m: m[0] if m.lastindex is None else values[known[m.lastindex - 1]], text)


def longest(text, values):
    """The longest value first, wherever it stands."""
    taken = [(m.start(), m.end(), m[0]) for m in regex.finditer(LABEL, text)]
    for v in sorted(values, key=lambda v: (-len(v), v)):
        for m in regex.finditer(pattern(v), text, regex.I, overlapped=True):
            if all(m.end() <= a or b <= m.start() for a, b, _ in taken):
                taken.append((m.start(), m.end(), values[v]))
    out, at = "", 0
    for a, b, put in sorted(taken):
        out, at = out + text[at:a] + put, b
    return out + text[at:]


def made(draw):
    words = ["ana", "Ana", "ANÁ", "lima", "Líma", "sá", "k2", "12", "345", "joão", "JOAO", "da", "e", "x"]
    gaps = [" ", "  ", "\n", "-", "/", ".", "", ", ", " [PESSOA_1] ", "[CPF_12]"]
    return "".join(draw.choice(words) + draw.choice(gaps) for _ in range(draw.randint(0, 25)))


def test_closing_is_the_alternation_and_the_longest_first(spark):
    draw = random.Random(7)
    sessions, texts = {}, []
    for s in range(12):
        values = {" ".join(bare(made(draw)).replace("[pessoa_1]", "").replace("[cpf_12]", "").split())[: draw.randint(3, 14)].strip() for _ in range(14)}
        values = [v for v in sorted(values) if sum(c.isalnum() for c in v) >= 3]
        sessions[f"s{s}"] = {v: f"[PESSOA_{i + 1}]" for i, v in enumerate(values)}
        texts += [(f"s{s}", i, made(draw)) for i in range(25)]
    names = spark.createDataFrame([(s, "PESSOA", v, i + 1) for s, own in sessions.items() for i, v in enumerate(own)], VALUES)
    rows = spark.createDataFrame(texts + [("none", 0, "ana"), ("s1", 99, None)], "session_id string, id int, text string")
    for prefer, form in (("leftmost", leftmost), ("longest", longest)):
        got = {(r.session_id, r.id): r for r in session.close_residuals(rows, names, prefer=prefer).collect()}
        assert len(got) == len(texts) + 2 and got["none", 0].closed_text == "ana" and got["s1", 99].closed_text is None and got["s1", 99].closed == {}
        changed = 0
        for s, i, text in texts:
            assert got[s, i].closed_text == form(text, sessions[s]), (prefer, text, sessions[s])
            changed += got[s, i].closed_text != text
        assert changed > 40


def test_longest_value_wins_over_an_earlier_place(spark):
    names = spark.createDataFrame([("s", "PESSOA", "ana lima", 1), ("s", "PESSOA", "lima de souza", 2)], VALUES)
    text = spark.createDataFrame([("s", "Ana Lima de Souza, Ana  LIMA")], "session_id string, text string")
    row = session.close_residuals(text, names).first()
    assert row.closed_text == "Ana [PESSOA_2], [PESSOA_1]" and row.closed == {"PESSOA": 2} and row.examples == ["PESSOA: Lima de Souza"]
    assert session.close_residuals(text, names, prefer="leftmost").first().closed_text == "[PESSOA_1] de Souza, [PESSOA_1]"


def test_decomposed_letters_and_repeated_texts(spark):
    names = spark.createDataFrame([("s", "PESSOA", "jose lima", 1), ("s", "CPF", "jose lima", 4)], VALUES)
    rows = spark.createDataFrame([("s", 1, "José Lima!"), ("s", 2, "José Lima!"), ("s", 3, "")], "session_id string, id int, text string")
    got = {r.id: r.closed_text for r in session.close_residuals(rows, names).collect()}
    assert got == {1: "[CPF_4]!", 2: "[CPF_4]!", 3: ""}


def test_many_values_with_one_first_token(spark):
    """A hundred thousand values of a session that begin alike, and a token that all texts hold: the plan does not grow."""
    ids = spark.range(100_000)
    names = ids.select(F.lit("s").alias("session_id"), F.lit("PESSOA").alias("label"), F.concat(F.lit("maria x"), F.conv(F.col("id").cast("string"), 10, 26)).alias("norm_value"), (F.col("id") + 1).cast("int").alias("n"))
    texts = spark.range(2_000).select(F.lit("s").alias("session_id"), "id", F.concat(F.lit("Sra. MARIA  X"), F.upper(F.conv((F.col("id") * 50).cast("string"), 10, 26)), F.lit(" e Maria Y, maria")).alias("text"))
    closed = session.close_residuals(texts, names)
    assert len(closed._jdf.queryExecution().analyzed().toString()) < 40_000
    bad = closed.where(F.col("closed_text") != F.concat(F.lit("Sra. [PESSOA_"), (F.col("id") * 50 + 1).cast("string"), F.lit("] e Maria Y, maria")))
    assert bad.count() == 0 and closed.count() == 2_000


def test_offsets(spark):
    texts = spark.createDataFrame([("k", 1, "ab ana\tlima, x ANA LIMA ana")], "k string, text_id int, text string")
    terms = spark.createDataFrame([("k", "ana lima"), ("k", "ana"), ("k", ""), ("k", None)], "k string, value string").withColumns({"rank": F.col("value"), "length": F.length("value")})
    found = dictionary.resolved(dictionary.candidates(texts, terms, "k"), "k", "leftmost", "length")
    got = sorted((r.start, r.end, r.found) for r in dictionary.with_offsets(found, texts, "k").collect())
    assert got == [(3, 11, "ana\tlima"), (15, 23, "ANA LIMA"), (24, 27, "ana")]


def test_guard_takes_exempt_passages_out(spark):
    out = spark.createDataFrame([(1, "s", "Att. Ana Lima, Juízo"), (2, "s", "Att. Ana Lima, e ana lima"), (3, "t", "Ana Lima")], "id int, session_id string, text string")
    forbidden = spark.createDataFrame([("s", "PERSON", "Ana Lima"), ("s", "OTHER", "ANA LIMA"), ("s", "PERSON", "Lima"), ("s", "PERSON", "ab")], "session_id string, type string, value string")
    got = {(r.id, r.type): r.pos for r in session.guard_hits(out, forbidden, exempt=["Att. Ana Lima"]).collect()}
    assert got == {(2, "PERSON"): 17, (2, "OTHER"): 17}
