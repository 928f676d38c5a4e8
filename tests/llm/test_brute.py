"""Operators that SQL does not express, against the brute-force versions of brute.py."""

import math
import random
import string
import time

import numpy as np
import pytest

from spanveil.llm import chat_format, decontamination, kd_sharding, language_crf, near_dedup, packing, pivot_search, secret_scan, substring_dedup
from spanveil.llm.queries import vocabulary

from . import brute

VOCABULARY = [f"w{a}{b}" for a in "abcdefghij" for b in "abcdefghij"]


def _copies(rng, many, length, share):
    """Texts of which most are edited copies of a few."""
    bases = [[rng.choice(VOCABULARY) for _ in range(length)] for _ in range(4)]
    out = []
    for _ in range(many):
        words = list(rng.choice(bases)) if rng.random() < 0.8 else [rng.choice(VOCABULARY) for _ in range(rng.randint(1, length))]
        for _ in range(rng.randint(0, share)):
            words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("words", "num", "den", "hub_list", "block"), [(3, 85, 100, 4096, 1024), (5, 80, 100, 0, 4)])
def test_near_duplicates(spark, monkeypatch, words, num, den, hub_list, block):
    """All links at the threshold, with the usual sizes and with hub rounds and blocks of four."""
    monkeypatch.setattr(near_dedup, "HUB_LIST", hub_list)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    rows = list(enumerate([*_copies(random.Random(words), 160, 110, 5), None, "", "One two", "one  TWO", "one", "\t\n", "straße Ä ä"]))
    table = spark.createDataFrame([(d, t, "x") for d, t in rows] + [(3, rows[3][1], "y"), (None, "one", "z")], "doc_id long, text string, sig string")
    got = near_dedup.near_duplicates(table, words, num, den).collect()
    want = brute.near_components(rows, words, num, den)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows) + 1
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len({c for _, c in want.values()}) < len(rows)


def test_linked_keeps_one_link_for_two_components():
    sig = np.zeros((4, near_dedup.COORDINATES), np.int32)
    start, shingles = np.array([0, 4, 8, 12, 16]), np.array([1, 2, 3, 4] * 3 + [1, 2, 7, 8])
    found = near_dedup.linked(np.arange(4), np.arange(4), sig, start, shingles, np.arange(4), np.arange(4), 10, 85, 100)
    assert len(found) == 2 and {x for pair in found for x in pair} == {0, 1, 2}


def _strings(rng):
    key = string.ascii_letters + string.digits + "+/_=-"
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    makers = [
        lambda: f"password = '{some(key, rng.randint(3, 20))}'",
        lambda: f"API_KEY:{some(key, rng.randint(6, 40))}",
        lambda: "AKIA" + some(string.ascii_uppercase + string.digits, rng.randint(8, 20)),
        lambda: some("0123456789abcdef", rng.randint(20, 45)),
        lambda: some("ABCDEF0123456789", rng.randint(18, 30)),
        lambda: some(key, rng.randint(10, 60)),
        lambda: some("ab1", rng.randint(20, 60)),
        lambda: "sha256-" + some(key, 40),
        lambda: "/usr/share/" + some(string.ascii_lowercase, 25),
        lambda: some("aeiouäöü😀 ", 12),
        lambda: "3f2504e0-4f89-11d3-9a0c-0305e82c3301",
        lambda: "token=token=abcdefgh12 secretsecret:xyzxyzxyz",
    ]
    return lambda: rng.choice(makers)()


def test_secrets(spark):
    rng = random.Random(3)
    one = _strings(rng)
    texts = [rng.choice([" ", "\n", ",", "é "]).join(one() for _ in range(rng.randint(1, 9))) for _ in range(250)] + [None, "", "x", "AKIA", "ſecret=abcdefgh1"]
    texts += ["\n".join("%032x" % rng.getrandbits(128) for _ in range(700))]  # more matches than a chunk of the fold holds
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, base int, entropy string")
    got = {r.doc_id: r.asDict() for r in secret_scan.scan_secrets(table).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute.secrets(t) | {"doc_id": i}, t


def test_secrets_in_a_candidate_of_a_megabyte(spark):
    """Work grows with the length alone: every window is one step."""
    rng = random.Random(4)
    took = []
    for n in (1000, 100_000, 1_000_000):
        text = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
        table = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        row = secret_scan.scan_secrets(table).first()
        took.append(time.perf_counter() - began)
        assert row.spans == f"entropy_base64:0:{n}"
    assert took[2] < 90 and took[2] < 40 * max(took[1], 1)


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    plain = Tokenizer.from_file(vocabulary())
    alphabet = ["a", "B", " ", "  ", "\n", "\t", "é", "ß", "中文", "😀", "1", "23", ".", "'s", " ", " ", "<|endoftext|>", "word", " the", "\x1c", "\u0085"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(300)]
    texts += [None, "", "word " * 1022, "word " * 1023, "x y " * 5000, " ".join(str(i) for i in range(40_000))]
    rows = list(enumerate(texts)) + [(7, texts[7]), (None, "no id")]
    got = packing.pack_documents(spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, length int"), vocabulary()).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    known = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key)
    assert known == sorted(brute.pieces_of([r for r in rows if r[0] is not None], plain) + brute.pieces_of([rows[-1]], plain), key=key)
    ends: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024 and len(ends) <= math.ceil(sum(r.length for r in got) / 1024) * 1.1 + 1


def test_forward_backward_sums_over_all_paths(monkeypatch):
    """Marginals against the sum over every label path, in blocks of three words, so that borders are crossed."""
    monkeypatch.setattr(language_crf, "BLOCK", 3)
    rng = np.random.default_rng(1)
    texts = ["kato lumi", "one", "12 kato -- sano lumi veli kato", "lumi sano veli kato lumi sano veli", "... 7", "sano veli kato 5 lumi sano"]
    body = np.frombuffer("".join(texts).encode(), np.uint8)
    rows = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    piece = language_crf._Piece(body, rows)
    field = language_crf.Field(["a", "b", "c"], piece.keys[piece.keys != 0][:3])
    field.gram[:] = rng.normal(size=field.gram.shape)
    field.word[:] = rng.normal(size=field.word.shape)
    field.move = rng.normal(size=(3, 3))
    emit = field.emissions(piece)[piece.back].astype(float)
    got = language_crf.label_shares(field, piece)
    for i in range(len(texts)):
        a, b = piece.words.first[i], piece.words.first[i + 1]
        counted = piece.lettered[a:b]
        want = brute.label_shares(emit[a:b], field.move, counted) if counted.any() else np.zeros(3)
        assert np.allclose(got[i], want, atol=1e-6), texts[i]


def test_languages_of_held_out_texts(spark):
    rng = random.Random(6)
    sounds = {"aa": ["ka", "to", "lu", "mi", "sa"], "bb": ["xor", "zyr", "wqe", "plu"], "cc": ["schr", "eng", "acht", "ung"]}
    word = {c: lambda s=s: "".join(rng.choice(s) for _ in range(rng.randint(1, 3))) for c, s in sounds.items()}
    rows = []
    for i in range(400):
        c = rng.choice(list(sounds))
        other = rng.choice(list(sounds))
        words = [word[other]() if rng.random() < 0.1 else word[c]() for _ in range(rng.randint(3, 40))]
        rows.append((i, " ".join(words), c))
    got = {r.doc_id: r for r in language_crf.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    import zlib

    held = [(i, c) for i, _, c in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == {i for i, _ in held}
    assert sum(got[i].lang_pred == c for i, c in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got.values())


@pytest.mark.parametrize("crowded", [10_000, 2])
def test_roles_are_the_best_of_all_paths(spark, monkeypatch, crowded):
    """Viterbi over chunks of two turns, and over turns of many rows in parts, against every state path."""
    monkeypatch.setattr(chat_format, "CHUNK_TURNS", 2)
    monkeypatch.setattr(chat_format, "CROWDED", crowded)
    rng = random.Random(8)
    lines = ["User: hi there?", "Assistant: well.", "what is it?", "It is so, my friend.\nAnd more.", "System: be kind", "thanks", "### Answer:\nyes", "a: b"]
    rows = [(c, t, rng.choice(lines)) for c in range(6) for t in range(rng.randint(1, 6))] + [(9, None, "User: x"), (9, None, "Bot: y"), (9, None, "z?"), (9, None, "z?"), (8, 0, None)]
    table = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, text string, chunk string, row int")
    labelled = spark.createDataFrame([(c, t, x, ["user", "assistant"][t % 2]) for c in range(40) for t, x in enumerate(["hello there?", "It is so.", "and why?", "Because it is."])], "conv_id long, turn long, text string, role string")
    model = chat_format.fit(chat_format.segments(labelled))
    got = chat_format.format_chats(table, model).toPandas()
    segs = chat_format._chunked(chat_format.segments(table)).toPandas()
    assert len(got) == len(segs)
    for conv, part in segs.groupby("conv_id"):
        part = part.sort_values([*chat_format._CHUNK, "turn", "tie", "row", "seg"])
        best = brute.best_paths(chat_format._emissions(part.reset_index(drop=True), model)[:, :-1], model["step"])
        paths = {tuple(sorted(zip(part.turn, part.seg, part.text, (chat_format.ROLES[s] for s in p)))) for p in best}
        mine = got[got.conv_id == conv]
        assert len(mine) == len(part) and any(sorted(zip(mine.turn, mine.seg, mine.role_pred)) == sorted((t, s, r) for t, s, _, r in p) for p in paths)


def test_roles_of_held_out_conversations(spark):
    rng = random.Random(9)
    ask, say = ["can you help me?", "why is that?", "how so?"], ["It is because of the weather.", "Here is a longer answer that explains it.", "Certainly."]
    rows = []
    for c in range(120):
        for t in range(rng.randint(2, 8)):
            role = ["user", "assistant"][t % 2]
            text = rng.choice(ask if role == "user" else say)
            rows.append((c, t, (f"{role.title()}: " if rng.random() < 0.3 else "") + text, role))
    got = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, text string, role string")).where(chat_format.held_out()).toPandas()
    truth = {(c, t): r for c, t, _, r in rows}
    right = [truth[r.conv_id, r.turn] == r.role_pred for r in got.itertuples()]
    assert len(right) > 50 and np.mean(right) >= 0.95


@pytest.mark.parametrize("hot_rows", [100_000, 2])
def test_shards(spark, hot_rows):
    rng = random.Random(10)
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["the same text"] * 12 + [None] * 3 + [""] * 3
    rows = [(i, t, f"https://site{i % 7}.example", rng.choice(["en", "de", None]), 1) for i, t in enumerate(texts)] + [(None, "no id", None, None, 1), (5, texts[5], "x", "en", 1)]
    got = kd_sharding.shard_by_tree(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, bytes int"), 8, hot_rows).collect()
    import zlib

    size = lambda t: len((t or "").encode()) + 16
    text = dict(enumerate(texts)) | {None: "no id"}
    assert len(got) == len(rows) and all((r["size"], r.text_crc32, r.law, r.grown_shard) == (size(text[r.doc_id]), zlib.crc32((text[r.doc_id] or "").encode()), "bytes", None) for r in got)
    assert {r.shard for r in got} == set(range(8))
    for group in ({t for t in texts if t is not None} & {"the same text", ""}) | {None}:
        assert len({r.shard for r in got if text[r.doc_id] == group}) == 1
    shares = []
    for s in range(8):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        shares.append(sum(r["size"] for r in own))
    assert max(shares) <= 1.1 * sum(shares) / 8 and min(shares) >= 0.9 * sum(shares) / 8


ITEMS = [
    (1, "Mia pays 12 usd for 3 kg and 5 usd for 7 kg"),
    (2, "If Anna buys 12 red apples and 5 green pears how many fruits does Anna carry home to Ben"),
    (3, "What is 12 plus 34"),
    (4, "the quick brown fox jumps over the lazy dog while the sun sets slowly behind the old red barn"),
    (5, "Name"),
    (6, "A train leaves Paris at 9 and meets Lyon after 3 hours at 120 km/h , so how far is Lyon"),
    (7, None),
    (8, "... !"),
]


def _again(rng, text):
    """The item with other numbers and names."""
    names = {"Mia": "Olga", "Anna": "Zoe", "Ben": "Tim", "Paris": "Rome", "Lyon": "Turin"}
    return " ".join(str(rng.randint(2, 999)) if w.isdigit() else names.get(w, w) for w in text.split())


def test_leaks(spark):
    rng = random.Random(11)
    words = " ".join(t for _, t in ITEMS if t).split() + ["so", "then.", "Olga", "77", "kg"]
    docs = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    for _, t in ITEMS:
        for _ in range(10):
            body = (_again(rng, t) if rng.random() < 0.6 else t) if t else ""
            cut = body.split()[rng.randint(0, 6) :] if rng.random() < 0.3 else body.split()
            docs.append(rng.choice(["", "Well. ", "we read that ", "a\n"]) + " ".join(cut) + rng.choice(["", " and so on", "?"]))
    rows = list(enumerate([*docs, None, ""]))
    table = spark.createDataFrame([(d, t, 1) for d, t in rows] + [(None, ITEMS[3][1], 1), (0, docs[0], 2)], "doc_id long, text string, key int")
    bench = spark.createDataFrame([*ITEMS, (None, "x y z"), ITEMS[0]], "item_id long, text string")
    got = decontamination.decontaminate(table, bench).collect()
    want = brute.leaks([r for r in rows], ITEMS)
    assert len(got) == len(rows) + 2 and {r.doc_id: r["items"] for r in got if r.doc_id is not None} == {d: ",".join(map(str, x)) for d, x in want.items()}
    assert decontamination.decontaminate(table, bench.where("false")).where("contaminated").count() == 0


def test_recall_of_reparameterised_items(spark):
    """Fifty word problems, each with new numbers, names and units of the same kind, in the middle of other text."""
    rng = random.Random(12)
    names, other = ["Mia", "Tom", "Ada", "Eli"], ["Zoe", "Kim", "Lou", "Sam"]
    shapes = [
        "{a} buys {n} apples and {m} pears and gives {k} to {b} , how many does {a} have left",
        "A car drives {n} km in {m} hours and then {k} km more , how long is the whole trip",
        "If {a} reads {n} pages a day , how many days does a book of {m} pages take",
        "{a} pays {n} usd for {m} kg and {k} usd for 7 kg of rice",
        "There are {n} birds on a wire , {m} fly away and {k} come back , how many are there",
    ]
    fill = lambda s, who: s.format(a=rng.choice(who[:2]), b=rng.choice(who[2:]), n=rng.randint(2, 99), m=rng.randint(2, 99), k=rng.randint(2, 99))
    shape = [shapes[i % 5] + f" in case {chr(97 + i // 5)}{chr(97 + i % 7)}" for i in range(50)]
    bench = [(i, fill(s, names)) for i, s in enumerate(shape)]
    docs = [(i, "This was asked before . " + fill(s, other) + " and nobody knew it .") for i, s in enumerate(shape)]
    clean = [(100 + i, " ".join(rng.choice(VOCABULARY) for _ in range(60)) + " 12 kg for 3 usd") for i in range(50)]
    got = {r.doc_id: r["items"].split(",") for r in decontamination.decontaminate(spark.createDataFrame(docs + clean, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert sum(str(i) in got[i] for i, _ in docs) >= 45 and all(got[i] == [""] for i, _ in clean)


def test_windows_of_equal_keys_are_told_apart():
    """A key that two different windows share: the check decides."""
    u, c = np.uint64, np.uint32
    known, checks, least = np.array([5, 7, 7, 7, 9], u), np.array([1, 1, 2, 3, 1], c), np.array([10, 20, 30, 40, 50])
    got = substring_dedup._least_of(np.array([7, 7, 7, 7, 9, 5, 6], u), np.array([2, 3, 1, 4, 2, 1, 1], c), known, checks, least)
    none = np.iinfo(np.int64).max
    assert got.tolist() == [30, 40, 20, none, none, 10, none]


def test_substrings_in_many_chunks(spark, monkeypatch):
    """Words covered by a window that starts in a document of a smaller id, with one document a chunk."""
    import hashlib

    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 100)
    rng = random.Random(13)
    texts = _copies(rng, 40, 60, 3) + [None, "", "a b", "x " * 40, "x " * 5 + "y"]
    first: dict = {}
    words = [brute.WORD.findall(t or "") for t in texts]
    for i, w in enumerate(words):
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(spark.createDataFrame([(i, t, 1, b"") for i, t in enumerate(texts)], "doc_id long, text string, chunk int, key binary"), with_text=True).collect()}
    for i, w in enumerate(words):
        gone = {p for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for p in range(j, j + 13)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].text, got[i].kept_sha256) == (len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest())


def test_top_k_with_many_blocks(spark, monkeypatch):
    """Against all inner products, with blocks of few rows, a small sample, ties and repeated vectors."""
    for name, value in (("ROW_BLOCK", 40), ("QUERY_BLOCK", 3), ("PIVOTS", 5), ("PIVOT_SAMPLE", 30), ("STEP", 7)):
        monkeypatch.setattr(pivot_search, name, value)
    rng = np.random.default_rng(14)
    vectors = np.r_[rng.normal(size=(250, 6)), np.repeat(rng.normal(size=(5, 6)), 30, 0)].astype(np.float32)
    rows = [(i * 3, v.tolist()) for i, v in enumerate(vectors)] + [(1000, None), (1050, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1100, [1.0, 2.0]), (1150, [1.0, 0.5]), (1200, [3.0])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in pivot_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=5).collect()]
    whole = {i: np.floor(256 * np.array(v, np.float32).astype(float)) for i, v in rows if v and None not in v}
    want = []
    for i, v in whole.items():
        if i % 50 == 0:
            scored = sorted((-int(v @ w), j) for j, w in whole.items() if j != i and len(w) == len(v))[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    assert sorted(got) == sorted(want) and len(got) >= 30
