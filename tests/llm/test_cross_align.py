"""Alignment of two tokenizers: whole texts encoded at once against blocks, parts and the tree; the fragments' algebra."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanveil.llm import cross_align
from spanveil.llm.queries import vocabulary

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary(B))


def tokens(coders, text):
    """(ids, ends) of both sides over a space and the text, or None where the bytes differ; whole texts, no cutting."""
    a, b = coders
    want = (" " + text).encode()
    plain = {chr(i): i for i in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    for i in range(256):
        if i not in plain.values():
            plain[chr(256 + len([x for x in plain if ord(x) > 255]))] = i
    sides = []
    coded = a.encode(" " + text, add_special_tokens=False)
    sides.append([(i, bytes(plain[c] for c in t)) for i, t in zip(coded.ids, coded.tokens)])
    sides.append([(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))])
    if any(b"".join(x for _, x in s) != want for s in sides):
        return None
    return [([i for i, _ in s], np.cumsum([len(x) for _, x in s]).tolist()) for s in sides]


def brute(coders, texts):
    """The rows of the contract from its definitions alone."""
    groups = []
    for text in texts:
        got = tokens(coders, text) if text else None
        if got is None:
            groups.append(None)
            continue
        (a, ea), (b, eb) = got
        ends = sorted(set(ea) & set(eb))
        place = lambda e: next(i for i, x in enumerate(ends) if x >= e)
        if len(ends) > 400:
            index, x = {}, 0
            for e in range(1, ends[-1] + 1):
                x += e > ends[x]
                index[e] = x
            place = index.__getitem__
        own = [([], []) for _ in ends]
        for i, e in zip(a, ea):
            own[place(e)][0].append(i)
        for i, e in zip(b, eb):
            own[place(e)][1].append(i)
        groups.append((own, len(a), len(b)))
    docs = Counter()
    for g in groups:
        docs.update({(i, j) for a, b in (g[0] if g else []) for i in a for j in b})
    best = defaultdict(int)
    for (i, _), n in docs.items():
        best[i] = max(best[i], n)
    out = []
    for g in groups:
        if g is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(i, j) for a, b in g[0] for i in a for j in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g[0])
        out.append((g[1], g[2], len(g[0]), len(links), sum(docs[x] == best[x[0]] for x in links), sum(docs[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def found(spark, texts, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, block string, kind int")
    rows = cross_align.align_tokens(df, vocabulary(A), vocabulary(B), **options).collect()
    return {r["doc_id"]: tuple(r[c] for c in FIELDS) for r in rows}, rows


def texts():
    draw = random.Random(4)
    letters = ["a", "b", "é", "ß", "中", "ﬁ", "🙂", " ", "▁", "　", "\n", "\t", "\r", " ", " ", " ", ".", "'s", "12", "<s>", "<|endoftext|>", "<0x41>", "é", "\u0085", "the ", "ing"]
    out = [None, "", " ", "  ", "\n", "a", " a", "a ", "Hello <|endoftext|> world </s>", "café naïve ▁x", "ab  cd   ef", "x" * 300, "no break here"]
    return out + ["".join(draw.choices(letters, k=draw.randint(1, 60))) for _ in range(150)] + ["the cat sat on the mat"] * 3


def test_against_whole_texts(spark, coders):
    rows = texts()
    got, _ = found(spark, rows)
    for i, want in enumerate(brute(coders, rows)):
        assert got[i] == want, (i, rows[i])


def test_long_texts_by_the_tree(spark, coders):
    draw = random.Random(8)
    words = ["alpha", "Beta", "é", "inter\nnational", "42", "unbelievable", "..", "zq" * 9]
    rows = [" ".join(draw.choices(words, k=30_000)), "".join(draw.choices("abcdé\n", k=150_000)), "x y " * 40_000 + "▁", "z" * 70_000, "short one", " " * 70_000, "alpha Beta"]
    got, _ = found(spark, rows)
    for i, want in enumerate(brute(coders, rows)):
        assert got[i] == want, i


def test_groups_text_and_defined_results(spark):
    got, rows = found(spark, ["a b", None, "a b", "q " * 40_000], with_groups=True)
    by = {r["doc_id"]: r["groups"] for r in rows}
    assert by[1] == "" and by[0] == by[2] and by[0].count(";") + 1 == got[0][2]
    assert all(hashlib.sha256(by[i].encode()).hexdigest() == got[i][6] for i in (0, 2, 3))
    df = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string")
    out = cross_align.align_tokens(df, vocabulary(A), vocabulary(B)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["3", "3", "None"] and {r["count_sum"] for r in out} == {3 * out[0]["n_links"]}
    assert cross_align.align_tokens(df.limit(0), vocabulary(A), vocabulary(B)).count() == 0


def test_fragments_are_a_monoid():
    draw = np.random.default_rng(2)
    names = [str(i) for i in range(50)]

    def state(f):
        return [x.tolist() for x in (*f.prefix, *f.suffix, f.pairs, f.times)] + [f.open, f.groups, f.links]

    for _ in range(60):
        size = int(draw.integers(5, 60))
        sides = [np.unique(np.r_[draw.integers(1, size + 1, int(draw.integers(1, size))), size]) for _ in range(2)]
        ids = [draw.integers(0, 50, len(e)) for e in sides]
        cuts = [0, *np.sort(draw.integers(0, size + 1, 3)).tolist(), size]
        parts = []
        for lo, hi in zip(cuts, cuts[1:]):
            a, b = (slice(*np.searchsorted(e, [lo, hi], "right")) for e in sides)
            parts.append(cross_align.fragment(ids[0][a], sides[0][a], ids[1][b], sides[1][b], names, names)[0])
        whole = cross_align.fragment(ids[0], sides[0], ids[1], sides[1], names, names)[0]
        join = lambda x, y: cross_align.compose(x, y)[0]
        p, q, r, s = parts
        for made in (join(join(join(p, q), r), s), join(p, join(q, join(r, s))), join(join(p, q), join(r, s)), join(cross_align.Fragment(), join(p, join(join(q, r), s)))):
            assert state(made) == state(whole)
