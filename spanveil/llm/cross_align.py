"""Alignment of two tokenizers over documents: groups of tokens between common byte offsets, and how often ids are linked.

Both tokenizers read a space and the text. A byte range of a document is a *fragment*: the tokens that end in it. A byte
offset where tokens of both end closes a group, so a fragment has an open prefix (up to and with its first such
offset, for the group may have begun before the range), closed groups, and an open suffix (behind the last one). Fragments of
neighbouring ranges are composed by closing what the left suffix and the right prefix make together. This is
associative, so a very long document is cut into parts that are tokenized in different tasks, each part into fragments
on a grid of bytes, and these are composed as a tree over several rounds.

Texts are cut for the tokenizers before single spaces between two other characters: no token of either reaches over such
a place. A block of short documents is tokenized at once, each distinct stretch between two such places one time only.

A block keeps the distinct id pairs of its documents; these are counted over the corpus and joined back by block, so
every task reads the counts of the pairs that its own documents hold, not all of them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_table, digest_in_order, shuffle_width, small_batches
from .words import column_bytes, released, span_hashes

#: Bytes of a text from which on it is cut into parts; bytes of a fragment; fragments that one step of the tree composes.
PART_BYTES, FRAGMENT_BYTES, FAN = 1 << 16, 1 << 14, 16
#: Bytes of text of a block of documents.
BLOCK_BYTES = 2 << 20
#: Stretches that a tokenizer gets at one time; its own objects are much larger than the ids.
ENCODED = 2048
#: Stretches that the byte-level tokenizer reads as one text; bytes of white space, and those that wide spaces begin with.
TOGETHER, _UNSAFE = 64, frozenset([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0xC2, 0xE1, 0xE2, 0xE3])
#: Token pairs of a group that are written out one by one; larger groups go by distinct ids.
PLAIN_LINKS = 4096

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_EMPTY = np.zeros(0, np.int64)


def _byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: visible bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Side:
    """A tokenizer, and the bytes and the number text of each of its ids."""

    def __init__(self, tokens: list[bytes], encode):
        self.encode = encode
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.at = np.r_[0, np.cumsum(self.size)]
        self.body = np.frombuffer(b"".join(tokens), np.uint8)
        self.name = [str(i) for i in range(len(tokens))]
        self.digits = np.array([len(x) for x in self.name], np.int64)
        self.digits_at = np.r_[0, np.cumsum(self.digits)]
        self.figures = np.frombuffer("".join(self.name).encode(), np.uint8)

    def written(self, ids: np.ndarray) -> np.ndarray:
        return self.body[_runs(self.at[:-1][ids], self.size[ids])]


def _byte_level(path: str) -> _Side:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    table, vocab = _byte_alphabet(), t.get_vocab(with_added_tokens=True)
    special = {x["content"] for x in json.loads(t.to_str())["added_tokens"]}
    tokens = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        tokens[i] = token.encode() if token in special else bytes(table[c] for c in token)
    run = getattr(t, "encode_batch_fast", t.encode_batch)

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # The space before a text is part of what this tokenizer reads. Stretches that a safe cut may stand between are read together.
        raw = [x.encode() for x in texts]
        calm = [bool(x) and x[0] not in _UNSAFE and (x[-1] < 0x80 and x[-1] not in _UNSAFE or len(x) > 1 and 0xC3 <= x[-2] <= 0xDF) for x in raw]
        order = np.argsort(~np.array(calm, bool), kind="stable")
        many = sum(calm)
        lines = [" " + " ".join([texts[i] for i in order[j : min(j + TOGETHER, many)]]) for j in range(0, many, TOGETHER)] + [" " + texts[i] for i in order[many:]]
        ids = np.array([i for e in run(lines, add_special_tokens=False) for i in e.ids], np.int64)
        ends = np.cumsum([len(raw[i]) + 1 for i in order])
        count = np.diff(np.searchsorted(np.cumsum(size[ids]), ends, "right"), prepend=0)
        place = np.argsort(order)
        return count[place], ids[_runs((np.cumsum(count) - count)[place], count[place])]

    size = np.array([len(x) for x in tokens], np.int64)
    return _Side(tokens, encode)


def _pieces(path: str) -> _Side:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = [bytes([int(p[1:-1], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(m.id_to_piece(i) for i in range(m.get_piece_size()))]

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = m.encode(texts, num_threads=1)
        return np.array([len(x) for x in coded], np.int64), np.array([i for x in coded for i in x], np.int64)

    return _Side(tokens, encode)


_SIDES: dict[tuple[str, str], tuple[_Side, _Side]] = {}


def _sides(a: str, b: str) -> tuple[_Side, _Side]:
    if (a, b) not in _SIDES:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _SIDES[a, b] = _byte_level(a), _pieces(b)
    return _SIDES[a, b]


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[0], start[0] + 1, ... of size[0], then those of the next run, and so on."""
    shift = start - np.r_[0, np.cumsum(size)[:-1]] if len(size) else start
    return np.arange(int(size.sum())) + np.repeat(shift, size)


def safe_cuts(body: np.ndarray) -> np.ndarray:
    """True at single spaces that no token of either tokenizer begins before and ends behind."""
    n, cut = len(body), np.zeros(len(body), bool)
    if n > 2:
        space, tail = _SPACE[body], body[:-2]
        # No-break and other wide spaces begin with these bytes: a cut never stands beside one.
        wide = (body == 0xC2) | (body >= 0xE1) & (body <= 0xE3)
        two = np.zeros(n - 2, bool)
        two[1:] = (tail[1:] >= 0x80) & (tail[1:] < 0xC0) & (body[:-3] >= 0xC3) & (body[:-3] <= 0xDF)
        cut[1:-1] = (body[1:-1] == 32) & ((tail < 0x80) & ~space[:-2] | two) & ~(space | wide)[2:]
    return cut


# --- fragments


@dataclass
class Fragment:
    """The tokens that end in a byte range. Without a common end (``open``) all of them are in the suffix."""

    prefix: tuple[np.ndarray, np.ndarray] = (_EMPTY, _EMPTY)
    suffix: tuple[np.ndarray, np.ndarray] = (_EMPTY, _EMPTY)
    open: bool = True
    groups: int = 0
    links: int = 0
    #: Distinct id pairs (a << 32 | b) of the closed groups, and how often each is linked.
    pairs: np.ndarray = field(default_factory=lambda: _EMPTY)
    times: np.ndarray = field(default_factory=lambda: _EMPTY)
    whole: bool = True


def group_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct id pairs of one group, and their multiplicities."""
    (ua, na), (ub, nb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    return (ua.astype(np.int64)[:, None] << 32 | ub[None, :]).ravel(), (na[:, None] * nb[None, :]).ravel()


def summed(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Multiplicities of equal pairs added."""
    keys, back = np.unique(np.concatenate([_EMPTY, *pairs]), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, back, np.concatenate([_EMPTY, *times]))
    return keys, total


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, tuple[np.ndarray, np.ndarray] | None]:
    """The fragment of both ranges, and the group that closes between them."""
    both = lambda x, y: (np.r_[x[0], y[0]], np.r_[x[1], y[1]])
    whole = left.whole and right.whole
    if right.open:
        out = Fragment(left.prefix, both(left.suffix, right.suffix), left.open, left.groups, left.links, left.pairs, left.times, whole)
        return out, None
    if left.open:
        return Fragment(both(left.suffix, right.prefix), right.suffix, False, right.groups, right.links, right.pairs, right.times, whole), None
    a, b = both(left.suffix, right.prefix)
    pairs, times = group_pairs(a, b)
    keys, total = summed([left.pairs, pairs, right.pairs], [left.times, times, right.times])
    links = left.links + right.links + len(a) * len(b)
    return Fragment(left.prefix, right.suffix, False, left.groups + right.groups + 1, links, keys, total, whole), (a, b)


def closed(f: Fragment) -> tuple[Fragment, tuple[np.ndarray, np.ndarray] | None]:
    """A fragment of a whole text: its prefix is the first group; nothing is open behind the last token."""
    if f.open:
        return f, None
    pairs, times = group_pairs(*f.prefix)
    keys, total = summed([pairs, f.pairs], [times, f.times])
    return Fragment(open=False, groups=f.groups + 1, links=f.links + len(f.prefix[0]) * len(f.prefix[1]), pairs=keys, times=total, whole=f.whole), f.prefix


def fragment(a_ids, a_ends, b_ids, b_ends, name_a, name_b) -> tuple[Fragment, str]:
    """The fragment of tokens with their end offsets, and the text of its closed groups."""
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    if not len(common):
        return Fragment(suffix=(a_ids, b_ids)), ""
    ga, gb = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
    at = np.arange(len(common) + 1)
    fa, fb = np.searchsorted(ga, at), np.searchsorted(gb, at)
    cut = lambda i, j=None: (a_ids[fa[i] : fa[j] if j else None], b_ids[fb[i] : fb[j] if j else None])
    groups = [cut(i, i + 1) for i in range(1, len(common))]
    made = [group_pairs(*g) for g in groups]
    keys, total = summed([p for p, _ in made], [t for _, t in made])
    out = Fragment(cut(0, 1), cut(len(common)), False, len(groups), sum(len(x) * len(y) for x, y in groups), keys, total)
    return out, ";".join(_group_text(*g, name_a, name_b) for g in groups)


def _group_text(a, b, name_a: list[str], name_b: list[str]) -> str:
    return ",".join([name_a[i] for i in a]) + "|" + ",".join([name_b[i] for i in b])


# --- distinct stretches of text


class _Coded:
    """Tokens of distinct stretches, of each the space before it included; ``fine`` where both sides give its bytes back."""

    def __init__(self, texts: list[str], sides: tuple[_Side, _Side]):
        raw = [x.encode() for x in texts]
        self.size = np.array([len(x) + 1 for x in raw], np.int64)
        self.fine = np.ones(len(raw), bool)
        given = np.frombuffer(b"".join(b" " + x for x in raw), np.uint8)
        begin = np.r_[0, np.cumsum(self.size)]
        self.ids, self.ends, self.first = [], [], []
        for side in sides:
            counts, parts = [_EMPTY], [_EMPTY]
            for i in range(0, len(texts), ENCODED):
                own, coded = side.encode(texts[i : i + ENCODED])
                counts.append(own)
                parts.append(coded)
            count, ids = np.concatenate(counts), np.concatenate(parts)
            first = np.r_[0, np.cumsum(count)]
            reach = np.r_[0, np.cumsum(side.size[ids])]
            long = reach[first[1:]] - reach[first[:-1]]
            same = long == self.size
            # Where the lengths agree, the bytes have to.
            mine = _runs(first[:-1][same], count[same])
            wrong = side.written(ids[mine]) != given[_runs(begin[:-1][same], self.size[same])]
            good = np.flatnonzero(same)
            same[good[np.repeat(np.arange(len(good)), self.size[same])[wrong]]] = False
            self.fine &= same
            self.ids.append(ids)
            self.first.append(first)
            # End offsets within the stretch.
            self.ends.append(reach[1:] - np.repeat(reach[first[:-1]], count))

    def groups(self, sides: tuple[_Side, _Side]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per stretch the text of its groups and their number; (offsets, pairs, times) of its links; and its number of links."""
        n = len(self.size)
        at = np.r_[0, np.cumsum(np.where(self.fine, self.size, 0))]
        owner = [np.repeat(np.arange(n), np.diff(f)) for f in self.first]
        keep = [self.fine[o] for o in owner]
        ids = [i[k] for i, k in zip(self.ids, keep)]
        ends = [e[k] + at[o[k]] for e, o, k in zip(self.ends, owner, keep)]
        common = np.intersect1d(*ends, assume_unique=True)
        g = [np.searchsorted(common, e) for e in ends]
        count = [np.bincount(x, minlength=len(common)) for x in g]
        first = [np.r_[0, np.cumsum(c)] for c in count]
        of = np.searchsorted(at[1:], common, "left")
        number, links = np.bincount(of, minlength=n), np.bincount(of, count[0] * count[1], minlength=n).astype(np.int64)
        small = count[0] * count[1] <= PLAIN_LINKS
        # All token pairs of a group: each token of A beside all tokens of B.
        mine = small[g[0]]
        many = count[1][g[0][mine]]
        left, right = np.repeat(ids[0][mine], many), ids[1][_runs(first[1][g[0][mine]], many)]
        pairs, times, own = [left << 32 | right], [np.ones(len(left), np.int64)], [of[np.repeat(g[0][mine], many)]]
        for x in np.flatnonzero(~small):
            p, t = group_pairs(ids[0][first[0][x] : first[0][x + 1]], ids[1][first[1][x] : first[1][x + 1]])
            pairs, times, own = [*pairs, p], [*times, t], [*own, np.full(len(p), of[x])]
        pairs, times, own = np.concatenate(pairs), np.concatenate(times), np.concatenate(own)
        order = np.argsort(own, kind="stable")
        offsets = np.searchsorted(own[order], np.arange(n + 1))
        # The text of all groups: A's numbers, then B's, with the mark that follows each.
        total = count[0] + count[1]
        begin = np.cumsum(total) - total
        place = [begin[g[0]] + np.arange(len(g[0])) - first[0][g[0]], begin[g[1]] + count[0][g[1]] + np.arange(len(g[1])) - first[1][g[1]]]
        width, source, mark = np.zeros(int(total.sum()), np.int64), np.zeros(int(total.sum()), np.int64), np.full(int(total.sum()), ord(","), np.uint8)
        shift = 0
        for side, i, p in zip(sides, ids, place):
            width[p], source[p] = side.digits[i], side.digits_at[i] + shift
            shift += len(side.figures)
        mark[begin + count[0] - 1] = ord("|")
        mark[begin + total - 1] = ord(";")
        ends_at = np.cumsum(width + 1)
        body = np.empty(int(ends_at[-1]) if len(ends_at) else 0, np.uint8)
        body[ends_at - 1] = mark
        figures = np.concatenate([side.figures for side in sides])
        body[_runs(ends_at - 1 - width, width)] = figures[_runs(source, width)]
        raw = body.tobytes().decode()
        stop = np.r_[0, np.cumsum(np.bincount(of, weights=np.add.reduceat(width + 1, begin) if len(begin) else None, minlength=n))].astype(np.int64).tolist()
        texts = [raw[a : b - 1] if b > a else "" for a, b in zip(stop, stop[1:])]
        return texts, number, offsets, pairs[order], times[order], links


def _stretches(body: np.ndarray, rows: np.ndarray):
    """(texts, which of them is where, first stretch of each row) of the stretches between safe cuts; the space at a cut is left out."""
    cut = safe_cuts(body)
    cut[rows[:-1][rows[:-1] < len(body)]] = False
    # A cut looks at neighbours: at the edges of rows these belong to other texts.
    for edge in (rows[1:-1] - 1, rows[1:-1]):
        cut[edge[(edge >= 0) & (edge < len(body))]] = False
    filled = np.flatnonzero(rows[1:] > rows[:-1])
    spaces = np.flatnonzero(cut)
    start = np.sort(np.r_[rows[:-1][filled], spaces + 1])
    end = np.sort(np.r_[rows[1:][filled], spaces])
    keys = span_hashes(body, start, end)
    _, one, back = np.unique(keys, return_index=True, return_inverse=True)
    raw = body.tobytes()
    return [raw[start[i] : end[i]].decode() for i in one], back, np.searchsorted(start, rows)


# --- Spark jobs

_ROWS = (
    "kind int, block long, rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, near binary, far binary, times binary, "
    "pairs array<long>, docs array<int>, start long, text string"
)
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]
_TYPES = [pa.int32(), *[pa.int64()] * 7, pa.string(), *[pa.binary()] * 3, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.string()]
_ARROW = pa.schema(list(zip(_NAMES, _TYPES)))
#: Rows of a short document, of a block's pairs, and of a part of a long text.
_DOC, _BLOCK, _PART = 0, 1, 2


def _batch(n: int, **columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES)], schema=_ARROW)


def _packed(places: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Ascending numbers as steps of one byte (255: look into the second list), and their multiplicities."""
    step = np.diff(places, prepend=-1) - 1
    far = step >= 255
    return np.where(far, 255, step).astype(np.uint8).tobytes(), step[far].astype("<u4").tobytes(), (times - 1).astype("<u4").tobytes() if times.max(initial=1) > 1 else b""


def _unpacked(near: bytes, far: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    step = np.frombuffer(near, np.uint8).astype(np.int64)
    step[step == 255] = np.frombuffer(far, "<u4")
    return np.cumsum(step + 1) - 1, np.frombuffer(times, "<u4").astype(np.int64) + 1 if times else np.ones(len(step), np.int64)


def _encode(vocabularies: tuple[str, str], groups: bool):
    def block_rows(number: int, ids: list, rids: list, bodies: list[bytes], sides) -> Iterator[pa.RecordBatch]:
        body = np.frombuffer(b"".join(bodies), np.uint8)
        rows = np.r_[0, np.cumsum([len(b) for b in bodies])]
        n = len(bodies)
        texts, which, first = _stretches(body, rows)
        coded = _Coded(texts, sides)
        names, number_of, offsets, pairs, times, links = coded.groups(sides)
        owner = np.repeat(np.arange(n), np.diff(first))
        bad = np.bincount(owner, ~coded.fine[which], minlength=n) > 0
        good = ~bad[owner]
        total = lambda x: np.where(bad, 0, np.bincount(owner, x[which], minlength=n)).astype(np.int64)
        # Pairs of a block by falling number of its documents, so that most steps between the numbers of a document are small.
        keys, place = np.unique(pairs, return_inverse=True)
        size = np.diff(offsets)[which[good]]
        held = _runs(offsets[:-1][which[good]], size)
        code, back = np.unique(np.repeat(owner[good], size) * len(keys) + place[held], return_inverse=True)
        often = np.bincount(back, times[held], minlength=len(code)).astype(np.int64)
        doc, place = np.divmod(code, max(len(keys), 1))
        docs = np.bincount(place, minlength=len(keys))
        order = np.argsort(-docs, kind="stable")
        order = order[: np.count_nonzero(docs)]
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(order))
        place = rank[place]
        sort = np.lexsort((place, doc))
        doc, place, often = doc[sort], place[sort], often[sort]
        at = np.searchsorted(doc, np.arange(n + 1))
        lists = [_packed(place[at[i] : at[i + 1]], often[at[i] : at[i + 1]]) for i in range(n)]
        joined = ["" if bad[i] else ";".join([names[w] for w in which[first[i] : first[i + 1]]]) for i in range(n)]
        hashes = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in joined]
        near, far, more = zip(*lists) if lists else ((), (), ())
        yield _batch(
            n, kind=[_DOC] * n, block=[number] * n, rid=rids, doc_id=ids, n_a=total(np.diff(coded.first[0])), n_b=total(np.diff(coded.first[1])), n_groups=total(number_of),
            n_links=total(links), groups_sha256=hashes, near=near, far=far, times=more, **({"text": joined} if groups else {}),
        )
        yield _batch(1, kind=[_BLOCK], block=[number], pairs=[keys[order]], docs=[docs[order]])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(*vocabularies)
        ids, rids, bodies, size = [], [], [], 0
        for batch in released(batches):
            body, at = column_bytes(batch.column(1))
            raw = body.tobytes()
            for i, (doc, rid) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                text = raw[at[i] : at[i + 1]]
                if len(text) > PART_BYTES:
                    yield from _parts(doc, rid, text)
                    continue
                ids.append(doc)
                rids.append(rid)
                bodies.append(text)
                size += len(text)
                if size >= BLOCK_BYTES:
                    # A block goes by its first row's number.
                    yield from block_rows(rids[0], ids, rids, bodies, sides)
                    ids, rids, bodies, size = [], [], [], 0
        if bodies:
            yield from block_rows(rids[0], ids, rids, bodies, sides)

    return encode


def _parts(doc, rid: int, text: bytes) -> Iterator[pa.RecordBatch]:
    """Parts of a long text, each from one safe cut to the next one behind ``PART_BYTES``; the space at a cut is left out."""
    cuts = np.flatnonzero(safe_cuts(np.frombuffer(text, np.uint8)))
    start = 0
    while start <= len(text):
        later = np.searchsorted(cuts, start + PART_BYTES)
        end = int(cuts[later]) if later < len(cuts) else len(text)
        yield _batch(1, kind=[_PART], rid=[rid], doc_id=[doc], start=[start], text=[text[start:end].decode()])
        start = end + 1


_TREE = "rid long, node long, kind int, blob binary, start long, text string"
_FRAGMENT, _TEXT = 0, 1


def _blob(f: Fragment, counts: tuple[int, int]) -> bytes:
    import pickle

    return pickle.dumps((f, counts))


def _unblob(blob: bytes) -> tuple[Fragment, tuple[int, int]]:
    import pickle

    return pickle.loads(blob)


def _tree_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in _TREE.split(", ")]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)


def _leaves(vocabularies: tuple[str, str]):
    """Parts (rid, start, text) to fragments on the grid of bytes, and the texts of the groups that they close."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(*vocabularies)
        for batch in batches:
            for rid, start, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                body = np.frombuffer(text.encode(), np.uint8)
                texts, which, _ = _stretches(body, np.array([0, len(body)])) if len(body) else ([""], np.zeros(1, np.int64), None)
                coded = _Coded(texts, sides)
                # Offsets in the space and the text: a part begins with the space at its cut.
                begin = start + np.r_[0, np.cumsum(coded.size[which])]
                ids, ends = [], []
                for side in range(2):
                    first = coded.first[side]
                    size = np.diff(first)[which]
                    held = _runs(first[:-1][which], size)
                    ids.append(coded.ids[side][held])
                    ends.append(coded.ends[side][held] + np.repeat(begin[:-1], size))
                fine = bool(coded.fine[which].all())
                rows = []
                for cell in range(start // FRAGMENT_BYTES, int(begin[-1] - 1) // FRAGMENT_BYTES + 1):
                    a, b = (slice(*np.searchsorted(e, [cell * FRAGMENT_BYTES, (cell + 1) * FRAGMENT_BYTES], "right")) for e in ends)
                    part = (ids[0][a], ends[0][a], ids[1][b], ends[1][b])
                    f, done = fragment(*part, sides[0].name, sides[1].name) if fine else (Fragment(), "")
                    f.whole = fine
                    # A part's share of a cell of the grid has its place by where it begins.
                    place = max(start, cell * FRAGMENT_BYTES)
                    rows.append((rid, place, _FRAGMENT, _blob(f, (len(part[0]), len(part[2]))), place, None))
                    if done:
                        # Its groups follow the one that its prefix closes.
                        rows.append((rid, None, _TEXT, None, 2 * place + 1, done))
                yield _tree_batch(rows)

    return leaves


def _compose_rows(vocabularies: tuple[str, str]):
    """Fragments of one node of the tree, in order, to one; and the texts of groups that close between them."""

    def run(table: pa.Table) -> pa.Table:
        sides = _sides(*vocabularies)
        table = table.sort_by("start")
        rid, node, start = (table.column(c)[0].as_py() for c in ("rid", "node", "start"))
        out, rows = None, []
        for blob, place in zip(table.column("blob").to_pylist(), table.column("start").to_pylist()):
            f, counts = _unblob(blob)
            if out is None:
                out, total = f, counts
                continue
            out, group = compose(out, f)
            total = (total[0] + counts[0], total[1] + counts[1])
            if group:
                rows.append((rid, None, _TEXT, None, 2 * place, _group_text(*group, sides[0].name, sides[1].name)))
        rows.append((rid, node, _FRAGMENT, _blob(out, total), start, None))
        return pa.Table.from_batches([_tree_batch(rows)])

    return run


def _finish(vocabularies: tuple[str, str]):
    """The composed fragment of a long text as the row of a document and that of its block."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(*vocabularies)
        for batch in batches:
            for rid, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f, (n_a, n_b) = _unblob(blob)
                f, group = closed(f) if f.whole else (Fragment(whole=False), None)
                n = (n_a, n_b, f.groups, f.links) if f.whole else (0, 0, 0, 0)
                near, far, times = _packed(np.arange(len(f.pairs)), f.times)
                named = {c: [v] for c, v in zip(("n_a", "n_b", "n_groups", "n_links"), n)}
                text = _group_text(*group, sides[0].name, sides[1].name) if group else None
                yield _batch(1, kind=[_DOC], block=[rid], rid=[rid], **named, near=[near], far=[far], times=[times], start=[0], text=[text])
                yield _batch(1, kind=[_BLOCK], block=[rid], pairs=[f.pairs], docs=[np.ones(len(f.pairs), np.int32)])

    return finish


def _long(table: DataFrame, vocabularies: tuple[str, str], groups: bool) -> tuple[DataFrame, DataFrame]:
    """(document rows, block rows) of the long texts, by the tree."""
    spark = table.sparkSession
    parts = table.where(F.col("kind") == _PART)
    spread = parts.select("rid", "start", "text").repartition(shuffle_width(spark), "rid", "start")
    level = as_table(spread.mapInArrow(_leaves(vocabularies), _TREE), "fragments")
    texts = level.where(F.col("kind") == _TEXT)
    width = FRAGMENT_BYTES * FAN
    longest = parts.agg(F.max(F.col("start") + F.octet_length("text"))).first()[0]
    while True:
        nodes = level.where(F.col("kind") == _FRAGMENT).withColumn("node", F.floor(F.col("start") / width).cast("long"))
        level = as_table(nodes.groupBy("rid", "node").applyInArrow(_compose_rows(vocabularies), _TREE), "fragments")
        texts = texts.unionByName(level.where(F.col("kind") == _TEXT))
        if width > longest:
            break
        width *= FAN
    done = as_table(level.where(F.col("kind") == _FRAGMENT).select("rid", "blob").mapInArrow(_finish(vocabularies), _ROWS), "long_texts")
    rows = done.where(F.col("kind") == _DOC)
    # The group that a text begins with comes first.
    texts = texts.select("rid", "start", "text").unionByName(rows.select("rid", F.lit(-1).cast("long").alias("start"), "text").where("text is not null"))
    hashes = digest_in_order(texts, ["rid"], ["start"], "text", ";")
    rows = rows.drop("doc_id", "groups_sha256", "text").join(hashes, "rid", "left").join(parts.where("start = 0").select("rid", "doc_id"), "rid")
    joined = F.lit(None).cast("string")
    if groups:
        lists = texts.groupBy("rid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), ";").alias("text"))
        rows, joined = rows.join(lists, "rid", "left"), F.when(F.col("n_groups") > 0, F.col("text")).otherwise("")
    sha = F.when(F.col("n_groups") > 0, F.col("sha256")).otherwise("")
    return rows.withColumns({"groups_sha256": sha, "text": joined}).select(*_NAMES), done.where(F.col("kind") == _BLOCK)


def _weigh(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a block with the sums over their links; ``right`` has the corpus counts of the block's pairs by place."""
    n = right.num_rows
    docs, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = right.column("place").to_numpy()
    docs[at], best[at] = right.column("docs").to_numpy(), right.column("best").to_numpy().astype(np.int64)
    n_best, count_sum = [], []
    for near, far, times in zip(*(left.column(c).to_pylist() for c in ("near", "far", "times"))):
        place, often = _unpacked(near, far, times)
        n_best.append(int(often @ best[place]))
        count_sum.append(int(often @ docs[place]))
    out = left.drop_columns(["block", "near", "far", "times"])
    return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


def align_tokens(docs: DataFrame, vocabulary_a: str, vocabulary_b: str, with_groups: bool = False) -> DataFrame:
    """One row per row of ``docs``: how the tokens of two tokenizers lie beside each other in its text.

    ``vocabulary_a`` is a byte-level tokenizers file, ``vocabulary_b`` a sentencepiece model that adds the leading space
    itself; both are files that executors can read, and strings of special tokens in a text are plain text. Groups
    lie between byte offsets where tokens of both end; every token of A is linked with every token of B in its group.
    Returns doc_id, n_a and n_b (tokens), n_groups, n_links, n_best (links whose id pair is held linked by as many
    documents as any pair of its A id), count_sum (over links, how many documents hold the pair linked) and
    groups_sha256 (of the groups' text ``a1,a2|b1;a3|b2,b3``); with ``with_groups`` also that text. Null and empty
    texts, and those that tokens do not give back byte by byte, have zeros and ''. Repeated rows and rows without
    doc_id are documents like others; other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    names = (vocabulary_a, vocabulary_b)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("rid"))
    table = as_table(source.mapInArrow(_encode(names, with_groups), _ROWS), "aligned")
    rows, blocks = table.where(F.col("kind") == _DOC), table.where(F.col("kind") == _BLOCK)
    if not table.where(F.col("kind") == _PART).isEmpty():
        long_rows, long_blocks = _long(table, names, with_groups)
        rows, blocks = rows.unionByName(long_rows), blocks.unionByName(long_blocks)
    held = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "x")).select("block", "place", "x.pairs", "x.docs")
    counts = as_table(held.groupBy("pairs").agg(F.sum("docs").alias("docs")), "pair_counts")
    a = F.shiftright("pairs", 32)
    # One row an id of A: its vocabulary bounds what is broadcast.
    most = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    judged = counts.join(F.broadcast(most), a == F.col("a")).select("pairs", "docs", (F.col("docs") == F.col("most")).cast("int").alias("best"))
    found = held.select("block", "place", "pairs").join(judged, "pairs").select(F.col("block").alias("of"), "place", "docs", "best")
    shape = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string" + (", text string" if with_groups else "")
    kept = [c.split()[0] for c in shape.split(", ")]
    left = rows.select("block", *kept, "near", "far", "times")
    out = left.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(_weigh, shape + ", n_best long, count_sum long")
    return out.withColumnRenamed("text", "groups") if with_groups else out
