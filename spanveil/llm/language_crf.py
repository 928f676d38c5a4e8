"""Language of documents by a linear-chain conditional random field over their words.

Each word has a label, one of the languages of the labelled rows. Features of a word are its affixes, its byte bigrams
and trigrams (hashed) and its place in a lexicon of frequent words; between neighbours there are learned transitions.
Forward-backward gives every word its label distribution, in code-switched text too; a document's language is the label
with the largest share of its words.

The field is fitted on the driver, on a bounded sample of labelled rows (``SAMPLE_ROWS`` a language; of a text
longer than ``SAMPLE_BYTES`` bytes a span of words of that size), spliced so that labels change within a sequence. Prediction runs on the executors over whole
texts. Long texts are cut into blocks of words whose transfer matrices are combined in order, so that the sums over a
text are exact while numpy works on all blocks of a piece at once.

``in_learned_language`` rejects what the field does not recognise. The transitions carry a label through any text, so
posteriors are high in gibberish too; the rule therefore takes each word's own message of the forward-backward pass,
before neighbours are mixed in. A text's certainty is the mean of these messages' largest label probability, scaled to 0
for even labels and 1 for sure ones. A text below the field's ``floor`` with less than half of its words in the lexicon is
in no learned language. The floor is ``FLOOR``, or ``FLOOR_SHARE`` of the median certainty of spare documents of the
language with the lowest one, if that is less: a weakly fitted field rejects less, not its own languages. The language of
the others is decoded by forward-backward, as in a prediction, and has to have more than an even share of the words.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches
from .words import Words, mix, pieces, released, span_hashes

SAMPLE_ROWS = 400
SAMPLE_BYTES = 8000
#: All sampled text; with many languages the spans get shorter.
SAMPLE_TOTAL = 32_000_000
#: With more labelled languages fit_on raises an error: transfer matrices and weights grow with their number.
MAX_LANGUAGES = 128
BUCKETS = 1 << 15
LEXICON_LEAST = 3
FLOOR, FLOOR_SHARE, FLOOR_ROWS = 0.4, 0.6, 50
#: Rows of a language from which on a sixteenth of them is kept for the floor.
SPLIT_ROWS = 64
BLOCK = 128
_TRAIN_LENGTH, _TRAIN_BATCH, _TRAIN_STEPS = 64, 64, 150

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC3:] = True
_LETTER[0x80:0xC0] = True


def lowered(body: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals in lower case."""
    out = body.copy()
    out[(body >= 65) & (body <= 90)] += 32
    if len(body) > 1:
        capital = (body[:-1] == 0xC3) & (body[1:] >= 0x80) & (body[1:] <= 0x9E) & (body[1:] != 0x97)
        out[1:][capital] += 32
    return out


def _feature_lists(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of all affix and n-gram features of the byte spans."""
    length = end - start
    words, buckets = [], []

    def add(which: np.ndarray, a: np.ndarray, b: np.ndarray, salt: int) -> None:
        words.append(which)
        buckets.append((mix(span_hashes(body, a, b) + np.uint64(salt)) % np.uint64(BUCKETS)).astype(np.int32))

    for n in (2, 3, 4):
        at = np.flatnonzero(length >= n)
        add(at, start[at], start[at] + n, n)
        add(at, end[at] - n, end[at], 10 + n)
    for n in (2, 3):
        at = np.flatnonzero(length >= n)
        many = length[at] - n + 1
        which = np.repeat(at, many)
        a = np.arange(int(many.sum())) + np.repeat(start[at] - np.r_[0, np.cumsum(many)[:-1]] if len(at) else at, many)
        add(which, a, a + n, 20 + n)
    return np.concatenate(words), np.concatenate(buckets)


class _Piece:
    """Distinct words of a piece with their features, and where they occur."""

    def __init__(self, body: np.ndarray, rows: np.ndarray):
        self.words = Words(lowered(body), rows)
        w = self.words
        start, end = w.start.copy(), w.end.copy()
        letter = _LETTER[w.body]
        at = np.r_[0, np.cumsum(letter)]
        self.lettered = at[end] > at[start]
        # Punctuation around a word is no part of it.
        place = np.flatnonzero(letter)
        if len(place):
            first = np.searchsorted(place, start)
            last = np.searchsorted(place, end) - 1
            good = self.lettered
            start[good] = place[first[good]]
            end[good] = place[last[good]] + 1
        key = span_hashes(w.body, start, end)
        key[~self.lettered] = 0
        self.keys, one, self.back = np.unique(key, return_index=True, return_inverse=True)
        self.start, self.end = start[one], end[one]
        blank = self.keys == 0
        self.end[blank] = self.start[blank]


class _Sample(_Piece):
    """The same of the texts of a sample, put together from pieces of bounded size: the driver holds no array as long as the sample.

    Of the text only the distinct words are kept.
    """

    def __init__(self, texts: list[str]):
        keys, bodies, starts, ends, backs, lettered, counts = [], [], [], [], [], [], []
        place = number = 0
        for _, _, body, rows in pieces(pa.array(texts, pa.string())):
            p = _Piece(body, rows)
            size = p.end - p.start
            end = np.cumsum(size)
            bodies.append(p.words.body[np.arange(int(size.sum())) + np.repeat(p.start - (end - size), size)])
            starts.append(place + end - size)
            ends.append(place + end)
            keys.append(p.keys)
            backs.append(number + p.back)
            lettered.append(p.lettered)
            counts.append(p.words.count)
            place, number = place + int(size.sum()), number + len(p.keys)
        whole = lambda arrays, kind: np.concatenate(arrays) if arrays else np.zeros(0, kind)
        self.keys, one, new = np.unique(whole(keys, np.uint64), return_index=True, return_inverse=True)
        self.start, self.end = whole(starts, np.int64)[one], whole(ends, np.int64)[one]
        self.back, self.lettered, count = new[whole(backs, np.int64)], whole(lettered, bool), whole(counts, np.int64)
        self.words = SimpleNamespace(body=whole(bodies, np.uint8), count=count, first=np.r_[0, np.cumsum(count)], row=np.repeat(np.arange(len(count)), count))


class Field:
    """A fitted field."""

    def __init__(self, labels: list[str], lexicon: np.ndarray):
        self.labels = labels
        self.lexicon = lexicon
        n = len(labels)
        self.gram = np.zeros((BUCKETS, n), np.float32)
        self.word = np.zeros((len(lexicon) + 1, n), np.float32)  # the last row is for words outside the lexicon
        self.move = np.eye(n, dtype=np.float64)
        self.floor = 0.0

    def features(self, piece: _Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        word, bucket = _feature_lists(piece.words.body, piece.start, piece.end)
        order = np.argsort(word, kind="stable")
        at = np.searchsorted(self.lexicon, piece.keys) if len(self.lexicon) else np.zeros(len(piece.keys), np.int64)
        at[at == len(self.lexicon)] = 0
        known = self.lexicon[at] == piece.keys if len(self.lexicon) else np.zeros(len(piece.keys), bool)
        return word[order], bucket[order], np.where(known, at, len(self.lexicon)), np.bincount(word, minlength=len(piece.keys))

    def emissions(self, piece: _Piece) -> np.ndarray:
        """Log potentials of the labels for each distinct word."""
        word, bucket, lexicon, many = self.features(piece)
        out = np.zeros((len(piece.keys), len(self.labels)), np.float32)
        some = np.flatnonzero(many)
        if len(some):
            begin = np.searchsorted(word, some)
            out[some] = np.add.reduceat(self.gram[bucket], begin) / many[some, None]
        out += self.word[lexicon]
        out[piece.keys == 0] = 0
        return out


def _sequences(piece: _Piece, label_of_row: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Training sequences of distinct-word numbers and labels, spliced of segments in random order."""
    words, rows = piece.back, piece.words.row
    cuts = [0]
    bounds = piece.words.first
    for a, b in zip(bounds[:-1], bounds[1:]):
        while a < b:
            a = min(b, a + int(rng.integers(8, 64)))
            cuts.append(a)
    cuts = np.array(cuts)
    order = rng.permutation(len(cuts) - 1)
    take = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in order]) if len(order) else np.zeros(0, np.int64)
    take = take[piece.lettered[take]]
    n = max(1, len(take) // _TRAIN_LENGTH)
    take = np.resize(take, n * _TRAIN_LENGTH) if len(take) else take
    return words[take].reshape(-1, _TRAIN_LENGTH), label_of_row[rows[take]].reshape(-1, _TRAIN_LENGTH)


def fit(texts: list[str], langs: list[str], seed: int = 5) -> Field:
    """Fit by stochastic gradient on the conditional likelihood of spliced sequences (AdaGrad)."""
    labels = sorted(set(langs))
    piece = _Sample(texts)
    counts = np.bincount(piece.back, minlength=len(piece.keys))
    field = Field(labels, piece.keys[(counts >= LEXICON_LEAST) & (piece.keys != 0)])
    if len(labels) < 2 or not len(piece.back):
        return field
    rng = np.random.default_rng(seed)
    x, y = _sequences(piece, np.array([labels.index(c) for c in langs]), rng)
    if not x.size:
        return field
    word, bucket, lexicon, many = field.features(piece)
    begin = np.r_[0, np.cumsum(many)]
    n = len(labels)
    squares = [np.full_like(field.gram, 1e-4), np.full_like(field.word, 1e-4), np.full_like(field.move, 1e-2)]
    for _ in range(_TRAIN_STEPS):
        pick = rng.integers(0, len(x), _TRAIN_BATCH)
        uniq, inner = np.unique(x[pick], return_inverse=True)
        inner = inner.reshape(_TRAIN_BATCH, _TRAIN_LENGTH)
        reps = many[uniq]
        own = np.repeat(np.arange(len(uniq)), reps)
        at = np.arange(int(reps.sum())) + np.repeat(begin[uniq] - np.r_[0, np.cumsum(reps)[:-1]], reps)
        grams = bucket[at]
        emit = np.zeros((len(uniq), n))
        for c in range(n):
            emit[:, c] = np.bincount(own, field.gram[grams, c], len(uniq)) / np.maximum(reps, 1)
        emit += field.word[lexicon[uniq]]
        potential = emit[inner]
        e = np.exp(potential - potential.max(2, keepdims=True))
        a = np.exp(field.move)
        alpha, beta = np.empty_like(e), np.empty_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, _TRAIN_LENGTH):
            alpha[:, t] = (alpha[:, t - 1] @ a) * e[:, t]
            alpha[:, t] /= alpha[:, t].sum(1, keepdims=True)
        beta[:, -1] = 1
        for t in range(_TRAIN_LENGTH - 2, -1, -1):
            beta[:, t] = (e[:, t + 1] * beta[:, t + 1]) @ a.T
            beta[:, t] /= beta[:, t].sum(1, keepdims=True)
        gamma = alpha * beta
        gamma /= gamma.sum(2, keepdims=True)
        before, behind = alpha[:, :-1].reshape(-1, n), (e[:, 1:] * beta[:, 1:]).reshape(-1, n)
        before = before / ((before @ a) * behind).sum(1, keepdims=True)
        pair = a * (before.T @ behind)
        truth = np.eye(n)[y[pick]]
        move_grad = np.einsum("bti,btj->ij", truth[:, :-1], truth[:, 1:]) - pair - 1e-2 * field.move
        error = np.zeros((len(uniq), n))
        for c in range(n):
            error[:, c] = np.bincount(inner.reshape(-1), (truth - gamma)[:, :, c].reshape(-1), len(uniq))
        spread = error[own] / np.maximum(reps, 1)[own][:, None]
        touched, where = np.unique(grams, return_inverse=True)
        gram_grad = np.stack([np.bincount(where, spread[:, c], len(touched)) for c in range(n)], 1) - 1e-4 * field.gram[touched]
        lex, where = np.unique(lexicon[uniq], return_inverse=True)
        word_grad = np.stack([np.bincount(where, error[:, c], len(lex)) for c in range(n)], 1) - 1e-3 * field.word[lex]
        word_grad[lex == len(field.lexicon)] = 0
        for value, index, grad, square, rate in ((field.gram, touched, gram_grad, squares[0], 1.0), (field.word, lex, word_grad, squares[1], 0.3)):
            square[index] += grad**2
            value[index] += rate * grad / np.sqrt(square[index])
        squares[2] += move_grad**2
        field.move += 0.2 * move_grad / np.sqrt(squares[2])
    return field


def certainties(field: Field, piece: _Piece) -> tuple[np.ndarray, np.ndarray]:
    """For each row the mean certainty of its words that have letters, and the share of them in the lexicon (1, 1 without such words)."""
    n, count = len(field.labels), len(piece.words.count)
    if n == 1 or not len(piece.back):
        return np.ones(count), np.ones(count)
    emit = field.emissions(piece).astype(np.float64)
    e = np.exp(emit - emit.max(1, keepdims=True))
    sure = (1 / e.sum(1) - 1 / n) / (1 - 1 / n)
    row = piece.words.row
    words = np.bincount(row, piece.lettered, count)
    mean = lambda x: np.divide(np.bincount(row, x[piece.back] * piece.lettered, count), words, out=np.ones(count), where=words > 0)
    return mean(sure), mean(np.isin(piece.keys, field.lexicon))


def foreign(field: Field, piece: _Piece) -> np.ndarray:
    """True for the rows in no learned language."""
    sure, known = certainties(field, piece)
    return (sure < field.floor) & (known < 0.5)


def set_floor(field: Field, texts: list[str], langs: list[str]) -> Field:
    """Set the floor by labelled documents that the field was not fitted on."""
    sure, _ = certainties(field, _Sample(texts))
    langs = np.array(langs, object)
    field.floor = min([FLOOR, *(FLOOR_SHARE * float(np.median(sure[langs == c])) for c in set(langs))])
    return field


def label_shares(field: Field, piece: _Piece) -> np.ndarray:
    """For each row the mean label distribution of its words that have letters (zeros without such words)."""
    n, count = len(field.labels), piece.words.count
    shares = np.zeros((len(count), n))
    if n == 1:
        shares[np.bincount(piece.words.row[piece.lettered], minlength=len(count)) > 0] = 1
        return shares
    if not len(piece.back):
        return shares
    emit = field.emissions(piece).astype(np.float64)
    emit = np.maximum(np.exp(emit - emit.max(1, keepdims=True)), 1e-12)
    blocks = -(-count // BLOCK)
    total = int(blocks.sum())
    block_row = np.repeat(np.arange(len(count)), blocks)
    block_no = np.arange(total) - np.repeat(np.r_[0, np.cumsum(blocks)[:-1]], blocks)
    begin = piece.words.first[:-1][block_row] + block_no * BLOCK
    size = np.minimum(BLOCK, piece.words.first[1:][block_row] - begin)
    a = np.exp(field.move - field.move.max())
    e = np.ones((BLOCK, total, n))
    lettered = np.zeros((BLOCK, total))
    inside = np.arange(BLOCK)[:, None] < size[None, :]
    at = (begin[None, :] + np.arange(BLOCK)[:, None])[inside]
    e[inside] = emit[piece.back[at]]
    lettered[inside] = piece.lettered[at]
    moved = inside[:, :, None]
    # Transfer matrices of the blocks.
    long = np.flatnonzero(blocks[block_row] > 1)  # a row of one block needs none
    slot = np.zeros(total, np.int64)
    slot[long] = np.arange(len(long))
    f = np.broadcast_to(np.eye(n), (len(long), n, n)).copy()
    opens = block_no == 0  # no transition leads to the first word of a row
    for t in range(BLOCK if len(long) else 0):
        to = f @ a if t else np.where(opens[long][:, None, None], f, f @ a)
        f = np.where(moved[t][long][:, :, None], to * e[t][long][:, None, :], f)
        if t % 4 == 3:
            f /= f.max((1, 2), keepdims=True)
    # What enters a block from the left, and from the right.
    left, right = np.full((total, n), 1.0 / n), np.ones((total, n))
    last = blocks[block_row] - 1
    for k in range(1, int(blocks.max())):
        here = np.flatnonzero(block_no == k)
        v = np.einsum("bi,bij->bj", left[here - 1], f[slot[here - 1]])
        left[here] = v / v.sum(1, keepdims=True)
    for k in range(int(blocks.max()) - 2, -1, -1):
        here = np.flatnonzero((block_no == k) & (last > k))
        v = np.einsum("bij,bj->bi", f[slot[here + 1]], right[here + 1])
        right[here] = v / v.sum(1, keepdims=True)
    alpha = np.empty((BLOCK, total, n))
    v = left
    for t in range(BLOCK):
        w = (v @ a if t else np.where(opens[:, None], v, v @ a)) * e[t]
        v = np.where(moved[t], w / w.sum(1, keepdims=True), v)
        alpha[t] = v
    summed = np.zeros((total, n))
    v = right
    for t in range(BLOCK - 1, -1, -1):
        g = alpha[t] * v
        summed += np.where(moved[t], g / g.sum(1, keepdims=True), 0) * lettered[t][:, None]
        w = (e[t] * v) @ a.T
        v = np.where(moved[t], w / w.sum(1, keepdims=True), v)
    for c in range(n):
        shares[:, c] = np.bincount(block_row, summed[:, c], len(count))
    whole = shares.sum(1, keepdims=True)
    return np.divide(shares, whole, out=np.zeros_like(shares), where=whole > 0)


def _share(field: Field) -> tuple[int, int]:
    """Bytes and rows of a piece: a row takes ``BLOCK`` places at least, a place some hundred bytes for four labels."""
    many = max(4, len(field.labels))
    return 2_000_000 // many, max(16, 6_000 // many)


def _texts(batch: pa.RecordBatch, text: str) -> pa.Array:
    column = batch.column(text)
    return column if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(pa.string())


def _predict(field: Field, text: str, before: int):
    """Batches of ``before`` columns and one more, which says whether ``text`` has a letter, with lang_pred and score in its place."""

    def predict(batches):
        for batch in released(batches):
            names = batch.schema.names[:before]
            some = batch.column(before).to_numpy(zero_copy_only=False)
            for first, end, body, rows in pieces(_texts(batch, text), *_share(field)):
                shares = label_shares(field, _Piece(body, rows))
                best = shares.argmax(1)
                score = shares[np.arange(len(best)), best]
                bare = shares.sum(1) == 0  # letters that no word of the field can hold: the first label, unsure
                score = np.where(bare, 1.0 / len(field.labels), np.clip(score, 0, 1))
                there = some[first:end]
                pred = np.where(there, np.array(field.labels, object)[best], "und")
                own = [batch.column(i).slice(first, end - first) for i in range(before)]
                yield pa.record_batch([*own, pa.array(pred, pa.string()), pa.array(np.where(there, score, 0.0))], names=[*names, "lang_pred", "score"])

    return predict


def decoded(field: Field, piece: _Piece) -> np.ndarray:
    """For each row the place of its language among the labels, by forward-backward over its whole text; -1 for rows in none.

    A row is in no learned language where its words' own messages are too weak (``foreign``), or where no more than an even
    share of its words has the label that the field decodes. A row without a word of the field has the first label.
    """
    shares = label_shares(field, piece)
    best = shares.argmax(1)
    top, bare = shares.max(1), shares.sum(1) == 0
    even = (top <= 1 / len(field.labels) + 1e-9) & ~bare & (len(field.labels) > 1)
    return np.where(foreign(field, piece) | even, -1, best)


def _learned(field: Field, text: str):
    """The rows of batches whose ``text`` the field decodes to a learned language."""

    def learned(batches):
        for batch in released(batches):
            own = [decoded(field, _Piece(body, rows)) for _, _, body, rows in pieces(_texts(batch, text), *_share(field))]
            if own:
                yield batch.filter(pa.array(np.concatenate(own) >= 0))

    return learned


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def _sample(labelled: DataFrame, rows: dict[int, int], size: int, counts: dict[tuple[str, int], int]) -> list:
    """(text, lang, part) of the rows with the smallest hashes, so many a language and part; of long texts a span of words of ``size`` bytes.

    ``rows`` has the rows of a part, ``counts`` those that a language and part have. Hashes above four times the sample's
    share are left out before rows are ordered, so a language of any size brings a few rows to the window.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    share = {f"{part}{c}": min(1 << 31, -(-(4 * rows[part] << 31) // max(n, 1))) for (c, part), n in counts.items()}
    limit = F.element_at(F.create_map(*[F.lit(x) for c, n in share.items() for x in (c, n)]), F.concat(F.col("part").cast("string"), "lang"))
    labelled = labelled.where(place < limit)
    order = Window.partitionBy("lang", "part").orderBy(place, "doc_id")
    most = F.when(F.col("part") == 0, rows[0]).otherwise(rows[1])
    chosen = labelled.select("doc_id", "lang", "part").withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= most).select("doc_id", "lang").distinct()
    take = F.greatest(F.floor(F.lit(size).cast("long") * F.length("text") / F.octet_length("text")), F.lit(1)).cast("int")
    begin = (F.pmod(F.xxhash64("doc_id"), F.length("text") - take + 1) + 1).cast("int")
    span = F.substring("text", begin, take)
    words = F.regexp_replace(span, r"^\S*\s+|\s+\S*$", "")  # without the halves of words at both ends
    words = F.when(words.rlike(r"\S"), words).otherwise(span)
    labelled = labelled.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").withColumn("text", F.when(F.octet_length("text") > size, words).otherwise(F.col("text")))
    return labelled.groupBy("doc_id", "lang", "part").agg(F.min("text").alias("text")).orderBy("doc_id", "lang").select("text", "lang", "part").collect()


def fit_on(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Field | None:
    """Fit on the rows with the smallest hashes among the labelled ones outside the held-out fold; None without any.

    Every language with a text outside the held-out fold is learned; more than ``MAX_LANGUAGES`` raise a ValueError. The
    floor is set on a sixteenth of the rows outside the held-out fold that the field is not fitted on; languages with few
    rows are fitted on all of theirs, and these have to do for the floor too. The held-out fold is never looked at.
    """
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    part = (F.floor(number / 4) % 16 == 0).cast("int").alias("part")
    outside = docs.where("lang is not null and doc_id is not null").where(F.octet_length("text") >= 1).where(fold() != 2).select("doc_id", "text", "lang", part)
    counts = outside.groupBy("lang").agg(F.sum(1 - F.col("part")).alias("own"), F.sum("part").alias("spare")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labelled languages")
    if not counts:
        return None
    size = min(SAMPLE_BYTES, SAMPLE_TOTAL // (rows * len(counts)))
    small = [r["lang"] for r in counts if r["own"] < SPLIT_ROWS]
    if small:
        outside = outside.withColumn("part", F.when(F.col("lang").isin(*small), 0).otherwise(F.col("part")))
    many = {(r["lang"], 0): r["own"] + (r["spare"] if r["lang"] in small else 0) for r in counts} | {(r["lang"], 1): r["spare"] for r in counts if r["lang"] not in small}
    found = _sample(outside, {0: rows, 1: FLOOR_ROWS}, size, many)
    sample = [r for r in found if r["part"] == 0]
    field = fit([r["text"] for r in sample], [r["lang"] for r in sample])
    check = [r for r in found if r["part"] == 1]
    missing = set(field.labels) - {r["lang"] for r in check}  # for these the fitted rows have to do
    check = check + [r for r in sample if r["lang"] in missing]
    return set_floor(field, [r["text"] for r in check], [r["lang"] for r in check])


def _fitted(docs: DataFrame) -> Field | None:
    return fit_on(docs.select(*(F.col(c).cast(kind).alias(c) for c, kind in (("doc_id", "long"), ("text", "string"), ("lang", "string"))))) if "lang" in docs.columns else None


def in_learned_language(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """The rows of ``docs`` whose text has a letter and is in a learned language (the rule is in the module's text).

    The field is fitted on ``docs`` unless ``model`` is given. Where there is none (no usable labelled row), and with one
    language alone, from which nothing can be told apart, all texts with a letter stay.
    """
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    lettered = docs.where(text.rlike(r"\p{L}"))
    model = model or _fitted(docs)
    if model is None:
        return lettered
    return lettered.mapInArrow(_learned(model, "text"), docs.schema)


def with_language(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """``docs`` with held_out, lang_pred and score (see identify_language); columns of these names are replaced."""
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    docs = docs.select(*others)
    model = model or _fitted(docs)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out")
    if model is None:
        return docs.select("*", held, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    text = F.col("text").cast("string")
    source = docs.select("*", F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = source.mapInArrow(_predict(model, "text", len(others)), f"{kinds}, lang_pred string, score double")
    return out.select(*others, held, "lang_pred", "score")


def identify_language(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """Predict the language of every whole text.

    The field is fitted on ``docs`` (columns doc_id, text, lang) unless ``model`` is given. Returns one row per row of
    ``docs``: doc_id, held_out (crc32 of the doc_id modulo 4 is 2; null ids: false), lang_pred (a learned label, or
    ``und`` where the text is null or has no letter) and score (the share of that label among the text's words; 0 for
    ``und``). Without labelled rows every text is ``und``. Repeated rows are predicted alike; other columns are ignored.
    """
    model = model or (fit_on(docs) if "lang" in docs.columns else None)
    return with_language(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model).drop("text")
