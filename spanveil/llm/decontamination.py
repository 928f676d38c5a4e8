"""Documents that hold benchmark items, re-parameterised ones included (template canonicalisation).

A text becomes template tokens: its words without outer punctuation, in lower case, with numbers, units behind numbers
and names replaced by typed placeholders. Windows of template tokens are hashed and joined with the windows of the
benchmark. What stood in the placeholders (slots) is compared within each pair of windows: one name of the item must
always meet the same name of the document, and the other way round, else this pair of windows does not count; the windows
around it do. Numbers and units are not bound by each other: new values may coincide, and equal ones may part. A document
is contaminated where the windows that it shares with one item cover enough of the item's tokens. Windows of few plain
words say little by themselves: they count only where, in one alignment, they and the others cover nearly the whole item.

Beside the templates there is an exact path: windows of the tokens themselves, in lower case, whatever they are. Verbatim
copies of items of any length match by it, and a verbatim run of ``RUN`` tokens is a leak whatever its share of the item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language_crf import lowered
from .shared import as_table, small_batches
from .words import Words, mix, pieces, released, span_hashes

#: Template tokens of a window, and how many of them are plain words in one that counts by itself, and in a thin one.
WINDOW, LEAST_WORDS, THIN_WORDS = 8, 5, 2
#: An item is found by its thin windows if it has so many plain words and one alignment covers this share of it.
WHOLE_WORDS, WHOLE = 4, 0.9
#: Tokens of a verbatim run that is a leak by itself.
RUN = 13
#: Share of an item's tokens that consistent alignments have to cover.
COVER = 0.5
#: Window hashes of the benchmark that go to every task as a first filter (16 MB); a larger benchmark is joined by shuffle alone.
FILTER_KEYS = 2_000_000

# Units that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal s sec secs min mins h hr hrs d day days week weeks month months year years "
    "hour hours minute minutes second seconds inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres usd eur gbp dollar dollars euro euros cent cents "
    "percent % ° °c °f c f k kb mb gb tb hz khz mhz ghz w kw v a mph kmh km/h m/s"
).split()

_RANDOM = np.random.default_rng(11).integers(1, 2**63, 4, dtype=np.uint64)
_NUMBER, _UNIT, _NAME, _EXACT = _RANDOM
_NAMED = 2  # bit of a name's slot value
_SOFT = np.zeros(256, bool)  # bytes that belong to a token's core
_SOFT[48:58] = _SOFT[65:91] = _SOFT[97:123] = True
_SOFT[0x80:] = True
_SOFT[ord("%")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NUMERIC = _DIGIT.copy()
_NUMERIC[[ord(c) for c in ".,:/-+"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\"'()"]] = True


def _unit_keys() -> np.ndarray:
    body = np.frombuffer("".join(UNITS).encode(), np.uint8)
    at = np.r_[0, np.cumsum([len(u.encode()) for u in UNITS])]
    return np.unique(span_hashes(body, at[:-1], at[1:]))


def templates(body: np.ndarray, rows: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a piece; per token its own hash, template hash, slot value (0 for a plain word) and whether it is a
    plain word that a capital by its place may hide a name of; the tokens' word numbers."""
    words = Words(body, rows)
    low = lowered(body)
    soft = np.flatnonzero(_SOFT[body])
    a = np.searchsorted(soft, words.start)
    b = np.searchsorted(soft, words.end) - 1
    token = np.flatnonzero(b >= a)
    start, end = soft[a[token]], soft[b[token]] + 1
    core = span_hashes(low, start, end)

    def has(table: np.ndarray) -> np.ndarray:
        at = np.r_[0, np.cumsum(table[body])]
        return at[end] - at[start]

    number = (has(_DIGIT) > 0) & (has(_NUMERIC) == end - start)
    row = words.row[token]
    follows = np.zeros(len(token), bool)  # behind another token of the row
    follows[1:] = row[1:] == row[:-1]
    after_number = np.zeros(len(token), bool)
    after_number[1:] = number[:-1]
    unit = follows & after_number & np.isin(core, _unit_keys())
    line = np.r_[0, np.cumsum(body == 10)]
    inside = follows.copy()  # neither first in a line nor behind the end of a sentence
    if len(token) > 1:
        before_end = words.end[token[:-1]]
        inside[1:] &= ~_STOP[body[before_end - 1]] & (line[start[1:]] == line[before_end])
    capital = (body[start] >= 65) & (body[start] <= 90) if len(start) else np.zeros(0, bool)
    wide = (body[start] == 0xC3) if len(start) else capital
    second = body[np.minimum(start + 1, len(body) - 1)] if len(start) else capital
    capital = capital | (wide & (second >= 0x80) & (second <= 0x9E))
    name = inside & capital & ~number & ~unit
    key = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, core)))
    value = np.where(number | unit | name, core & ~np.uint64(3) | np.where(name, np.uint64(_NAMED | 1), np.uint64(1)), np.uint64(0))
    return words, core, key, value, capital & ~inside & ~number & ~unit, token


class _Tokens(Words):
    """Template tokens in the place of words."""

    def __init__(self, words: Words, token: np.ndarray):
        self.row = words.row[token]
        self.start = words.start[token]
        self.first = np.searchsorted(self.row, np.arange(len(words.rows)))


_HITS = "doc_id long, pos int, n_tokens int, n_plain int, k int, exact boolean, thin boolean, key long, slots array<long>"
_HITS_ARROW = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("n_tokens", pa.int32()), ("n_plain", pa.int32()), ("k", pa.int32()), ("exact", pa.bool_()), ("thin", pa.bool_()), ("key", pa.int64()), ("slots", pa.list_(pa.int64()))])


def _readings(tokens: _Tokens, core: np.ndarray, key: np.ndarray, value: np.ndarray, maybe: np.ndarray, k: int):
    """(exact, first tokens of windows, hashes, slots or None, number of plain words) for each reading of the windows of k tokens.

    A name at the beginning of a window is read as a plain word too (an item's first word has a capital by its place), and
    a word with a capital by its place as a name too (an item may begin with a name).
    """
    whole = np.flatnonzero(tokens.whole(k))

    def hashes(first: np.ndarray, rest: np.ndarray, at: np.ndarray) -> np.ndarray:
        if k == 1:
            return mix(first[at])
        return mix(mix(first[at]) * (_EXACT | np.uint64(1)) + rest[at + 1] + np.uint64(k))

    if k <= WINDOW or k == RUN:
        yield True, whole, hashes(core, tokens.windows(core, k - 1) if k > 1 else core, whole) ^ _EXACT, None, np.full(len(whole), k)
    if 3 <= k <= WINDOW:
        rest = tokens.windows(key, k - 1)
        plain = np.r_[0, np.cumsum(value == 0)]
        words = plain[whole + k] - plain[whole]
        slots = lambda at: value[at[:, None] + np.arange(k)[None, :]]
        good = words >= THIN_WORDS
        yield False, whole[good], hashes(key, rest, whole[good]), slots(whole[good]), words[good]
        good = (words + 1 >= THIN_WORDS) & (key[whole] == _NAME)
        at, own = whole[good], slots(whole[good])
        own[:, :1] = 0
        yield False, at, hashes(core, rest, at), own, words[good] + 1
        good = (words - 1 >= THIN_WORDS) & maybe[whole]
        at, own = whole[good], slots(whole[good])
        own[:, 0] = core[at] & ~np.uint64(3) | np.uint64(_NAMED | 1)
        yield False, at, hashes(np.full(len(core), _NAME), rest, at), own, words[good] - 1


def _windows(lengths: tuple[int, ...], wanted: np.ndarray | None):
    def windows(batches):
        for batch in released(batches):
            ids = batch.column(0).to_numpy()
            for first, _, body, rows in pieces(batch.column(1)):
                words, core, key, value, maybe, token = templates(body, rows)
                tokens = _Tokens(words, token)
                count = np.diff(tokens.first)
                plain = np.diff(np.r_[0, np.cumsum(value == 0)][tokens.first])
                for k in lengths:
                    for exact, at, h, slots, known in _readings(tokens, core, key, value, maybe, k):
                        if wanted is not None:
                            if not len(wanted):
                                continue
                            place = np.searchsorted(wanted, h)
                            place[place == len(wanted)] = 0
                            found = wanted[place] == h
                            at, h, known, slots = at[found], h[found], known[found], None if exact else slots[found]
                        if not len(at):
                            continue
                        offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * (0 if exact else k))
                        flat = pa.array([] if exact else slots.reshape(-1).view(np.int64), pa.int64())
                        row = tokens.row[at]
                        yield pa.record_batch(
                            [
                                pa.array(ids[first + row]), pa.array((at - tokens.first[row]).astype(np.int32)), pa.array(count[row].astype(np.int32)), pa.array(plain[row].astype(np.int32)),
                                pa.array(np.full(len(at), k, np.int32)), pa.array(np.full(len(at), exact)), pa.array(known < min(LEAST_WORDS, k) if not exact else np.zeros(len(at), bool)),
                                pa.array(h.view(np.int64)), pa.ListArray.from_arrays(offsets, flat),
                            ],
                            schema=_HITS_ARROW,
                        )

    return windows


def _tokens_of(items: DataFrame) -> DataFrame:
    def count(batches):
        for batch in released(batches):
            for first, end, body, rows in pieces(batch.column(1)):
                words, *_, token = templates(body, rows)
                yield pa.record_batch([batch.column(0).slice(first, end - first), pa.array(np.bincount(words.row[token], minlength=end - first).astype(np.int32))], names=["item_id", "n"])

    return items.mapInArrow(count, "item_id long, n int")


def find_leaks(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """(doc_id, item_id, covered, n_tokens) of every document and item whose shared windows cover ``cover`` of the item.

    A verbatim run of ``RUN`` tokens is a leak whatever it covers. Items with fewer than ``WINDOW`` tokens are looked for
    as one window of their own length: verbatim, and by template if they have at least three tokens and ``WHOLE_WORDS`` plain
    words (all, if they have fewer). Even an item of a single token matches wherever it stands. Null and empty texts, and texts
    without a letter or digit, match nothing; rows with a null id take no part; repeated rows of an id count as one. Other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    as_rows = lambda df, c: df.select(F.col(c).cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null")
    items, source = as_rows(benchmark, "item_id"), as_rows(docs, "doc_id")
    sizes = {r["n"] for r in _tokens_of(items).select(F.least("n", F.lit(RUN)).alias("n")).where("n >= 1").distinct().collect()}
    lengths = tuple(sorted({min(n, WINDOW) for n in sizes} | ({RUN} & sizes))) or (WINDOW,)
    keys = items.mapInArrow(_windows(lengths, None), _HITS).where((F.col("k") == F.least("n_tokens", F.lit(WINDOW))) | (F.col("k") == RUN))
    keys = as_table(keys.select(F.col("doc_id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("n_tokens").alias("item_tokens"), F.col("n_plain").alias("item_plain"), "thin", "key", F.col("slots").alias("item_slots")).distinct(), "windows")
    wanted = None
    if keys.count() <= FILTER_KEYS:
        wanted = np.unique(np.array([r["key"] for r in keys.select("key").distinct().collect()], np.int64).view(np.uint64))
    hits = source.mapInArrow(_windows(lengths, wanted), _HITS).drop("thin", "n_plain").dropDuplicates(["doc_id", "pos", "key"])
    met = hits.join(keys, "key")
    pairs = F.zip_with("item_slots", "slots", lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    met = met.withColumn("pairs", F.array_distinct(F.filter(pairs, lambda p: p["x"].bitwiseAND(_NAMED) != 0)))
    distinct = lambda f: F.size(F.array_distinct(F.transform("pairs", lambda p: p[f])))
    met = met.where((distinct("x") == F.size("pairs")) & (distinct("y") == F.size("pairs")))
    # First by alignment, in which thin windows may make up nearly the whole item, then over all of them.
    at = F.struct(F.col("item_pos").alias("a"), "k")
    met = met.groupBy("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.max("item_tokens").alias("n_tokens"), F.max("item_plain").alias("n_plain"), F.max((F.col("exact") & (F.col("k") == RUN))).alias("run"),
        F.collect_set(F.when(~F.col("thin"), at)).alias("at"), F.collect_set(at).alias("every"),
    )
    covers = lambda windows: F.size(F.array_distinct(F.flatten(F.transform(windows, lambda p: F.sequence(p["a"], p["a"] + p["k"] - 1)))))
    whole = (F.col("n_plain") >= WHOLE_WORDS) & (covers(F.col("every")) >= F.col("n_tokens") * WHOLE)
    met = met.groupBy("doc_id", "item_id").agg(
        F.max("n_tokens").alias("n_tokens"), F.max("run").alias("run"), F.max(F.when(whole, covers(F.col("every"))).otherwise(0)).alias("whole"), F.flatten(F.collect_list("at")).alias("at")
    )
    met = met.withColumn("covered", F.greatest(covers(F.col("at")), "whole"))
    return met.where(F.col("run") | (F.col("whole") > 0) | (F.col("covered") >= F.col("n_tokens") * cover)).select("doc_id", "item_id", "covered", "n_tokens")


def decontaminate(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, n_items, and the item_ids in order, comma-joined (see find_leaks)."""
    leaks = find_leaks(docs, benchmark, cover).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_set("item_id")).cast("array<string>"), ",").alias("items"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(leaks, "doc_id", "left")
    n: Column = F.coalesce("n_items", F.lit(0))
    return out.select("doc_id", (n > 0).alias("contaminated"), n.cast("long").alias("n_items"), F.coalesce("items", F.lit("")).alias("items"))
