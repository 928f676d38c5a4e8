"""Removal of passages that another document holds already (level-wise doubling).

Windows repeated at one length alone are extended to twice that length. The first level is half the asked
length: of the ``width`` words of a window the half-length window with the least hash stands for it, and equal
windows have equal stand-ins, so a window can only repeat where its stand-in does. The second level hashes the
windows of ``width`` words (twice the half, less one word where ``width`` is odd) whose stand-in survived, and
decides: a longer repeat is a union of repeated windows of ``width`` words, so no candidate is left to extend.

Work is dealt by document into chunks, and by hash into buckets. A chunk sends each hash once, with its
smallest doc_id, however often it holds it, so a passage that a third of all documents share costs one entry a
chunk. Chunks, buckets and replies are shuffled by Spark; nothing goes through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, joined, pack, pieces

#: Bytes of text of a chunk, on average; there are as many buckets of hashes as chunks, so that both keep their size.
CHUNK_BYTES = 8_000_000

_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("doc", pa.binary()), ("key", pa.binary()), ("check", pa.binary()), ("many", pa.binary())])
_SENT = "bucket int, chunk int, doc binary, key binary, check binary, many binary"
_REPLY_ARROW = pa.schema([("chunk", pa.int32()), ("key", pa.binary()), ("check", pa.binary()), ("least", pa.binary())])
_REPLY = "chunk int, key binary, check binary, least binary"


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _stand_ins(h: np.ndarray, half: int, width: int) -> np.ndarray:
    """For each window of ``width`` words: the least hash among its half-length windows."""
    span = width - half + 1
    least = h.copy()
    for shift in range(1, span):
        least[:-shift] = np.minimum(least[:-shift], h[shift:])
    return least


class _Chunk:
    """The documents of a chunk, in doc_id order, as pieces."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks().sort_by("doc_id")
        self.ids = table.column("doc_id").to_numpy()
        self.parts = pieces(table.column("text"))

    def __iter__(self) -> Iterator[tuple[int, int, Words]]:
        for first, end, body, rows in self.parts:
            yield first, end, Words(body, rows)


def _send(keys: np.ndarray, checks: np.ndarray, many: np.ndarray, docs: np.ndarray, chunk: int, buckets: int) -> pa.Table:
    """Rows of one chunk: for each bucket its keys, each with a doc_id and whether more documents of the chunk hold it."""
    bucket = (keys % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((docs, bucket))
    keys, checks, many, docs, bucket = (x[order] for x in (keys, checks, many, docs, bucket))
    cut = np.flatnonzero(np.diff(bucket)) + 1
    rows = [(int(bucket[a]), chunk, pack(docs[a:b]), pack(keys[a:b]), pack(checks[a:b]), pack(many[a:b])) for a, b in zip(np.r_[0, cut], np.r_[cut, len(bucket)]) if b > a]
    return _table(_SENT_ARROW, rows)


def _first_of_each(keys: np.ndarray, checks: np.ndarray | None, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key (then check, then doc), the starts of runs of equal keys, and whether a run has several docs."""
    order = np.lexsort((docs, keys)) if checks is None else np.lexsort((docs, checks, keys))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if checks is not None:
        c = checks[order]
        new[1:] |= c[1:] != c[:-1]
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(k)]
    several = docs[order[start]] != docs[order[end - 1]] if len(start) else np.zeros(0, bool)
    return order, start, several


def _half_level(half: int, width: int, buckets: int):
    def send(key, table):
        all_keys, all_docs = [], []
        chunk = _Chunk(table)
        for first, _, words in chunk:
            least = _stand_ins(words.windows(words.hashes(), half), half, width)
            good = words.whole(width)
            k, row = least[good], words.row[good] + first
            keep = np.ones(len(k), bool)
            keep[1:] = (k[1:] != k[:-1]) | (row[1:] != row[:-1])
            all_keys.append(k[keep])
            all_docs.append(chunk.ids[row[keep]])
        if not all_keys:
            return _table(_SENT_ARROW, [])
        keys, docs = np.concatenate(all_keys), np.concatenate(all_docs)
        order, start, several = _first_of_each(keys, None, docs)
        one = order[start]
        return _send(keys[one], np.zeros(len(one), np.uint32), several.astype(np.uint8), docs[one], int(key[0].as_py()), buckets)

    return send


class _Bucket:
    """What all chunks have sent to one bucket."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        blobs = table.column("key").to_pylist()
        self.key = joined(blobs, np.uint64)
        self.doc = joined(table.column("doc").to_pylist(), np.int64)
        self.check = joined(table.column("check").to_pylist(), np.uint32)
        self.many = joined(table.column("many").to_pylist(), np.uint8).astype(bool)
        self.chunk = np.repeat(table.column("chunk").to_numpy(), [len(x) // 8 for x in blobs])


def _reply_repeats(key, table):
    """For one bucket of half-length windows: to each chunk, those of its keys that two documents hold."""
    b = _Bucket(table)
    order, start, several = _first_of_each(b.key, None, b.doc)
    if not len(order):
        return _table(_REPLY_ARROW, [])
    run = np.diff(np.r_[start, len(order)])
    several = several | np.logical_or.reduceat(b.many[order], start)
    at = order[np.repeat(several, run)]
    return _by_chunk(b.chunk[at], b.key[at], None, None)


def _reply_least(key, table):
    """For one bucket of full windows: to each chunk the smallest doc_id of those of its keys that a larger document of the chunk holds."""
    b = _Bucket(table)
    order, start, _ = _first_of_each(b.key, b.check, b.doc)
    if not len(order):
        return _table(_REPLY_ARROW, [])
    least = np.repeat(b.doc[order[start]], np.diff(np.r_[start, len(order)]))
    tell = (b.doc[order] > least) | b.many[order]
    at = order[tell]
    return _by_chunk(b.chunk[at], b.key[at], b.check[at], least[tell])


def _by_chunk(chunk: np.ndarray, keys: np.ndarray, checks: np.ndarray | None, least: np.ndarray | None) -> pa.Table:
    order = np.argsort(chunk, kind="stable")
    chunk, keys = chunk[order], keys[order]
    cut = np.flatnonzero(np.diff(chunk)) + 1
    part = lambda x, a, b: b"" if x is None else pack(x[order[a:b]])
    rows = [(int(chunk[a]), pack(keys[a:b]), part(checks, a, b), part(least, a, b)) for a, b in zip(np.r_[0, cut], np.r_[cut, len(chunk)]) if b > a]
    return _table(_REPLY_ARROW, rows)


def _place(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Membership in a sorted array, and the place there."""
    if not len(wanted):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.searchsorted(wanted, values)
    at[at == len(wanted)] = 0
    return wanted[at] == values, at


def _least_of(keys: np.ndarray, checks: np.ndarray, known: np.ndarray, known_checks: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each window (key and check) the doc_id that is known for it, else the largest number; known is sorted by key."""
    out = np.full(len(keys), np.iinfo(np.int64).max)
    there, at = _place(keys, known)
    live = np.flatnonzero(there)
    at = at[live]
    while len(live):  # entries of one key stand side by side: almost always there is one
        good = known_checks[at] == checks[live]
        out[live[good]] = least[at[good]]
        live, at = live[~good], at[~good] + 1
        more = at < len(known)
        live, at = live[more], at[more]
        more = known[at] == keys[live]
        live, at = live[more], at[more]
    return out


def _checks(words: Words, hashes: np.ndarray, width: int) -> np.ndarray:
    return (words.windows(hashes, width, 1) >> np.uint64(32)).astype(np.uint32)


def _full_level(half: int, width: int, buckets: int):
    def send(key, docs_table, replies):
        if not docs_table.num_rows or not replies.num_rows:
            return _table(_SENT_ARROW, [])
        repeats = np.unique(joined(replies.column("key").to_pylist(), np.uint64))
        keys, checks, docs = [], [], []
        chunk = _Chunk(docs_table)
        for first, _, words in chunk:
            h = words.hashes()
            least = _stand_ins(words.windows(h, half), half, width)
            at = np.flatnonzero(words.whole(width) & _place(least, repeats)[0])
            keys.append(words.windows(h, width)[at])
            checks.append(_checks(words, h, width)[at])
            docs.append(chunk.ids[words.row[at] + first])
        keys, checks, docs = (np.concatenate(x) for x in (keys, checks, docs))
        order, start, several = _first_of_each(keys, checks, docs)
        one = order[start]
        return _send(keys[one], checks[one], several.astype(np.uint8), docs[one], int(key[0].as_py()), buckets)

    return send


_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
_OUT_TEXT_ARROW = _OUT_ARROW.append(pa.field("text", pa.string()))


def _kept_text(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words of all rows, joined by one space within a row, and the offsets of the rows."""
    n = len(words.body)
    mark = np.zeros(n + 1, np.int8)
    mark[words.start[keep]] += 1
    mark[words.end[keep]] -= 1
    inside = np.cumsum(mark[:n], dtype=np.int8).astype(bool)
    numbers = np.flatnonzero(keep)
    more = np.zeros(len(numbers), bool)
    more[:-1] = words.row[numbers[1:]] == words.row[numbers[:-1]]
    gaps = words.end[numbers[more]]  # the white-space byte after a kept word with a kept word behind it in its row
    out = words.body.copy()
    out[gaps] = 32
    inside[gaps] = True
    at = np.zeros(n + 1, np.int64)
    np.cumsum(inside, out=at[1:])
    return out[inside], at[words.rows]


def _remove(width: int, with_text: bool):
    schema = _OUT_TEXT_ARROW if with_text else _OUT_ARROW

    def cut(key, docs_table, replies):
        if not docs_table.num_rows:
            return schema.empty_table()
        known = joined(replies.column("key").to_pylist(), np.uint64)
        known_checks = joined(replies.column("check").to_pylist(), np.uint32)
        least = joined(replies.column("least").to_pylist(), np.int64)
        order = np.argsort(known, kind="stable")
        known, known_checks, least = known[order], known_checks[order], least[order]
        out = []
        chunk = _Chunk(docs_table)
        for first, end, words in chunk:
            ids = chunk.ids[first:end]
            keep = np.ones(len(words.start), bool)
            if len(known) and len(keep):
                h = words.hashes()
                whole = np.flatnonzero(words.whole(width))
                lowest = _least_of(words.windows(h, width)[whole], _checks(words, h, width)[whole], known, known_checks, least)
                gone = whole[ids[words.row[whole]] > lowest]
                cover = np.zeros(len(keep) + 1, np.int64)
                cover[gone] += 1
                cover[gone + width] -= 1
                keep = np.cumsum(cover[:-1]) == 0
            text, offsets = _kept_text(words, keep)
            raw = text.tobytes()
            kept = np.bincount(words.row[keep], minlength=end - first)
            spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
            columns = [ids, words.count.astype(np.int64), (words.count - kept).astype(np.int64), [hashlib.sha256(raw[a:b]).hexdigest() for a, b in spans]]
            if with_text:
                columns.append([raw[a:b].decode() for a, b in spans])
            out.append(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))
        return pa.concat_tables(out)

    return cut


def remove_repeats(docs: DataFrame, width: int = 13, with_text: bool = False) -> DataFrame:
    """Remove every word covered by a window of ``width`` words that also starts in a document with a smaller doc_id.

    Returns one row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one
    space) and, with ``with_text``, these words as ``text``. Words are maximal runs outside space, tab and line
    breaks, as they are. A null or empty text has no words; so has a null doc_id row, which takes part under no
    id and is left out. Repeated rows of one doc_id count as one document. Other columns are ignored. Windows are
    judged on the input, not on what is left; a repeat inside one document only is none. An empty table gives none.
    Windows are told apart by 96 bits of hash.
    """
    half = (width + 1) // 2
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    parts = (dealt.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // CHUNK_BYTES + 1
    dealt = dealt.select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("chunk"), "doc_id", "text")
    chunks = dealt.groupBy("chunk")
    halves = chunks.applyInArrow(_half_level(half, width, parts), _SENT).groupBy("bucket").applyInArrow(_reply_repeats, _REPLY)
    fulls = chunks.cogroup(halves.groupBy("chunk")).applyInArrow(_full_level(half, width, parts), _SENT)
    replies = fulls.groupBy("bucket").applyInArrow(_reply_least, _REPLY)
    return chunks.cogroup(replies.groupBy("chunk")).applyInArrow(_remove(width, with_text), _OUT + (", text string" if with_text else ""))
