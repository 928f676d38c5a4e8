"""Packing of tokenised documents into sequences of a fixed length (bounded-space online best fit).

Tokens are counted and hashed on the executors. A text is cut before every single space or line break that stands
between two other characters: no token of the byte-level vocabulary reaches over such a place, so the tokens of the
parts are the tokens of the text. Each distinct part of a piece of rows is encoded once, and a bounded table of
encoded parts lives on in the worker.

Rests of documents are dealt by hash into packing groups of about ``GROUP`` rests, in which they arrive in the order of the
hash. The packer reads ``AHEAD`` of them at a time and places these longest first, each into the open sequence with the
least free space that still holds it; open sequences are found in a bit set keyed by free space. At most ``OPEN`` sequences
are open, whatever the size of the group: when one more is needed, the fullest closes. Full pieces are sequences of their
own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_table, small_batches
from .words import pieces, released, span_hashes

#: Sequences that a packing group keeps open, and rests that it reads ahead.
OPEN, AHEAD = 1024, 2048
#: Rests of a packing group, on average: one task's work, however many documents there are.
GROUP = 8_000
#: Encoded parts that a worker keeps (16 bytes each and 2 to 4 a token).
KEPT_PARTS = 500_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


class _Encoder:
    """Token ids of text parts by their hashes, kept in sorted segments of doubling sizes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # keys, start offsets, ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        run = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        out = []
        for i in range(0, len(texts), 4096):
            out += [e.ids for e in run(texts[i : i + 4096], add_special_tokens=False)]
        return out

    def look_up(self, keys: np.ndarray, text_of) -> tuple[np.ndarray, np.ndarray]:
        """(start offsets, ids) of sorted distinct keys; ``text_of(i)`` gives the text of key i."""
        size, sources, left = np.zeros(len(keys), np.int64), [], np.arange(len(keys))
        for known, starts, ids in self.kept:
            at = np.searchsorted(known, keys[left])
            at[at == len(known)] = 0
            have = known[at] == keys[left]
            mine, at = left[have], at[have]
            size[mine] = starts[at + 1] - starts[at]
            sources.append((mine, ids, starts[at]))
            left = left[~have]
        coded = self.encode([text_of(i) for i in left])
        size[left] = [len(x) for x in coded]
        fresh = np.fromiter((t for x in coded for t in x), self.kind, int(size[left].sum()))
        begin = np.r_[0, np.cumsum(size[left])]
        sources.append((left, fresh, begin[:-1]))
        starts = np.r_[0, np.cumsum(size)]
        out = np.zeros(starts[-1], self.kind)
        for mine, ids, first in sources:
            out[_runs(starts[:-1][mine], size[mine])] = ids[_runs(first, size[mine])]
        self.keep(keys[left], begin, fresh)
        return starts, out

    def keep(self, keys: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> None:
        """Add a sorted segment; smaller ones before it are merged into it."""
        if not len(keys) or len(keys) + sum(len(k) for k, *_ in self.kept) > KEPT_PARTS:
            return
        while self.kept and len(self.kept[-1][0]) <= 2 * len(keys):
            other, first, more = self.kept.pop()
            size, begin = np.r_[np.diff(first), np.diff(starts)], np.r_[first[:-1], len(more) + starts[:-1]]
            order = np.argsort(np.r_[other, keys], kind="stable")
            keys, ids = np.r_[other, keys][order], np.r_[more, ids][_runs(begin[order], size[order])]
            starts = np.r_[0, np.cumsum(size[order])]
        self.kept.append((keys, starts, ids))


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[0], start[0] + 1, ... of size[0], then those of the next run, and so on."""
    total = int(size.sum())
    shift = start - np.r_[0, np.cumsum(size)[:-1]] if len(size) else start
    return np.arange(total) + np.repeat(shift, size)


_ENCODERS: dict[str, _Encoder] = {}


def _encoder(path: str) -> _Encoder:
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def token_ids(encoder: _Encoder, body: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows of a piece, and the offsets of the rows."""
    n = len(body)
    space = _SPACE[body]
    # NEL, no-break and other wide spaces begin with these bytes: a part never ends beside one.
    wide = (body == 0xC2) | (body >= 0xE1) & (body <= 0xE3)
    calm = ~space & ~wide
    cut = np.zeros(n + 1, bool)
    if n > 2:
        single = (body[1:-1] == 32) | (body[1:-1] == 10)
        tail = body[:-2]
        # The byte before must end a character that is no space: ASCII, or the tail of a two-byte letter (C3 to DF).
        before = (tail < 0x80) & ~space[:-2]
        two = np.zeros(n - 2, bool)
        two[1:] = (tail[1:] >= 0x80) & (tail[1:] < 0xC0) & (body[:-3] >= 0xC3) & (body[:-3] <= 0xDF)
        cut[1 : n - 1] = single & (before | two) & calm[2:]
    cut[rows] = True
    start = np.flatnonzero(cut[:n])
    end = np.r_[start[1:], n] if len(start) else start
    keys = span_hashes(body, start, end)
    uniq, one, back = np.unique(keys, return_index=True, return_inverse=True)
    raw = body.tobytes()
    starts, ids = encoder.look_up(uniq, lambda i: raw[start[one[i]] : end[one[i]]].decode())
    size = np.diff(starts)[back]
    out = ids[_runs(starts[:-1][back], size)]
    at = np.r_[0, np.cumsum(size)]
    return out, at[np.searchsorted(start, rows)]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _cut_up(path: str, room: int, end_id: int, with_ids: bool):
    schema = _PIECES_ARROW.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else _PIECES_ARROW

    def cut_up(batches):
        encoder = _encoder(path)
        for batch in released(batches):
            doc_ids = batch.column(0).to_pylist()
            for first, end, body, rows in pieces(batch.column(1)):
                ids, at = token_ids(encoder, body, rows)
                out = []
                for i, doc in enumerate(doc_ids[first:end]):
                    own = np.append(ids[at[i] : at[i + 1]].astype("<u4"), np.uint32(end_id))
                    a, piece = 0, 0
                    b = len(own) % room or room  # the first piece may be shorter
                    while a < len(own):
                        part = own[a:b]
                        out.append((doc, piece, a, b - a, zlib.crc32(part.tobytes()), *([part.tolist()] if with_ids else [])))
                        a, b, piece = b, b + room, piece + 1
                columns = zip(*out)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return cut_up


def best_fit(lengths: list[int], room: int, open_: int = OPEN) -> tuple[list[int], list[int]]:
    """Sequence number and offset of each length, in order, by bounded-space best fit."""
    by_free: dict[int, list[int]] = {}  # free space: open sequences
    bits = opened = made = 0
    sequence, offset = [], []
    for n in lengths:
        fits = bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            stack = by_free[free]
            s = stack.pop()
            if not stack:
                bits ^= 1 << free
            opened -= 1
        else:
            if opened >= open_:
                least = (bits & -bits).bit_length() - 1  # the fullest closes
                by_free[least].pop()
                if not by_free[least]:
                    bits ^= 1 << least
                opened -= 1
            s, free = made, room
            made += 1
        sequence.append(s)
        offset.append(room - free)
        left = free - n
        if left:
            by_free.setdefault(left, []).append(s)
            bits |= 1 << left
            opened += 1
    return sequence, offset


def _pack_group(room: int):
    def pack_group(table):
        table = table.sort_by([("o", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        arrival = np.arange(table.num_rows)
        table = table.take(pa.array(np.lexsort((arrival, -table.column("length").to_numpy(), arrival // AHEAD))))
        group = table.column("group")[0].as_py() if table.num_rows else 0
        sequence, offset = best_fit(table.column("length").to_pylist(), room)
        numbers = pa.array(np.array(sequence, np.int64) + (int(group) + 1 << 32))
        return table.drop_columns(["group", "o"]).append_column("sequence_id", numbers).append_column("offset", pa.array(offset, pa.int64()))

    return pack_group


def pack_documents(docs: DataFrame, vocabulary: str, room: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pack every document into sequences of at most ``room`` tokens.

    A document is the ids of its text (null: none) and ``end_id``. Longer ones are cut into pieces of ``room`` tokens,
    of which the first may be shorter. Returns one row per piece: doc_id, piece, start, length, ids_crc32 (of the
    little-endian 32-bit ids), sequence_id and offset (gapless from 0 in a sequence); with ``with_ids`` also the ids.
    ``vocabulary`` is a tokenizers file that executors can read. Repeated rows, and rows with a null doc_id, are
    packed like others. Other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shape = _PIECES + (", ids array<int>" if with_ids else "")
    cut = as_table(source.mapInArrow(_cut_up(vocabulary, room, end_id, with_ids), shape), "pieces")
    hashed = F.xxhash64("doc_id", "piece", "ids_crc32")
    full = cut.where(F.col("length") == room)
    full = full.withColumn("sequence_id", (F.monotonically_increasing_id() * -1) - 1).withColumn("offset", F.lit(0).cast("long"))
    rest = cut.where(F.col("length") < room)
    groups = rest.count() // GROUP + 1
    rest = rest.withColumn("group", F.pmod(hashed, F.lit(groups)).cast("int")).withColumn("o", hashed)
    packed = rest.groupBy("group").applyInArrow(_pack_group(room), shape + ", sequence_id long, offset long")
    return full.unionByName(packed)
