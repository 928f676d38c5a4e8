"""Repair of conversation structure: cheapest edits by a Viterbi search that runs on all parts of a conversation at once.

The rows of a conversation, in order, are edited (keep, change of role, delete, insert) until their role initials read
``(s?(ua)+)?``. The costs to go form a vector over four states: nothing yet, after s, after u, after a. Only differences
within a vector decide, so vectors are kept without their common constant, and there are few of them.

Rows are sorted over the cluster and cut into chunks. All chunks of long conversations run backwards at the same time,
each from a speculative vector at its end. Fix-up passes run the chunks again from every vector that a chunk of the same
conversation has come to, until no new vector appears; within a run, the search stops where its vector differs from an
earlier run's by a constant only (rank convergence). As there are few vectors, a conversation of any length is settled after a
few passes. A walk over the chunks' entries (not their rows) then picks the run that is true for each, and the states in
which edits enter it; then every chunk traces its least audit from the stitched vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import as_table, digest_in_order, small_batches

#: A chunk holds at most so many rows, or so many bytes of text and one row.
CHUNK_ROWS, CHUNK_BYTES = 4096, 1 << 20

# States: nothing yet, after s, after u, after a.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The state that an inserted or changed row leads to, and the role that it has there.
_FORCED = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
#: Kept rows: class of the initial (other, s, u, a) by state.
_KEEP = ((None, _SYSTEM, _USER, None), (None, None, _USER, None), (None, None, None, _ASSISTANT), (None, None, _USER, None))
_DELETE, _INSERT, _CHANGE, _CUT = 4, 3, 3, 3
#: Costs to go behind the last row: an open pair has to be completed.
_END = (0, 6, 3, 0)
_MUST, _SHORT = 4, 8

_BACK: dict[tuple, tuple] = {}
_TRACE: dict[tuple, tuple] = {}


def _costs(vec: tuple, code: int) -> list[int]:
    """Costs to go before a row, from those behind it."""
    cut = _CUT if code & _SHORT else 0
    out = []
    for q in range(4):
        best = _DELETE + vec[q]
        if not code & _MUST:
            best = min(best, _CHANGE + cut + vec[_FORCED[q]])
            if (kept := _KEEP[q][code & 3]) is not None:
                best = min(best, cut + vec[kept])
        out.append(best)
    return [min(out[q], _INSERT + out[f := _FORCED[q]], 2 * _INSERT + out[_FORCED[f]]) for q in range(4)]


def back(vec: tuple, code: int) -> tuple:
    """The vector before a row, without its constant."""
    found = _BACK.get((vec, code))
    if found is None:
        costs = _costs(vec, code)
        found = _BACK[vec, code] = tuple(c - min(costs) for c in costs)
    return found


def trace(vec: tuple, state: int, code: int) -> tuple[str, int, int]:
    """(edits up to and with a row, their cost, state behind it): the ASCII-least of the cheapest; ``vec`` is behind the row."""
    found = _TRACE.get((vec, state, code))
    if found is None:
        costs, cut = _costs(vec, code), _CUT if code & _SHORT else 0
        audit, spent, q = "", 0, state
        while True:
            kept = None if code & _MUST else _KEEP[q][code & 3]
            if _DELETE + vec[q] == costs[q]:
                audit, spent = audit + "D", spent + _DELETE
            elif _INSERT + costs[_FORCED[q]] == costs[q]:
                audit, spent, q = audit + "I", spent + _INSERT, _FORCED[q]
                continue
            elif kept is not None and cut + vec[kept] == costs[q]:
                audit, spent, q = audit + "K", spent + cut, kept
            else:
                audit, spent, q = audit + "R", spent + cut + _CHANGE, _FORCED[q]
            break
        found = _TRACE[vec, state, code] = audit, spent, q
    return found


def vectors(codes: list[int], end: tuple) -> tuple[list[tuple], tuple]:
    """The vector behind each row, and the one before the first."""
    out, vec = [end] * len(codes), end
    for i in range(len(codes) - 1, -1, -1):
        out[i] = vec
        vec = back(vec, codes[i])
    return out, vec


def rerun(codes: list[int], end: tuple, before: tuple[list[tuple], tuple] | None) -> tuple[list[tuple], tuple]:
    """As ``vectors``, but stops where it meets the run ``before`` of the same rows."""
    if before is None:
        return vectors(codes, end)
    old, first = before
    out, vec = list(old), end
    for i in range(len(codes) - 1, -1, -1):
        if old[i] == vec:
            return out, first
        out[i] = vec
        vec = back(vec, codes[i])
    return out, vec


def exits(codes: list[int], behind: list[tuple]) -> list[int]:
    """The state behind the last row for each state before the first."""
    now = [0, 1, 2, 3]
    for code, vec in zip(codes, behind):
        now = [trace(vec, q, code)[2] for q in now]
    return now


def damage(conversations: DataFrame) -> DataFrame:
    """Conversation rows with planted faults, by the checksum of ``conv_id:turn``; a null counts as one space.

    Returns conv_id, turn, role, text and ``present``, which is false for rows that are dropped.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), name("role").alias("role"), name("text").alias("text"))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    rows = rows.withColumn("__k", kind)
    text = F.when(F.col("__k") == 1, "").when(F.col("__k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("__k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("__k") != 0).alias("present"), "__k")
    copies = F.when(F.col("__k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("__c", F.explode(copies)).drop("__k", "__c")


def _row_code(role: Column, text: Column) -> Column:
    """Class of the initial, blank and truncated as bits; blank rows have to go."""
    kind = F.left(role, F.lit(1))
    initial = F.when(kind == "s", 1).when(kind == "u", 2).when(kind == "a", 3).otherwise(0)
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    short = ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return (initial + F.when(blank, _MUST).when(short, _SHORT).otherwise(0)).cast("tinyint")


_KEY = "conv_id long, missing boolean"
_CHUNK = f"{_KEY}, pid int, no int, codes array<tinyint>, digests array<binary>, turns array<bigint>, roles array<string>, texts array<string>"
_CHUNK_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("missing", pa.bool_()), ("pid", pa.int32()), ("no", pa.int32()), ("codes", pa.list_(pa.int8())), ("digests", pa.list_(pa.binary()))]
    + [("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
)


def _cut(rows: int):
    """Chunks of the sorted rows of a partition; what a batch leaves open goes on with the next one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, no = None, 0
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if table.num_rows == 0:
                continue
            table = table.combine_chunks()
            ends = _ends(table, rows)
            if len(ends) > 1:
                yield _packed(table.slice(0, int(ends[-2])), ends[:-1], no)
                no += len(ends) - 1
            rest = table.slice(int(ends[-2]) if len(ends) > 1 else 0)
        if rest is not None:
            yield _packed(rest.combine_chunks(), np.array([rest.num_rows]), no)

    return cut


def _ends(table: pa.Table, rows: int) -> np.ndarray:
    """Where chunks end: behind a conversation, and where one has reached the limit of rows or bytes."""
    key, none = table["conv_id"].to_numpy(), table["missing"].to_numpy(zero_copy_only=False)
    size = np.cumsum(table["bytes"].to_numpy())
    stop = np.r_[np.flatnonzero((key[1:] != key[:-1]) | (none[1:] != none[:-1])) + 1, len(key)]
    ends, at = [], 0
    for end in stop:
        while at < end:
            full = int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK_BYTES, "right"))
            at = min(int(end), at + rows, max(at + 1, full))
            ends.append(at)
    return np.array(ends)


def _packed(table: pa.Table, ends: np.ndarray, no: int) -> pa.RecordBatch:
    first = np.r_[0, ends[:-1]]
    there = table["present"].to_numpy(zero_copy_only=False)
    at = pa.array(np.r_[0, np.cumsum(there)[ends - 1]].astype(np.int32))
    kept = table.filter(pa.array(there)).combine_chunks()
    own = table.take(pa.array(first))

    def lists(name: str) -> pa.Array:
        column = kept[name].combine_chunks() if kept.num_rows else pa.array([], _CHUNK_ARROW.field(name + "s").type.value_type)
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        return pa.ListArray.from_arrays(at, column.cast(_CHUNK_ARROW.field(name + "s").type.value_type))

    single = [own[c].combine_chunks() for c in ("conv_id", "missing", "pid")]
    single = [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in single]
    return pa.record_batch([*single, pa.array(np.arange(no, no + len(ends)), pa.int32()), *[lists(c) for c in ("code", "digest", "turn", "role", "text")]], schema=_CHUNK_ARROW)


def _codes(codes, digests, seen) -> tuple[list[int], int, int, int]:
    """Codes with repeats marked for deletion, and the numbers of blank, repeated and truncated rows."""
    known = set() if seen is None else set(seen)
    out, blank, again, short = [], 0, 0, 0
    for code, digest in zip(codes, digests):
        if code & _MUST:
            blank += 1
        elif digest in known:
            again, code = again + 1, code & 3 | _MUST
        elif code & _SHORT:
            short += 1
        known.add(digest)
        out.append(int(code))
    return out, blank, again, short


def _vec(text: str) -> tuple:
    return tuple(map(int, text.split(",")))


def _text(vec: tuple) -> str:
    return ",".join(map(str, vec))


def _run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each chunk and vector wanted: the vector before the chunk, and the exits."""
    for f in frames:
        out = []
        for row in f.itertuples():
            codes, before = _codes(row.codes, row.digests, row.seen)[0], None
            for end in row.wanted:
                before = rerun(codes, _vec(end), before)
                out.append((row.conv_id, row.missing, row.seq, end, _text(before[1]), exits(codes, before[0])))
        yield pd.DataFrame(out, columns=["conv_id", "missing", "seq", "vin", "vout", "exits"])


def _walk(runs: pd.DataFrame) -> pd.DataFrame:
    """For each chunk of a conversation the vector behind it that is true, and the state before it."""
    table: dict[int, dict] = {}
    for row in runs.itertuples():
        table.setdefault(row.seq, {})[row.vin] = (row.vout, row.exits)
    last = max(table)
    vec, chosen = _text(_END), {}
    for seq in range(last, 0, -1):
        chosen[seq] = vec
        vec = table[seq][vec][0]
    state, out = _START, []
    for seq in range(1, last + 1):
        out.append((seq, chosen[seq], state, seq == last))
        state = int(table[seq][chosen[seq]][1][state])
    out = pd.DataFrame(out, columns=["seq", "vin", "entry", "last"])
    out.insert(0, "missing", runs["missing"].iloc[0])
    out.insert(0, "conv_id", runs["conv_id"].iloc[0])
    return out


_PIECE = f"{_KEY}, seq int, blank long, duplicate long, truncated long, illegal long, n_turns long, first_turn long, last_turn long, first_initial int, last_initial int, cost long, audit string, repaired string"


def _trace_chunks(hashed: bool):
    """The edits of each chunk; ``repaired`` is the text behind them, or its SHA-256 where ``hashed``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.itertuples():
                codes, blank, again, short = _codes(row.codes, row.digests, row.seen)
                behind, _ = vectors(codes, _vec(row.vin))
                audit, lines, cost, state = [], [], 0, int(row.entry)
                for code, vec, role, text in zip(codes, behind, row.roles, row.texts):
                    edits, spent, after = trace(vec, state, code)
                    for e in edits:
                        if e == "I":
                            state = _FORCED[state]
                            lines.append(_ROLE[state] + ":")
                        elif e != "D":
                            lines.append(f"{role if e == 'K' else _ROLE[after]}:{text}")
                    audit.append(edits)
                    cost, state = cost + spent, after
                while row.last and state in (_SYSTEM, _USER):
                    state = _FORCED[state]
                    audit.append("I")
                    lines.append(_ROLE[state] + ":")
                    cost += _INSERT
                initials = [c & 3 for c in codes]
                wrong = sum((a, b) not in ((1, 2), (2, 3), (3, 2)) for a, b in zip(initials, initials[1:]))
                turns = [t for t in row.turns if t is not None and t == t]
                ends = (int(turns[0]), int(turns[-1])) if turns else (None, None)
                own = (initials[0], initials[-1]) if initials else (None, None)
                text = "\n".join(lines)
                done = hashlib.sha256(text.encode()).hexdigest() if hashed else text if lines else None
                out.append((row.conv_id, row.missing, row.seq, blank, again, short, wrong, len(set(turns)), *ends, *own, cost, "".join(audit), done))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in _PIECE.split(", ")])
            yield frame.astype({c: "Int64" for c in ("first_turn", "last_turn", "first_initial", "last_initial")})

    return run


def repair(turns: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per conversation: its faults, the cheapest edits that give it a legal structure, and what they leave.

    ``turns`` has conv_id, turn, role and text, and may have ``present``: rows where it is false are not there, but
    their conversation is reported. Rows are taken by turn (nulls first), then role, then the MD5 of role and text, so
    rows with equal turns have one order, and equal rows lie side by side. A null conv_id is a conversation of its own;
    null roles and texts count as one space; other columns are ignored; an empty table gives an empty result. A row is
    ``blank``, else ``duplicate`` (role and text seen earlier in the conversation), else ``truncated`` (its last character that is
    no white space is none of ``.!?``). ``illegal`` counts neighbours whose role initials are not su, ua or au; ``gaps``
    the turns missing between the smallest and the greatest. ``audit`` holds the edits (D, I, K, R) in order,
    ``repaired_sha256`` the hash of the repaired ``role:text`` lines.
    """
    small_batches(turns.sparkSession)
    there = F.coalesce(F.col("present"), F.lit(True)) if "present" in turns.columns else F.lit(True)
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv_id"), F.col("conv_id").isNull().alias("missing"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), there.alias("present"),
    )
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    rows = rows.withColumns({"digest": digest, "code": _row_code(F.col("role"), F.col("text")), "bytes": F.octet_length("text").cast("long") + 32, "tie": F.monotonically_increasing_id()})
    order = ["conv_id", "missing", F.asc_nulls_first("turn"), "role", "digest", "tie"]
    # A range of equal keys can be cut anywhere: ``tie`` differs in each row.
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id())
    chunks = as_table(dealt.select("conv_id", "missing", "turn", "role", "text", "present", "digest", "code", "bytes", "pid").mapInArrow(_cut(chunk_rows), _CHUNK), "turn_chunks")

    key = ["conv_id", "missing"]
    conv = Window.partitionBy(*key)
    places = chunks.select(*key, "pid", "no").withColumns({"seq": F.row_number().over(conv.orderBy("pid", "no")), "n": F.count("*").over(conv)})
    long = as_table(places.where("n > 1").drop("n"), "turn_places")
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    end = _text(_END)
    none = F.lit(None).cast("array<binary>")
    plain = chunks.join(long, [*key, "pid", "no"], "left_anti").withColumns({"seq": F.lit(1), "seen": none, "vin": F.lit(end), "entry": F.lit(0), "last": F.lit(True)})
    whole = plain.mapInPandas(_trace_chunks(True), _PIECE).withColumnRenamed("repaired", "repaired_sha256")
    shape = lambda df: df.select(F.when(~F.col("missing"), F.col("conv_id")).alias("conv_id"), "gaps", *counts[:4], "cost", "audit", "repaired_sha256")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    missed = lambda a, b, n: F.coalesce((wide(b) - wide(a) + 1 - F.col(n)), F.lit(0)).try_cast("long")
    short = shape(whole.withColumn("gaps", missed("first_turn", "last_turn", "n_turns")))
    if long.isEmpty():
        return short

    parts = chunks.join(long, [*key, "pid", "no"])
    # Repeats of rows of earlier chunks: each chunk learns which of its digests a chunk before it has.
    own = parts.select(*key, "seq", F.explode(F.array_distinct("digests")).alias("digest"))
    first = own.groupBy(*key, "digest").agg(F.min("seq").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    seen = own.join(first, [*key, "digest"]).where("seq > first").groupBy(*key, "seq").agg(F.collect_list("digest").alias("seen"))
    judged = as_table(parts.select(*key, "seq", "codes", "digests", "pid", "no").join(seen, [*key, "seq"], "left"), "turn_codes")

    # Passes over chunks and vectors, until every vector of a conversation has been run in each of its chunks.
    ran = "conv_id long, missing boolean, seq int, vin string, vout string, exits array<int>"
    runs = as_table(judged.withColumn("wanted", F.array(F.lit(end))).mapInPandas(_run, ran), "turn_runs")
    while True:
        met = runs.select(*key, F.col("vout").alias("vin")).union(runs.select(*key, "vin")).distinct()
        open_ = judged.select(*key, "seq").join(met, key).join(runs.select(*key, "seq", "vin"), [*key, "seq", "vin"], "left_anti")
        open_ = as_table(open_.groupBy(*key, "seq").agg(F.collect_list("vin").alias("wanted")), "turn_wanted")
        if open_.isEmpty():
            break
        fresh = as_table(judged.join(open_, [*key, "seq"]).mapInPandas(_run, ran), "turn_runs")
        runs = runs.unionByName(fresh)
    # One entry a chunk and vector: a conversation's group is smaller than its rows by the size of a chunk.
    chosen = runs.groupBy(*key).applyInPandas(_walk, f"{_KEY}, seq int, vin string, entry int, last boolean")
    pieces = parts.join(judged.select(*key, "seq", "seen"), [*key, "seq"]).join(chosen, [*key, "seq"])
    pieces = as_table(pieces.mapInPandas(_trace_chunks(False), _PIECE), "turn_pieces")

    before = conv.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    past = lambda c: F.last(c, ignorenulls=True).over(before)
    joint = pieces.drop("repaired").withColumns({"__t": past("last_turn"), "__i": past("last_initial")})
    pair = F.struct(F.col("__i"), F.col("first_initial"))
    bad = F.col("__i").isNotNull() & F.col("first_initial").isNotNull() & ~pair.isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in ((1, 2), (2, 3), (3, 2))])
    joint = joint.withColumns({"illegal": F.col("illegal") + bad.cast("long"), "n_turns": F.col("n_turns") - F.coalesce((F.col("__t") == F.col("first_turn")).cast("long"), F.lit(0))})
    edits = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "audit"))), lambda x: x["audit"]), "")
    summed = joint.groupBy(*key).agg(*[F.sum(c).alias(c) for c in counts], F.sum("n_turns").alias("n_turns"), F.min("first_turn").alias("first_turn"), F.max("last_turn").alias("last_turn"), edits.alias("audit"))
    hashes = digest_in_order(pieces.where("repaired is not null"), key, ["seq"], "repaired", "\n")
    summed = summed.join(hashes, key, "left").withColumn("repaired_sha256", F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    return short.unionByName(shape(summed.withColumn("gaps", missed("first_turn", "last_turn", "n_turns"))))
