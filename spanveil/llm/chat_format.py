"""Roles of transcript segments by a hidden Markov model, and canonical rendering.

A transcript is the texts of a conversation in order. A text is cut before every line that opens with a speaker marker;
the pieces are segments. The hidden states are the roles; a segment shows its marker, its length, its number of lines
and how it ends. Transition and emission probabilities are counted over all labelled rows outside the held-out fold.
Viterbi recovers the roles.

A conversation may be longer than a task should read, so it is cut into chunks of turns, and turns of very many rows
(such as null ones) into parts by the hash of their texts and by row. For each chunk the best score
from every state before it to every state at its end is one small max-plus matrix; the matrices of a conversation are
combined in order, which fixes the state at each chunk's border, and then every chunk is traced back by itself. The
result is the one that Viterbi over the whole conversation gives.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import as_table

ROLES = ("system", "user", "assistant")
#: Turns of a chunk, and segments that a task works on together.
CHUNK_TURNS, GROUP_ROWS = 1024, 20_000
#: Rows of a chunk beyond which every turn of it is a chunk of its own, cut into parts of about ``CHUNK_TURNS`` rows.
CROWDED = 4 * CHUNK_TURNS
#: What a chunk is known by within its conversation, in order.
_CHUNK = ["chunk", "own", "part", "run"]

# What a line that opens a segment begins with, by role.
_SPEAKERS = {
    "system": "system|instructions?|context",
    "user": "user|human|question|q|prompt|customer|me|you",
    "assistant": "assistant|ai|bot|chatbot|answer|a|response|agent|model|gpt",
}
_OPEN = r"^[ \t]*(?:<\|(?:im_start\|>)?|###[ \t]*|\[|\*\*)?"
_CLOSE = r"(?:\|>|\][ \t]*:?|\*\*[ \t]*:?|[ \t]*:\*\*|[ \t]*[:>]|[ \t]*$)[ \t]*"
_MARKERS = {r: rf"(?im){_OPEN}(?:{s}){_CLOSE}" for r, s in _SPEAKERS.items()}
_ANY = rf"(?im){_OPEN}(?:{'|'.join(_SPEAKERS.values())})(?:\|>|\][ \t]*:?|\*\*[ \t]*:?|[ \t]*:\*\*|[ \t]*[:>])[ \t]*"
_CUT = r"(?im)(?=" + _ANY.removeprefix("(?im)") + ")"

#: Start probabilities, transitions and marker emissions where no labelled row is there (rows: before; columns: after).
_DEFAULT_START = (0.4, 0.55, 0.05)
_DEFAULT_MOVE = ((0.05, 0.9, 0.05), (0.02, 0.08, 0.9), (0.02, 0.9, 0.08))


def segments(chats: DataFrame) -> DataFrame:
    """conv_id, turn, tie (hash of the row's text), row (a number of its own), seg, text and the features of every segment."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.col("role").cast("string") if "role" in chats.columns else F.lit(None).cast("string")
    rows = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), role.alias("role"), text.alias("whole"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("conv_id", "turn", "role", "row", F.xxhash64("whole").alias("tie"), F.posexplode(F.split("whole", _CUT, -1)).alias("seg", "text"))
    rows = rows.where("conv_id is not null and (seg = 0 or text <> '')")
    mark = F.lit("none")
    head = F.substring_index("text", "\n", 1)
    for r, rx in _MARKERS.items():
        mark = F.when(head.rlike(rx), r).otherwise(mark)
    trimmed = F.rtrim("text")
    tail = F.when(trimmed.endswith("?"), "question").when(trimmed.rlike(r"[.!]$"), "stop").otherwise("other")
    size = F.least(F.floor(F.log2(F.length("text") + 1) * 2), F.lit(40)).cast("string")
    lines = F.least(F.size(F.split("text", "\n")), F.lit(8)).cast("string")
    return rows.select("conv_id", "turn", "tie", "row", "seg", "text", "role", mark.alias("mark"), size.alias("size"), lines.alias("lines"), tail.alias("tail"))


_FEATURES = ("mark", "size", "lines", "tail")


def held_out(c: str = "conv_id") -> Column:
    return F.crc32(F.col(c).cast("string").cast("binary")) % 4 == 2


def fit(segs: DataFrame) -> dict:
    """Log probabilities counted over the labelled segments outside the held-out fold, smoothed by one."""
    known = segs.where(F.col("role").isin(*ROLES)).where(~held_out())
    feature = F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in _FEATURES]), F.array(*_FEATURES))).alias("f", "v")
    emitted = known.select("role", feature).groupBy("role", "f", "v").count().collect()
    place = F.struct("tie", "row", "seg")
    spots = known.groupBy("conv_id", "turn").agg(F.min_by("role", place).alias("first"), F.max_by("role", place).alias("last"))
    after = spots.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("first").alias("next"))
    moved = spots.join(after, ["conv_id", "turn"]).groupBy("last", "next").count().collect()
    begun = spots.groupBy("conv_id").agg(F.min_by("first", "turn").alias("first")).groupBy("first").count().collect()
    n = len(ROLES)
    start, move = np.array(_DEFAULT_START), np.array(_DEFAULT_MOVE)
    for r in begun:
        start[ROLES.index(r["first"])] += r["count"]
    for r in moved:
        move[ROLES.index(r["last"]), ROLES.index(r["next"])] += r["count"]
    tables = {}
    for f in _FEATURES:
        values = sorted({r["v"] for r in emitted if r["f"] == f} | set(ROLES if f == "mark" else ()) | {"?"})
        counts = np.ones((n, len(values)))
        for i, role in enumerate(ROLES):
            for j, v in enumerate(values):
                counts[i, j] += (4 if f == "mark" and v == role else 0) + sum(r["count"] for r in emitted if r["f"] == f and r["v"] == v and r["role"] == role)
        if f == "mark":  # a role's own marker stays its own, whatever unmarked rows outnumber it
            for i, role in enumerate(ROLES):
                column = values.index(role)
                counts[:, column] = np.minimum(counts[:, column], 1)
                counts[i, column] = max(counts[i, column], 50)
        tables[f] = (values, np.log(counts / counts.sum(1, keepdims=True)))
    # Size and number of lines say nearly the same: together they weigh as one feature.
    step = np.full((n + 1, n + 1), -np.inf)
    step[:n, :n], step[n, :n] = np.log(move / move.sum(1, keepdims=True)), np.log(start / start.sum())
    return {"step": step, "tables": tables}


_WEIGHT = {"mark": 1.0, "size": 1.0, "lines": 0.5, "tail": 0.5}


def _emissions(pdf: pd.DataFrame, model: dict) -> np.ndarray:
    out = np.zeros((len(pdf), len(ROLES) + 1))
    out[:, -1] = -np.inf
    for f, (values, logs) in model["tables"].items():
        place = {v: i for i, v in enumerate(values)}
        at = pdf[f].map(place).fillna(place["?"]).astype(int).to_numpy()
        out[:, :-1] += _WEIGHT[f] * logs[:, at].T
    return out


def _sorted(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Rows by chunk and order, with the starts and lengths of the chunks."""
    pdf = pdf.sort_values(["conv_id", *_CHUNK, "turn", "tie", "row", "seg"], kind="stable").reset_index(drop=True)
    key = pdf[["conv_id", *_CHUNK]].to_numpy()
    new = np.r_[True, (key[1:] != key[:-1]).any(1)]
    start = np.flatnonzero(new)
    return pdf, start, np.diff(np.r_[start, len(pdf)])


def _matrices(model: dict):
    def matrices(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, start, size = _sorted(pdf)
        e, step = _emissions(pdf, model), model["step"]
        s = len(step)
        best = np.full((len(start), s, s), -np.inf)
        best[:, range(s), range(s)] = 0
        for t in range(int(size.max())):
            live = np.flatnonzero(size > t)
            best[live] = (best[live][:, :, :, None] + step[None, None]).max(2) + e[start[live] + t][:, None, :]
        return pdf[["conv_id", *_CHUNK]].iloc[start].assign(m=list(best.reshape(len(start), -1)))

    return matrices


def _borders(states: int):
    def borders(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["conv_id", *_CHUNK]).reset_index(drop=True)
        m = np.stack(pdf["m"].to_numpy()).reshape(-1, states, states)
        conv = pdf["conv_id"].to_numpy()
        enter, last, before = np.full((len(m), states), -np.inf), np.zeros(len(m), int), np.zeros(len(m), int)
        a = 0
        while a < len(m):
            b = a
            v = np.full(states, -np.inf)
            v[-1] = 0
            while b < len(m) and conv[b] == conv[a]:
                enter[b] = v
                v = (v[:, None] + m[b]).max(0)
                b += 1
            state = int(v.argmax())
            for i in range(b - 1, a - 1, -1):
                last[i] = state
                state = int((enter[i] + m[i][:, state]).argmax())
                before[i] = state
            a = b
        return pdf[["conv_id", *_CHUNK]].assign(enter=list(enter), last=last, before=before)

    return borders


def _traced(model: dict):
    def traced(pdf: pd.DataFrame, border: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"conv_id": [], "turn": [], "seg": [], "role_pred": [], "opens": [], "text": []})
        pdf, start, size = _sorted(pdf)
        border = border.sort_values(["conv_id", *_CHUNK])
        e, step = _emissions(pdf, model), model["step"]
        v = np.stack(border["enter"].to_numpy())
        back = np.zeros((len(pdf), len(step)), int)
        for t in range(int(size.max())):
            live = np.flatnonzero(size > t)
            w = v[live][:, :, None] + step[None]
            back[start[live] + t] = w.argmax(1)
            v[live] = w.max(1) + e[start[live] + t]
        state, role = border["last"].to_numpy().copy(), np.zeros(len(pdf), int)
        before = np.zeros(len(pdf), int)
        for t in range(int(size.max()) - 1, -1, -1):
            live = np.flatnonzero(size > t)
            at = start[live] + t
            role[at] = state[live]
            state[live] = back[at, state[live]]
            before[at] = state[live]
        names = np.array(ROLES, object)
        return pd.DataFrame({"conv_id": pdf["conv_id"], "turn": pdf["turn"], "seg": pdf["seg"], "role_pred": names[role], "opens": role != before, "text": pdf["text"]})

    return traced


def _chunked(segs: DataFrame) -> DataFrame:
    """``segs`` with the columns of ``_CHUNK``."""
    segs = segs.withColumn("chunk", F.floor(F.col("turn") / CHUNK_TURNS).cast("long"))
    spots = segs.groupBy("conv_id", "chunk", "turn").count()
    crowded = spots.groupBy("conv_id", "chunk").agg(F.sum("count").alias("rows")).where(F.col("rows") > CROWDED).select("conv_id", "chunk")
    parts = spots.join(crowded, ["conv_id", "chunk"]).select("conv_id", "turn", F.ceil(F.col("count") / CHUNK_TURNS).cast("long").alias("parts"))
    parts = as_table(parts, "crowded")
    if parts.isEmpty():
        return segs.withColumns({c: F.lit(0).cast("long") for c in _CHUNK[1:]})
    same = segs.join(parts, ["conv_id", "turn"], "left_semi").groupBy("conv_id", "turn", "tie").count().where(F.col("count") > CHUNK_TURNS)
    runs = same.select("conv_id", "turn", "tie", F.ceil(F.col("count") / CHUNK_TURNS).cast("long").alias("runs"))  # rows of equal texts
    segs = segs.join(parts, ["conv_id", "turn"], "left").join(as_table(runs, "runs"), ["conv_id", "turn", "tie"], "left")
    place = F.shiftrightunsigned("tie", 33)  # 31 bits, made to ascend with the signed hash
    place = F.when(F.col("tie") < 0, place - (1 << 30)).otherwise(place + (1 << 30))
    alone = F.col("parts").isNotNull()
    split = {
        "own": F.when(alone, F.col("turn")),
        "part": F.when(alone, F.shiftright(place * F.col("parts"), 31)),
        "run": F.pmod(F.xxhash64("row"), F.col("runs")),
    }
    return segs.withColumns({c: F.coalesce(v.cast("long"), F.lit(0)) for c, v in split.items()}).drop("parts", "runs")


def format_chats(chats: DataFrame, model: dict | None = None) -> DataFrame:
    """Recover the role of every segment of every conversation and render it.

    ``chats`` has conv_id, turn (order), text and, for fitting, role, which no prediction sees. Returns one row per
    segment: conv_id, turn, seg, role_pred, opens (whether a new turn begins; else the segment goes on with the turn
    before) and rendered (``<|role|>``, the text without its marker, ``<|end|>``, on lines). Rows of one turn are taken in
    the order of a hash of their text (of a turn with very many rows: of a part of it), repeated rows one after the other.
    A null turn counts as -1, a null text as empty; rows with a null conv_id are left out. Other columns are ignored; an
    empty table gives no rows. Without labelled rows the markers and the usual alternation decide.
    """
    segs = as_table(segments(chats), "segments")
    model = model or fit(segs)
    segs = _chunked(segs.drop("role"))
    groups = math.ceil((segs.count() + 1) / GROUP_ROWS)
    group = lambda *c: F.pmod(F.xxhash64(*c), F.lit(groups)).cast("int").alias("group")
    by_chunk = segs.select(group("conv_id", *_CHUNK), "*").groupBy("group")
    chunk = "conv_id long, " + ", ".join(f"{c} long" for c in _CHUNK)
    matrices = by_chunk.applyInPandas(_matrices(model), f"{chunk}, m array<double>")
    borders = matrices.groupBy(group("conv_id")).applyInPandas(_borders(len(ROLES) + 1), f"{chunk}, enter array<double>, last int, before int")
    borders = as_table(borders.select(group("conv_id", *_CHUNK), "*"), "borders")
    out = by_chunk.cogroup(borders.groupBy("group")).applyInPandas(_traced(model), "conv_id long, turn long, seg int, role_pred string, opens boolean, text string")
    bare = F.regexp_replace("text", r"\A" + _ANY.removeprefix("(?im)^").join(["(?i)", ""]), "")
    return out.select("conv_id", "turn", "seg", "role_pred", "opens", F.concat(F.lit("<|"), "role_pred", F.lit("|>\n"), F.regexp_replace(bare, r"^\s+|\s+$", ""), F.lit("\n<|end|>\n")).alias("rendered"))
