"""Structured Streaming forms (ST1 to ST5)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import label_of, value_key
from ..operators.session import LABEL
from ..plans.anonymize import anonymize, anonymize_safe


def anonymize_stream(docs: DataFrame, path: str, checkpoint: str, available_now: bool = False, **options) -> StreamingQuery:
    """ST1: documents are masked as they arrive; detection, fusion and masking are row-local, so the query is stateless."""
    out = anonymize(docs, **options).drop("text")
    writer = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def anonymize_stream_safe(docs: DataFrame, good: Callable[[DataFrame, int], None], bad: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False, **options) -> StreamingQuery:
    """ST5: every batch is split into results and failures, each handed to its own sink.

    A batch comes again where the stream failed before its end: sinks have to take it as the same rows (``batch_sink``).
    """

    def each(batch: DataFrame, number: int) -> None:
        ok, failed = anonymize_safe(batch, **options)
        good(ok, number)
        bad(failed, number)

    writer = docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """ST5: a sink for ``anonymize_stream_safe`` whose rows are keyed by the batch: ``path`` has one folder a batch.

    A batch that comes again, because the stream failed behind this sink, replaces what it wrote before, so each row is
    there once. Use one path for one stream and checkpoint. ``batch_rows`` reads what finished batches have left.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def batch_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a batch sink, with the number of their batch."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


def use_keyed_state(spark: SparkSession) -> None:
    """Set the session's state store to the one that keyed state needs (RocksDB)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


_OUT = "session_id string, label string, norm_value string, n int, first_value string"


class _Numbers(StatefulProcessor):
    """The numbers of a session: one state entry a value, one a label; a row reads and writes its own entries only."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "label string, norm_value string", "n int")
        self.counts = handle.getMapState("counts", "label string", "n int")
        self.seen = handle.getValueState("seen", "at long")

    def _forget(self) -> None:
        for state in (self.known, self.counts, self.seen):
            state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.ttl_ms:
            now = timerValues.getCurrentProcessingTimeInMs()
            # A session that is overdue has ended, whether its timer has fired or not.
            if self.seen.exists() and self.seen.get()[0] + self.ttl_ms <= now:
                self._forget()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now + self.ttl_ms)
            self.seen.update((now,))
        new = []
        for row in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            value = (row.label, row.norm_value)
            if not self.known.containsKey(value):
                n = (self.counts.getValue((row.label,))[0] if self.counts.containsKey((row.label,)) else 0) + 1
                self.counts.updateValue((row.label,), (n,))
                self.known.updateValue(value, (n,))
                new.append((key[0], row.label, row.norm_value, n, row.first_value))
        yield pd.DataFrame(new, columns=["session_id", "label", "norm_value", "n", "first_value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._forget()
        yield pd.DataFrame([], columns=["session_id", "label", "norm_value", "n", "first_value"])

    def close(self) -> None:
        pass


def stream_pseudonyms(entities: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """ST2, ST4: numbers for (session_id, seq, type, text) as they arrive; a value's first spelling and number stay.

    Numbers follow arrival; the batch form (operators.session.session_pseudonyms) numbers by document order and
    reconciles them. Values and counters are keyed state (``use_keyed_state``), so a batch touches what it brings, however
    much a session has. With ``ttl_ms`` a session's numbers go when nothing has arrived for so long; such a stream looks
    at its timers without new rows too, so it has to run by a processing-time trigger (with ``availableNow`` it never ends).
    """
    keyed = entities.select("session_id", "seq", F.col("text").alias("first_value"), label_of(F.col("type")).alias("label"), value_key(F.col("text")).alias("norm_value"))
    return keyed.groupBy("session_id").transformWithStateInPandas(_Numbers(ttl_ms), _OUT, "Append", "ProcessingTime" if ttl_ms else "None")


#: Characters of the longest placeholder that is waited for.
LONGEST = 64
_WHOLE = r"\[\p{Lu}+(?:_\p{Lu}+)*_\d+\]"
_BEGUN = r"\[(?:\p{Lu}+(?:_\p{Lu}+)*(?:_\d*)?)?\Z"


def pieces_of(text: str, last: bool) -> tuple[list[tuple[str, str]], str]:
    """(kind, text) of what is certain in a text that may go on, and the rest, which may be the begin of a placeholder."""
    import regex

    out, at = [], 0
    for m in regex.finditer(_WHOLE, text):
        out += [("text", text[at : m.start()]), ("label", m[0])]
        at = m.end()
    rest = "" if last else (m[0] if (m := regex.search(_BEGUN, text, pos=at)) and len(m[0]) < LONGEST else "")
    out.append(("text", text[at : len(text) - len(rest)]))
    return [p for p in out if p[1]], rest


class _Buffer(StatefulProcessor):
    """The end of a text that may be the begin of a placeholder, and how many pieces have gone out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "text string, pos long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        text, pos = self.rest.get() if self.rest.exists() else ("", 0)
        out = []
        for row in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            done, text = pieces_of(text + (row.delta or ""), bool(row.last))
            for kind, piece in done:
                out.append((key[0], key[1], row.seq, pos, kind, piece))
                pos += 1
        self.rest.update((text, pos))
        yield pd.DataFrame(out, columns=["id", "session_id", "seq", "pos", "kind", "text"])

    def close(self) -> None:
        pass


def stream_rehydrate(chunks: DataFrame, pseudonyms: DataFrame) -> DataFrame:
    """ST3, X7: chunks (id, session_id, seq, delta, last) of growing texts as pieces with their values, each once.

    Pieces are (id, session_id, seq, pos, kind, text, value), as ``operators.session.rehydrate`` cuts a whole text, but
    that text between placeholders comes out as it arrives. Only an end that may be the begin of a placeholder (shorter
    than ``LONGEST``) waits in the state, for the next chunk or for one with ``last``. Values are joined from the static
    pseudonyms; placeholders that the session does not know are kept as unknown.
    """
    shape = "id string, session_id string, seq long, pos long, kind string, text string"
    cut = chunks.select("id", "session_id", "seq", "delta", F.coalesce("last", F.lit(False)).alias("last"))
    pieces = cut.groupBy("id", "session_id").transformWithStateInPandas(_Buffer(), shape, "Append", "None")
    label = F.regexp_extract("text", LABEL, 1)
    n = F.expr(r"try_cast(regexp_extract(text, '\\[.*_(\\d+)\\]$', 1) AS int)")
    known = pseudonyms.select("session_id", F.col("label").alias("__l"), F.col("n").alias("__n"), F.col("first_value").alias("value"))
    rows = pieces.withColumns({"__l": label, "__n": n}).join(known, ["session_id", "__l", "__n"], "left")
    kind = F.when(F.col("kind") == "text", "text").when(F.col("value").isNull(), "unknown").otherwise("value")
    return rows.select("id", "session_id", "seq", "pos", kind.alias("kind"), "text", F.when(F.col("kind") != "text", F.col("value")).alias("value"))
