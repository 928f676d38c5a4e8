"""A library of processed documents: index and encrypted content (L1 to L7, P14, P15, A-14 to A-16)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import written

LOOSE = "Avulsos"


def case_key(entities: DataFrame) -> DataFrame:
    """A-16: (doc_id, cnj): the first case number of a document."""
    return entities.where("type = 'NUMERO_PROCESSO_CNJ'").groupBy("doc_id").agg(F.min_by("text", "start").alias("cnj"))


def homonyms(index: DataFrame) -> DataFrame:
    """A-14: names that occur more than once."""
    return index.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def folders(index: DataFrame) -> DataFrame:
    """A-15: case numbers of the index, and one folder for documents without any."""
    return index.select(F.coalesce("cnj", F.lit(LOOSE)).alias("folder")).distinct()


def search(index: DataFrame, folder: str | None = None, term: str = "") -> DataFrame:
    """Documents of a folder whose name or case number holds the term, whatever its case."""
    out = index if folder is None else index.where(F.coalesce("cnj", F.lit(LOOSE)) == folder)
    t = F.lower(F.lit(term))
    return out.where(F.lower("name").contains(t) | F.coalesce(F.lower("cnj").contains(t), F.lit(False)))


def newest_first(index: DataFrame) -> DataFrame:
    """O3."""
    return index.orderBy(F.desc("stored_at"), "id")


def kept_after(index: DataFrame, days: int, now: Column) -> DataFrame:
    """L4: rows not older than ``days``; with 0 or less all stay."""
    return index if days <= 0 else index.where(F.col("stored_at") >= now - F.make_dt_interval(F.lit(days)))


def updated(index: DataFrame, changes: DataFrame) -> DataFrame:
    """L2: rows of known ids replaced, keeping id and date; unknown ids make no row."""
    fresh = changes.join(index.select("id", F.col("stored_at").alias("__d")), "id").drop("stored_at").withColumnRenamed("__d", "stored_at")
    return index.join(changes.select("id").distinct(), "id", "left_anti").unionByName(fresh.select(*index.columns))


def without(index: DataFrame, ids: DataFrame) -> DataFrame:
    """L3."""
    return index.join(ids.select("id").distinct(), "id", "left_anti")


class Library:
    """Index and content tables under one path; names, case numbers and texts are encrypted, ids and dates are not.

    Rows are written as parts, folders that never change. A version is a small file that lists the parts of the index and
    of the content, each with its rows and the smallest and greatest id and date, and the tombstones: small tables of
    (id, upto), which say that rows of an id in parts up to a number are gone. Readers drop those by a join, so a delete or a
    retention writes a few ids and no part again; a changed row is a tombstone and a new row. A part whose ids lie outside
    of a change's is not even read for it. ``compact`` writes small or holed parts anew and ``vacuum`` removes what the
    current version does not list, so what was deleted is gone from the disk.

    A change writes its tables, checks that they can be read with the key, and then creates the next version: the file is
    written aside and renamed, which fails if another writer was faster (where a rename to a name that exists fails, as in
    HDFS; on object stores one writer at a time has to be seen to). So readers see one version or the next, whole, and
    an index row never lacks its content.

    The key is a row of a table that is broadcast to its use: it is no literal of a plan, and shows in no event log.
    """

    def __init__(self, spark: SparkSession, path: str, key: str | None):
        if not key or len(key.encode()) not in (16, 24, 32):
            raise ValueError("a key of 16, 24 or 32 bytes is needed")
        self.spark, self.path = spark, path.rstrip("/")
        self._key = spark.createDataFrame([(key,)], "__key string")

    # --- columns and files

    def _keyed(self, df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(self._key))  # one row

    def _closed(self, df: DataFrame, *plain: str) -> DataFrame:
        return self._keyed(df).select(*[F.col(c) if c in plain else F.aes_encrypt(F.col(c), F.col("__key")).alias(c) for c in df.columns])

    def _opened(self, df: DataFrame, *plain: str) -> DataFrame:
        return self._keyed(df).select(*[F.col(c) if c in plain else F.try_aes_decrypt(F.col(c), F.col("__key")).cast("string").alias(c) for c in df.columns])

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def version(self) -> int:
        """The number of the current version; 0 before the first."""
        fs, root = self._fs(f"{self.path}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _state(self, number: int | None = None) -> dict:
        """Parts of both kinds, tombstones, and the number that the next part gets."""
        number = self.version() if number is None else number
        if not number:
            return {"index": [], "content": [], "gone": [], "next": 1}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{number}", wholetext=True).first()[0])

    def _commit(self, state: dict, after: int) -> None:
        fs, place = self._fs(f"{self.path}/versions/{after + 1}")
        _, aside = self._fs(f"{self.path}/versions/.{after + 1}-{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(place) or not fs.rename(aside, place):
            fs.delete(aside, False)
            raise RuntimeError("another writer was faster: read the library again, and repeat the change")

    def _write(self, kind: str, df: DataFrame, number: int) -> dict:
        """A new part, checked to be readable: as many rows, and none that the key does not open."""
        path = f"{self.path}/{kind}/{uuid.uuid4().hex}"
        plain = ("id", "stored_at", "part") if kind == "index" else ("id", "part")
        self._closed(df.withColumn("part", F.lit(number)), *plain).write.parquet(path)
        stored = self.spark.read.parquet(path)
        secret = [c for c in stored.columns if c not in plain]
        lost = [F.count_if(F.col(c).isNotNull()).alias(c) for c in secret]
        dates = [F.min(F.unix_micros("stored_at")).alias("from"), F.max(F.unix_micros("stored_at")).alias("to")] if kind == "index" else []
        found = stored.agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most"), *dates, *lost).first()
        if [found[c] for c in secret] != list(self._opened(stored, *plain).agg(*lost).first()):
            raise ValueError(f"the new {kind} cannot be read back")
        return {"path": path, "number": number, "n": found["n"], "least": found["least"], "most": found["most"], **({"from": found["from"], "to": found["to"]} if dates else {})}

    def _check(self, parts: list[dict]) -> None:
        """An index that the key does not open is neither read nor written to; one row a part shows it, in one job."""
        if not parts:
            return
        rows = self.spark.read.parquet(*[p["path"] for p in parts]).where("name is not null").select("name", F.input_file_name().alias("file"))
        one = rows.groupBy(F.regexp_extract("file", "([0-9a-f]{32})/[^/]*$", 1).alias("part")).agg(F.first("name").alias("name"))
        if not self._opened(one, "part").where("name is null").isEmpty():
            raise ValueError("the index cannot be read with this key")

    def _rows(self, parts: list[dict]) -> DataFrame:
        return self.spark.read.parquet(*[p["path"] for p in parts])

    def _dead(self, kind: str, state: dict) -> DataFrame | None:
        """(id, __u): the number up to which an id's rows are gone; None without a tombstone of the kind."""
        own = [g for g in state["gone"] if kind in g["kinds"]]
        return self._rows(own).groupBy("id").agg(F.max("upto").alias("__u")) if own else None

    def _alive(self, kind: str, state: dict) -> DataFrame:
        """Rows that no tombstone takes away, still encrypted. Parts whose ids none can reach do not meet them."""
        own = [g for g in state["gone"] if kind in g["kinds"]]
        hit = lambda p: any(p["n"] and g["least"] <= p["most"] and p["least"] <= g["most"] and p["number"] <= g["upto"] for g in own)
        free, struck = [p for p in state[kind] if not hit(p)], [p for p in state[kind] if hit(p)]
        out = self._rows(free) if free else None
        if struck:
            rows = self._rows(struck).join(self._dead(kind, state), "id", "left")
            kept = rows.where(F.col("__u").isNull() | (F.col("part") > F.col("__u"))).drop("__u")
            out = kept if out is None else out.unionByName(kept)
        return out.drop("part")

    def _read(self, kind: str, state: dict) -> DataFrame:
        if not state[kind]:
            shape = "id long, name string, cnj string, stored_at timestamp" if kind == "index" else "id long, texto_original string, anonymized_text string"
            return self.spark.createDataFrame([], shape)
        return self._opened(self._alive(kind, state), *(("id", "stored_at") if kind == "index" else ("id",)))

    def _bury(self, ids: DataFrame, upto: int, *kinds: str) -> dict:
        """A tombstone for ids in parts of these kinds up to a number."""
        path = f"{self.path}/gone/{uuid.uuid4().hex}"
        ids.select("id").distinct().withColumn("upto", F.lit(upto)).write.parquet(path)
        found = self.spark.read.parquet(path).agg(F.min("id").alias("least"), F.max("id").alias("most")).first()
        return {"path": path, "upto": upto, "kinds": kinds, "least": found["least"], "most": found["most"]}

    # --- changes

    def append(self, entries: DataFrame, content: DataFrame) -> int:
        """L1: add entries (id, name, cnj, stored_at) and content (id, texto_original, anonymized_text); the new version."""
        now = self.version()
        state = self._state(now)
        self._check(state["index"][-1:])
        number = state["next"]
        added = {"content": self._write("content", content, number), "index": self._write("index", entries.select("id", "name", "cnj", "stored_at"), number)}
        self._commit(state | {k: [*state[k], added[k]] for k in added} | {"next": number + 1}, now)
        return now + 1

    def update(self, changes: DataFrame) -> int:
        """L2: replace name and case number of known ids, keeping their dates; how many rows changed.

        The new rows are a part of their own; the old ones are buried in the index, not in the content.
        """
        now = self.version()
        state = self._state(now)
        # Dates of known ids; where an id has several rows, the changed one is there once, with the newest date.
        known = self._stored(state).groupBy("id").agg(F.max("stored_at").alias("stored_at"))
        last = Window.partitionBy("id").orderBy(F.desc_nulls_last("name"), F.desc_nulls_last("cnj"))
        one = changes.select("id", "name", "cnj").withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")
        rows = written(one.join(known, "id").select("id", "name", "cnj", "stored_at").transform(self._closed, "id", "stored_at"), "changed")
        changed = rows.count()
        if changed:
            number = state["next"]
            part = self._write("index", self._opened(rows, "id", "stored_at"), number)
            self._commit(state | {"index": [*state["index"], part], "gone": [*state["gone"], self._bury(rows, number - 1, "index")], "next": number + 1}, now)
        return changed

    def delete(self, ids: DataFrame) -> int:
        """L3: drop the index rows and the content of these ids, by a tombstone; how many index rows went."""
        now = self.version()
        state = self._state(now)
        return self._strike(now, state, self._stored(state).join(ids.select("id").distinct(), "id", "left_semi"))

    def retain(self, days: int, now: Column | None = None) -> int:
        """L4: drop what is older than ``days`` (0 or less: nothing), by a tombstone; how many index rows went.

        Parts whose smallest date is young enough are not read.
        """
        if days <= 0:
            return 0
        at = self.version()
        state = self._state(at)
        moment = F.current_timestamp() if now is None else now
        limit = self.spark.range(1).select(F.unix_micros(moment - F.make_dt_interval(F.lit(days)))).first()[0]
        old = state | {"index": [p for p in state["index"] if p["from"] is not None and p["from"] < limit]}
        return self._strike(at, state, self._stored(old).where(F.unix_micros("stored_at") < limit))

    def _stored(self, state: dict) -> DataFrame:
        """Ids and dates of the index, without opening what is encrypted."""
        if not state["index"]:
            return self.spark.createDataFrame([], "id long, stored_at timestamp")
        return self._alive("index", state).select("id", "stored_at")

    def _strike(self, now: int, state: dict, rows: DataFrame) -> int:
        self._check(state["index"][-1:])
        doomed = written(rows.select("id"), "doomed")
        gone = doomed.count()
        if gone:
            self._commit(state | {"gone": [*state["gone"], self._bury(doomed, state["next"] - 1, "index", "content")]}, now)
        return gone

    def compact(self, least: int = 1_000_000, holes: float = 0.2) -> int:
        """Write parts of fewer than ``least`` rows, and those of which tombstones took more than ``holes``, as one; how many went.

        Tombstones that no part is left for go too. Rows keep what they hold; the order of parts is that of their numbers.
        """
        now = self.version()
        state = self._state(now)
        self._check(state["index"])
        fresh, went, number = dict(state), 0, state["next"]
        for kind in ("index", "content"):
            parts, dead = state[kind], self._dead(kind, state)
            left = {}
            if dead is not None and parts:
                struck = self._rows(parts).join(dead, "id").where("part <= __u").groupBy("part").agg(F.count("*").alias("n"))
                left = {r["part"]: r["n"] for r in struck.collect()}  # one row a part
            tired = [p for p in parts if p["n"] < least or left.get(p["number"], 0) > holes * p["n"]]
            if len(tired) > 1 or any(left.get(p["number"], 0) for p in tired):
                rows = self._opened(self._alive(kind, state | {kind: tired}), *(("id", "stored_at") if kind == "index" else ("id",)))
                part = self._write(kind, rows, number)
                fresh[kind] = [p for p in parts if p not in tired] + ([part] if part["n"] else [])
                went += len(tired)
        fresh["gone"] = [g for g in state["gone"] if any(p["number"] <= g["upto"] for k in g["kinds"] for p in fresh[k])]
        if went:
            self._commit(fresh | {"next": number + 1}, now)
        return went

    def vacuum(self) -> int:
        """Compact parts with holes, and remove what the current version does not list; how many folders went. Not to be run beside a writer."""
        self.compact(least=0, holes=0.0)
        state = self._state()
        listed = {p["path"].rsplit("/", 1)[-1] for kind in ("index", "content", "gone") for p in state[kind]}
        gone = 0
        for kind in ("index", "content", "gone"):
            fs, root = self._fs(f"{self.path}/{kind}")
            for s in fs.listStatus(root) if fs.exists(root) else []:
                if s.getPath().getName() not in listed:
                    fs.delete(s.getPath(), True)
                    gone += 1
        return gone

    # --- reading

    def index(self) -> DataFrame:
        state = self._state()
        self._check(state["index"])
        return self._read("index", state)

    def open(self, ids: DataFrame | None = None) -> DataFrame:
        """Index joined with its content."""
        state = self._state()
        self._check(state["index"])
        rows = self._read("index", state).join(self._read("content", state), "id")
        return rows if ids is None else rows.join(ids.select("id").distinct(), "id", "left_semi")

    def open_for_egress(self, ids: DataFrame | None = None) -> DataFrame:
        """Without the original text."""
        return self.open(ids).drop("texto_original")

    def missing(self, ids: DataFrame) -> DataFrame:
        return ids.select("id").join(self.index(), "id", "left_anti")
