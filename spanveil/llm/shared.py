"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import hashlib
import itertools
import tempfile
import uuid

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, a fresh local folder, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Tables between two collections of the driver's garbage.
TABLES_HELD = 4
_written = itertools.count(1)


def let_go(spark: SparkSession) -> None:
    """Have the driver collect its garbage: Spark drops broadcasts and shuffle files of finished steps only then.

    Left to itself the driver's heap first grows to all it may have in jobs of many small steps.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def as_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if next(_written) % TABLES_HELD == 0:
        let_go(spark)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch of whole texts.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Set the session to Arrow batches of ``BATCH_ROWS`` where it has Spark's default of 10,000.

    Rows are whole texts here, and an executor and its Python workers hold several batches at a time.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def digest_in_order(pieces: DataFrame, key: list[str], order: list[str], value: str, between: str) -> DataFrame:
    """The key columns and ``sha256`` of the values of a key, in order and joined by ``between``.

    A hash of one long text runs from its begin to its end, so a key is hashed in one task; but rows stream through it,
    and it holds the state of the hash only. Key columns have no nulls.
    """
    many = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for row in zip(*[batch.column(i).to_pylist() for i in range(many + 1)]):
                if state is None or row[:many] != now:
                    if state is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = row[:many], hashlib.sha256()
                else:
                    state.update(between.encode())
                state.update(row[many].encode())
            yield pa.record_batch([pa.array([r[i] for r in done], t.type) for i, t in enumerate(shape)], schema=shape)
        if state is not None:
            yield pa.record_batch([pa.array([x], t.type) for x, t in zip((*now, state.hexdigest()), shape)], schema=shape)

    out = pieces.select(*key).schema.add("sha256", "string")
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(out)
    ordered = pieces.repartition(*key).sortWithinPartitions(*key, *order).select(*key, value)
    return ordered.mapInArrow(run, out)
