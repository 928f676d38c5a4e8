"""Tables that a job of several steps writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, a fresh local folder, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: computed once, whatever reads it, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged_in(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that Spark must not broadcast: it is sorted and merged, and so spills.

    Spark takes the size of what is derived from a small file (texts made of keys, tokens of texts, salted copies) for that
    of the file, and would send all of it through the driver.
    """
    return df.hint("merge")


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """``df`` over ``spark.sql.shuffle.partitions`` tasks, by the key or evenly, where its files are fewer than the tasks that run at a time.

    Detection costs far more than moving a row, and a file of one row group is one task however many cores are free. Tables
    of many files keep the splits of their scan: no shuffle.
    """
    spark = df.sparkSession
    if len(df.inputFiles()) >= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key)
