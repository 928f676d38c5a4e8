"""The driver's garbage is collected while a long job of small steps runs, so its heap does not grow to all it may have."""

from __future__ import annotations

from spanveil.llm.shared import as_table


def _whole_collections(spark) -> int:
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_garbage_is_collected_between_tables(spark):
    before, table = _whole_collections(spark), spark.range(100)
    for step in range(8):
        table = as_table(table.groupBy((table["id"] % (100 - step)).alias("id")).count().select("id"), "step")
    assert _whole_collections(spark) - before >= 2
    assert table.count() == 93
