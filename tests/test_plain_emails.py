"""E-mail queries on texts whose e-mails are in capitals, touch each other, or begin with a sign: the rows of their SQL."""

from collections import Counter

import pytest

import __spark_entry__ as entry

TEXTS = ["a@b.com", "JOAO@X.COM e Maria@Y.com.br", "ver ..ana@b.com", "_x@b.com-", "a@b.comB@c.org", "a@b.co1@x.com", "a@b.comABC", "joão@x.com", "x@y.COM", "Ana@b.com ana@b.com", "nada", "", None, "lſ@kK.com q@w.es\nz-@w.es"]


@pytest.mark.parametrize("name", ["d15_mask_emails", "d01_window_emails", "d15_mask_long"])
def test_rows_of_the_sql(spark, tmp_path, name):
    import duckdb

    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    asked = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in asked.description]
    found = entry.queries()[name](spark, str(tmp_path)).select(*columns)
    assert Counter(map(tuple, found.collect())) == Counter(asked.fetchall())
