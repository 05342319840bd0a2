"""Every registered query that has SQL against it on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import difference
from checks.queries import REGISTERED

SF = "/root/testdata/sf0.001"


def test_each_query_has_sql():
    assert set(REGISTERED) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(REGISTERED))
def test_query_agrees_with_sql(spark, name):
    assert difference(spark, SF, queries()[name], oracle_sql()[name]) is None


def test_entry_gives_rows(spark):
    df = entry(spark)
    assert df.count() == 100
    assert df.columns[0] == "g"


def test_ingest_order_makes_more_files_of_more_text_not_larger_ones(spark, monkeypatch):
    import checks.queries as queries_

    paths = []
    monkeypatch.setattr(queries_, "new_path", lambda s, name, real=queries_.new_path: paths.append(real(s, name)) or paths[-1])
    table = spark.read.parquet(f"{SF}/documents.parquet")
    whole = table.selectExpr("sum(octet_length(text))").first()[0]
    rows = [tuple(r) for r in queries_.ingest_order(spark, SF, whole // 4).collect()]
    assert sorted(rows) == sorted(tuple(r) for r in queries_.ingest_order(spark, SF).collect()) and len(rows) == table.count()
    many, few = (spark.read.text(p, wholetext=True).selectExpr("octet_length(value) AS n").collect() for p in (paths[0], paths[2]))
    assert len(many) >= 9 and len(few) <= 3 and max(r.n for r in many) < max(r.n for r in few) / 2
