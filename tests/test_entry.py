import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, rows
from corpusloom.plans import registry

DATA = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_query(spark):
    df = entry.entry(spark)
    assert df.columns == ["record_table", "record_id", "snapshot_no", "change_type"] and df.count() > 0


def test_core_does_not_import_llm():
    for p in Path(registry.__file__).parent.parent.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"corpusloom\.llm|from \.+llm", p.read_text()), p


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, name):
    df = registry.queries()[name](spark, DATA)
    got = rows(df.columns, df.collect())
    if name in registry.oracle_sql():
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        cur = con.execute(registry.oracle_sql()[name])
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns) and got == rows(columns, cur.fetchall())
