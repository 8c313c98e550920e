"""Every registered query at the smallest scale: against its SQL check, or for plain sanity."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from check import TABLES, compare
from hallwatch.plans.catalog import all_queries

FOLDER = "/root/testdata/sf0.001"
ALLOWED = {"bigint", "double", "string", "boolean"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'").fetchall()
    return con


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    q = all_queries()[name]
    df = q(spark, FOLDER)
    assert {f.dataType.simpleString() for f in df.schema.fields} <= ALLOWED
    got = df.toPandas()
    if q.check is None:
        assert len(got) > 0
    else:
        assert compare(got, con.execute(q.check).fetchdf()) == "ok"


def test_every_operator_of_the_survey_is_covered():
    wanted = {f"O{i:02d}" for i in range(1, 72)} | {f"A{i:02d}" for i in range(1, 13)}
    covered = {c for q in all_queries().values() for c in q.covers}
    assert covered == wanted


def test_contract(spark):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    df = entry_module.entry(spark)
    assert df.columns == ["camera_id", "frame_number", "persons", "overlapping"] and df.count() > 0
