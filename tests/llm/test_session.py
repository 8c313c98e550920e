"""No operator leaves the session with other settings than it had."""

import pytest

from hallwatch.llm.catalog import QUERIES


def settings(spark):
    return {r.key: r.value for r in spark.sql("SET").collect()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_settings_stay(spark, name):
    before = settings(spark)
    QUERIES[name](spark, "/root/testdata/sf0.001").limit(1).collect()
    assert settings(spark) == before
