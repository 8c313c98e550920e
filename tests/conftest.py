import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from hallwatch.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4)
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def ts(df, column="ms", name="ts"):
    """Millisecond column to timestamp."""
    from pyspark.sql import functions as F
    return df.withColumn(name, F.timestamp_millis(F.col(column))).drop(column)
