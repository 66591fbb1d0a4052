import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from attestry.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("attestry-tests")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column on one row: one(column, name=value, …)."""
    from pyspark.sql import Row

    def run(column, **values):
        df = spark.createDataFrame([Row(**values)]) if values else spark.range(1)
        return df.select(column.alias("out")).first()["out"]

    return run
