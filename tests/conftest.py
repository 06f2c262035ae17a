import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from obsflow.session import local_session

    session = local_session("tests", cores="8", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture
def series(spark):
    """Build ``(key, ds, y)`` from a list of values, one per day."""
    import datetime as dt

    def build(values, key="global", start=dt.date(2024, 1, 1)):
        rows = [(key, start + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "key string, ds date, y double")

    return build
