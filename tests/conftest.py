import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from shelfspark.session import ROCKSDB_PROVIDER, local_session

    session = local_session("8", "tests", 2)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collect a DataFrame as a sorted list of tuples of the named columns."""
    def collect(df, *cols):
        return sorted(tuple(r) for r in df.select(*cols).collect())

    return collect
