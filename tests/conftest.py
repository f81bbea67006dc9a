import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from convoy.settings import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "convoy-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def at():
    """Timestamp on the test day from hour, minute, second."""
    return lambda h=0, m=0, s=0: datetime(2024, 5, 1, h, m, s)


@pytest.fixture(scope="session")
def rows():
    """Collected rows as sorted tuples."""

    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=lambda t: tuple((v is not None, str(v)) for v in t))

    return collect
