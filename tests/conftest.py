"""One local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from basaltine.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("checkpoints")
    session = local_session(4, "3g", 4, **{"spark.checkpoint.dir": str(folder), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield session
    session.stop()


@pytest.fixture
def rows():
    """A DataFrame's rows as a sorted list of tuples."""

    def collected(df):
        return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))

    return collected
