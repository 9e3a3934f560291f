import os

import pytest

from medialake.bindings import Lake
from medialake.session import drop_scratch, local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(int(os.environ.get("TEST_CPUS", "4")), "medialake-tests")
    yield s
    drop_scratch(s)
    s.stop()


@pytest.fixture(scope="session")
def lake(spark):
    return Lake(spark, SMALL)


@pytest.fixture
def rows():
    """Rows of a frame as a sorted list of tuples."""

    def take(df, *columns):
        df = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return take
