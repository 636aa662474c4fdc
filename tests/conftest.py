import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chalkstream.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", memory="8g")


@pytest.fixture()
def small_tasks(spark):
    """Every group above 40 rows counts as too big for one task."""
    spark.conf.set("spark.chalkstream.rowsPerTask", "40")
    yield
    spark.conf.unset("spark.chalkstream.rowsPerTask")
