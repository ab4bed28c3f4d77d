import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from tidemark.operators.slicing import HOT_KEY_SETTING  # noqa: E402
from tidemark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tidemark-tests")
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Makes every key with more than three rows hot."""
    spark.conf.set(HOT_KEY_SETTING, "3")
    yield
    spark.conf.unset(HOT_KEY_SETTING)


@pytest.fixture(params=["whole", "sliced"])
def both(request, spark):
    """Runs a test with whole keys and again with nearly all keys sliced."""
    if request.param == "sliced":
        spark.conf.set(HOT_KEY_SETTING, "3")
    yield request.param
    spark.conf.unset(HOT_KEY_SETTING)
