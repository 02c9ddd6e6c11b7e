"""A session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from contextlake.session import get_spark, ship_package

    session = get_spark("4", 4, "4g")
    ship_package(session)
    yield session
    session.stop()
