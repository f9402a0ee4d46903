"""A Spark session shared by all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cuemill.session import local_session

    session = local_session(4, 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


def data(size: str) -> str:
    """A folder of test tables; tests that need it are skipped where it is missing."""
    folder = f"/root/testdata/{size}"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    return folder
