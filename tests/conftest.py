import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import connect, make_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = make_session(cores=4, partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    return connect(FOLDER)


@pytest.fixture(scope="session")
def folder():
    return FOLDER
