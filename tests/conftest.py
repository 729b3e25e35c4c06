import os

import pytest

from paperloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(int(os.environ.get("TEST_CPUS", 4)), "4g", "paperloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
