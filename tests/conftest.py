import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from nightjar.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=2, shuffle_partitions=4, app="nightjar-tests")
    yield s


@pytest.fixture()
def scratch():
    """A fresh scratch folder per test (never reused, never deleted)."""
    return tempfile.mkdtemp(prefix="nightjar-test-", dir="/tmp")
