import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL_SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from stockfair.session import get_session

    s = get_session(master="local[4]", shuffle_partitions=8)
    yield s


@pytest.fixture
def scratch(tmp_path):
    """A new scratch folder per test (never cleared by hand)."""
    return str(tmp_path)
