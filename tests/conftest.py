import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from kontor.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8, app_name="kontor-tests")
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="kontor-test-")


SF_SMALL = "/root/testdata/sf0.001"
