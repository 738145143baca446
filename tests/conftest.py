import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ledgerlake.session import build_session, checkpoint_dir
    s = build_session("local[4]", 4, app="ledgerlake-tests")
    checkpoint_dir(s)
    yield s
    s.stop()
