import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chronoweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
