import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from prooflake.session import local_session

    s = local_session(4, "tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
