import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cashtide.session import local_session

    return local_session(cores=8, partitions=4)


@pytest.fixture(scope="session")
def sf():
    return SMALL
