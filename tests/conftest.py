import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from verbloom.session import local_session

    return local_session(4, "4g", 4)


@pytest.fixture(scope="session")
def data():
    path = Path("/root/testdata/sf0.001")
    if not path.exists():
        pytest.skip("no test data here")
    return str(path)
