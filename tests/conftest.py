import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    import compare

    return compare.session()


@pytest.fixture(autouse=True)
def scratch_removed():
    """No test reads another's tables."""
    yield
    from quantloom.scratch import clear

    clear()


@pytest.fixture(scope="session")
def sf():
    return SF
