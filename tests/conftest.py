import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
sys.path.insert(0, os.path.dirname(HERE))

from compare import DATA, duck, session  # noqa: E402

SF = os.environ.get("TEST_SF", "0.001")


@pytest.fixture(scope="session")
def spark():
    s = session()
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"{DATA}/sf{SF}"


@pytest.fixture(scope="session")
def con(sf_dir):
    return duck(sf_dir)
