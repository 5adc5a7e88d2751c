import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from sievelake.session import session, ship

    s = session("tests", "local[4]", 4, spark__ui__enabled="false", spark__driver__memory="4g", spark__sql__warehouse__dir="/tmp/sievelake-warehouse")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    """The smallest of the driver's folders; tests that need it are skipped without it."""
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    return folder
