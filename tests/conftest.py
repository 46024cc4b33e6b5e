import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import build

    s = build("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__sql__warehouse__dir="/tmp/tessera-warehouse")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
