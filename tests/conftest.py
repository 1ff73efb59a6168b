import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from peerlens.runtime import release, session, ship

    s = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    release(s)
    s.stop()
