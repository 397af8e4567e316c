from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from rosterlake.session import build_session, ship_package

    s = build_session("local[4]", "tests", **{"spark__sql__shuffle__partitions": "2", "spark__driver__memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s
    s.stop()
