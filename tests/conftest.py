import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from webobs.runtime import session, ship

    s = session("tests", "local[4]", 4)
    ship(s)
    return s
