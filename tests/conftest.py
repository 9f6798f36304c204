import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from helixframe.session import build

    s = build("tests", cores=8, shuffle=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
