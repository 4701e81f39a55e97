import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = os.environ.get("TABLEGAUGE_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tablegauge.session import local_session

    session = local_session("8", 4, "6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
